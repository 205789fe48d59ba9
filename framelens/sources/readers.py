"""Sources: media listings, JSON lines, worker output, probes, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.functions import path_parts
from framelens.operators.filters import is_hdr

# Image suffixes, line prefixes, level names.
MEDIA_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp")
WORKER_PREFIXES = ("RESULT", "PROFILE", "LOG")
LOG_LEVELS = ("CRITICAL", "FATAL", "ERROR", "WARN", "WARNING", "INFO", "DEBUG", "NOTSET")
DEFAULT_EVENT, DEFAULT_SOURCE, DEFAULT_MESSAGE = "worker_event", "worker", "Worker message"
QUARANTINE_CHARS = 2000


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def list_media(spark: SparkSession, directory: str, limit: int) -> DataFrame:
    """First ``limit`` images below a folder in path order. Contents are not read; an empty folder is an error."""
    pattern = r"(?i)\.(" + "|".join(MEDIA_SUFFIXES) + ")$"
    found = _files(spark, directory).select("path", F.col("length").alias("size")).filter(F.col("path").rlike(pattern))
    if found.isEmpty():
        raise ValueError(f"no images below {directory}")
    return found.orderBy(path_parts(F.col("path"))).limit(limit)


def scan_artifacts(spark: SparkSession, root: str, *, with_content: bool = True) -> DataFrame:
    """Files below ``root``: relative path, size, mtime_ns and, if asked for, content."""
    files = _files(spark, root)
    prefix = F.regexp_replace(F.lit(root.rstrip("/") + "/"), r"^file:/*", "/")
    plain = F.regexp_replace("path", r"^file:/*", "/")
    relative = F.when(F.startswith(plain, prefix), F.substr(plain, F.length(prefix) + 1)).otherwise(plain)
    content = ["content"] if with_content else []
    return files.select(
        F.lit(root).alias("root"), relative.alias("path"), F.col("length").alias("size"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), *content,
    )


def parse_events(df: DataFrame, line: str = "line") -> DataFrame:
    """Fixed envelope plus ``extra``, the whole record as VARIANT. A line that is not JSON gives nulls."""
    record = F.try_parse_json(F.col(line))
    field = lambda path, kind: F.try_variant_get(F.col("extra"), f"$.{path}", kind)
    return df.withColumn("extra", record).withColumns(
        {
            "timestamp": field("timestamp", "string"), "run_id": field("run_id", "string"),
            "event": field("event", "string"), "thread": field("thread", "string"),
            "process_id": field("process_id", "bigint"),
        }
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(spark.read.text(path).withColumnRenamed("value", "line"), "line")


def read_worker_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``class`` (result, profile, log, quarantine, passthrough), ``payload`` VARIANT and ``raw``.

    A profile or log line that is no JSON object is quarantined with its first 2000 characters; a broken
    result line is an error of the worker and keeps its class, with a null payload.
    """
    trimmed = F.regexp_replace(F.col(line), r"[\r\n]+$", "")
    prefix = F.regexp_extract(trimmed, "^(" + "|".join(WORKER_PREFIXES) + ") ", 1)
    body = F.regexp_replace(trimmed, "^(" + "|".join(WORKER_PREFIXES) + ") ", "")
    payload = F.when(prefix != "", F.try_parse_json(body))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(payload), F.lit("OBJECT")), F.lit(False))
    klass = (
        F.when(prefix == "", F.lit("passthrough"))
        .when((prefix != "RESULT") & ~is_object, F.lit("quarantine"))
        .otherwise(F.lower(prefix))
    )
    return df.select("*", klass.alias("class"), F.lower(prefix).alias("tag"), payload.alias("payload")).withColumn(
        "raw",
        F.when(F.col("class") == "quarantine", F.substring(trimmed, 1, QUARANTINE_CHARS))
        .when(F.col("class") == "passthrough", trimmed),
    )


def normalize_worker_event(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Defaults for event, source and message; the level upper-cased, WARNING when absent or unknown."""
    field = lambda name: F.try_variant_get(F.col(payload), f"$.{name}", "string")
    level = F.upper(field("level"))
    return df.withColumns(
        {
            "event": F.coalesce(field("event"), F.lit(DEFAULT_EVENT)),
            "source": F.coalesce(field("source"), F.lit(DEFAULT_SOURCE)),
            "message": F.coalesce(field("message"), F.lit(DEFAULT_MESSAGE)),
            "level": F.when(level.isin(*LOG_LEVELS), level).otherwise(F.lit("WARNING")),
        }
    )


def read_probe_json(df: DataFrame, column: str = "probe") -> DataFrame:
    """Colour fields of the first stream; all null when the document does not parse."""
    names = {
        "pixel_format": "pix_fmt", "color_primaries": "color_primaries", "color_transfer": "color_transfer",
        "color_space": "color_space", "color_range": "color_range",
    }
    inner = ",".join(f"{source}:string" for source in names.values())
    parsed = F.from_json(column, f"streams array<struct<{inner}>>")
    first = F.get(parsed["streams"], F.lit(0))
    out = df.select("*", *(first[source].alias(name) for name, source in names.items()))
    return out.withColumn("hdr", is_hdr(F.col("color_transfer")))


def split_valid(df: DataFrame, flag: Column | str = "valid") -> tuple[DataFrame, DataFrame]:
    condition = F.col(flag) if isinstance(flag, str) else flag
    return df.filter(condition), df.filter(~condition)
