"""Sinks: JSON lines and named documents."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framelens.functions import path_stem
from framelens.operators.provenance import QUALITY_SCHEMA
from framelens.session import cut_lineage


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines; open-ended extra fields may be VARIANT."""
    df.write.mode("append").option("ignoreNullFields", "true").json(path)


def stream_jsonl(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The same for a stream, exactly once."""
    return (
        df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


#: Bytes of documents a shard should hold, and the pointer to the version that counts.
SHARD_BYTES, CURRENT = 64 << 20, "_current"


def write_documents(
    df: DataFrame, directory: str, *, name: str, document: str = "document", shard_bytes: int = SHARD_BYTES
) -> None:
    """JSON lines (name, document) in shards by hash of the name, in a committed version of the folder.

    A name is written once: its row replaces the one already there, a second write of the same rows changes nothing. Of
    rows that share a name the greatest document stays. Shards that ``df`` touches are written beside the old ones;
    then one file, ``_current``, which lists the shards, is replaced in one step. Readers see the old documents or the new
    ones, and a write that fails or is killed leaves the old ones. The version read is checked again before the
    step, so of two writers at once the later fails instead of losing the other's documents.

    There are as many shards as the documents fill; when they outgrow them fourfold, all are written anew.
    """
    spark = df.sparkSession
    new = df.select(F.col(name).alias("name"), F.col(document).alias("document")).groupBy("name").agg(F.max("document").alias("document"))
    new = cut_lineage(new)
    size = new.agg(F.sum(F.octet_length("name") + F.octet_length("document"))).first()[0] or 0
    seen = _version(spark, directory)
    held = seen["bytes"] if seen else 0
    count = len(seen["shards"]) if seen else 0
    wanted = max(1, -(-(size + held) // shard_bytes))
    anew = not count or wanted > 4 * count
    count = wanted if anew else count
    new = new.withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(count)).cast("int"))
    if seen:
        old = read_documents(spark, directory).withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(count)).cast("int"))
        if not anew:
            touched = {row["shard"] for row in new.select("shard").distinct().collect()}  # at most one row a shard
            old = old.filter(F.col("shard").isin(sorted(touched)))
        new = new.unionByName(old.join(new.select("name"), "name", "left_anti").select("name", "document", "shard"))
    version = f"version-{uuid.uuid4().hex}"
    new.repartition(count, "shard").write.partitionBy("shard").json(f"{directory}/{version}")
    written = spark.read.schema("name string, document string, shard int").json(f"{directory}/{version}").groupBy("shard").agg(
        F.sum(F.octet_length("name") + F.octet_length("document")).alias("bytes")
    ).collect() if _exists(spark, f"{directory}/{version}") else []
    before = {} if anew or not seen else {int(k): v for k, v in seen["shards"].items()}
    shards = {k: before.get(k) for k in range(count)} | {row["shard"]: [f"{version}/shard={row['shard']}", row["bytes"]] for row in written}
    _commit(spark, directory, {"shards": shards, "bytes": sum(v[1] or 0 for v in shards.values() if v), "version": version}, seen)


def read_documents(spark: SparkSession, directory: str) -> DataFrame:
    """``name, document`` of the committed version of what ``write_documents`` wrote."""
    version = _version(spark, directory)
    paths = [f"{directory}/{v[0]}" for v in version["shards"].values() if v] if version else []
    schema = "name string, document string"
    return spark.read.schema(schema).json(paths) if paths else spark.createDataFrame([], schema)


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, where: str) -> bool:
    path, system = _path(spark, where)
    return system.exists(path)


def _version(spark: SparkSession, directory: str) -> dict | None:
    """The committed list of shards; small, one entry a shard."""
    path, system = _path(spark, f"{directory}/{CURRENT}")
    if not system.exists(path):
        return None
    source = system.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def _commit(spark: SparkSession, directory: str, version: dict, seen: dict | None) -> None:
    now = _version(spark, directory)
    if (now or {}).get("version") != (seen or {}).get("version"):
        raise RuntimeError(f"{directory} was written by another job meanwhile; its documents stay as that job left them")
    beside, system = _path(spark, f"{directory}/_{version['version']}")
    out = system.create(beside, True)
    out.write(bytearray(json.dumps(version).encode()))
    out.close()
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, fs.Path(f"{directory}/{CURRENT}"), overwrite)


def write_manifests(manifests: DataFrame, directory: str) -> None:
    write_documents(manifests, directory, name="manifest")


def quality_documents(report: DataFrame, output: str = "output_video") -> DataFrame:
    """``<stem>.quality.json`` and its document: track, plan and metrics as far as the columns are there."""
    parts = [c for c in ("target_track", "clip_plan", "metrics", "visual_comparison") if c in report.columns]
    body = F.struct(F.lit(QUALITY_SCHEMA).alias("schema"), F.col(output).alias("output_video"), *parts)
    return report.select(
        F.concat(path_stem(F.col(output)), F.lit(".quality.json")).alias("name"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("document"),
    )


def write_quality_reports(report: DataFrame, directory: str, *, output: str = "output_video") -> None:
    write_documents(quality_documents(report, output), directory, name="name")
