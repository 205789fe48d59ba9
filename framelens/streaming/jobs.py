"""Structured Streaming operators. Every stream carries a watermark; state is bounded by it or by the key."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framelens.operators import telemetry
from framelens.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_files(spark: SparkSession, path: str, *, max_files: int | None = None) -> DataFrame:
    """A parquet source with the schema of its files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # As a pattern the path may name one file or a folder of files.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def timed(df: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


@contextmanager
def _settings(spark: SparkSession, **values):
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_available(df: DataFrame, name: str, *, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a file sink in the shared folder and read the result."""
    return run_counted(df, name, mode=mode)[0]


def late_rows(query: StreamingQuery) -> int:
    """Rows that stateful operators dropped because they came after the watermark, in the batches progress still holds."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def run_counted(df: DataFrame, name: str, *, mode: str = "append") -> tuple[DataFrame, int]:
    """The same, and how many late rows were dropped."""
    spark = df.sparkSession
    out = scratch_path(spark, name)
    with _settings(spark, **{"spark.sql.streaming.stateStore.providerClass": ROCKSDB}):
        query = (
            df.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/data")
            .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/data"), late_rows(query)


def _window_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")}).drop("window")


def stream_span_summary(stream: DataFrame, every: str = "1 hour", *, delay: str = "10 minutes") -> DataFrame:
    """Span summary per run, name and tumbling window; a window is emitted once the watermark passes it."""
    grouped = timed(stream, delay).groupBy(F.window("ts", every), "run_id", "name").agg(
        F.count(F.lit(1)).alias("count"), F.sum("duration_ns").alias("total_duration_ns"),
        F.min("duration_ns").alias("min_duration_ns"), F.max("duration_ns").alias("max_duration_ns"),
        F.sum("thread_cpu_ns").alias("total_thread_cpu_ns"),
    )
    return _window_columns(grouped)


def stream_sliding(
    stream: DataFrame, size: str, slide: str, *, delay: str = "10 minutes", keys: Sequence[str] = ("event_type",),
    value: str = "value",
) -> DataFrame:
    grouped = timed(stream, delay).groupBy(F.window("ts", size, slide), *keys).agg(
        F.count(F.lit(1)).alias("count"), F.sum(value).alias("total")
    )
    return _window_columns(grouped)


def stream_sessions(
    stream: DataFrame, gap: str, *, delay: str = "10 minutes", key: str = "user_id"
) -> DataFrame:
    """Sessions end after a gap without events; emitted once the watermark passes their end."""
    grouped = timed(stream, delay).groupBy(F.session_window("ts", gap).alias("window"), key).agg(
        F.count(F.lit(1)).alias("events")
    )
    return _window_columns(grouped)


def slow_queue_waits(stream: DataFrame, threshold_ns: int = 1_000_000_000, *, column: str = "wait_ns") -> DataFrame:
    return telemetry.slow_waits(stream, threshold_ns, column=column)


def stream_correlate(
    requests: DataFrame, responses: DataFrame, within: str, *, keys: Sequence[str] = ("run_id", "request_id"),
    delay: str = "10 minutes", how: str = "inner",
) -> DataFrame:
    """Requests with their responses at most ``within`` apart; both sides' state expires with the watermark.

    Expects a request id to name one request. Columns: keys, requested, responded and the payloads.
    """
    left = timed(requests, delay, "requested").alias("q")
    right = timed(responses, delay, "responded").alias("a")
    same = [F.col(f"q.{k}") == F.col(f"a.{k}") for k in keys]
    span = F.expr(f"INTERVAL {within}")
    near = (F.col("a.responded") >= F.col("q.requested") - span) & (F.col("a.responded") <= F.col("q.requested") + span)
    condition = near
    for part in same:
        condition = condition & part
    payload = [c for c in responses.columns if c not in (*keys, "responded")]
    return left.join(right, condition, how).select(
        *(F.col(f"q.{c}") for c in requests.columns), F.col("a.responded"), *(F.col(f"a.{c}") for c in payload)
    )


def stream_dedupe(
    stream: DataFrame, keys: Sequence[str], *, delay: str = "10 minutes", ts: str = "ts", keep_days: int = 30
) -> DataFrame:
    """The earliest row by event time of each key, once, when the watermark has passed it.

    A key is remembered for ``keep_days`` after its row and may come again after that, which bounds the state.
    """
    from framelens.streaming.processors import STAMPS, FirstOnce, sharded

    rows = timed(stream, delay, ts)
    packed = rows.select(*sharded(list(keys)), ts, F.unix_micros(ts).alias("at_us"), F.to_json(F.struct(*rows.columns), STAMPS).alias("row"))
    first = stateful(packed, ["shard"], FirstOnce(keep_days * 86_400_000), "row string", time_mode="EventTime")
    return first.select(F.from_json("row", stream.schema, STAMPS).alias("row")).select("row.*")


def stream_upsert_cache(
    stream: DataFrame, path: str, checkpoint: str, *, keys: Sequence[str] = ("root", "path"), version: str = "updated"
) -> StreamingQuery:
    """Keep a keyed cache current.

    Each batch writes its newest row per key to its own folder, overwriting it on a retry, so a batch counts
    once. ``current_cache`` reads the newest row per key; ``compact_cache`` folds the folders into one.
    """
    keys = list(keys)

    def store(batch: DataFrame, batch_id: int) -> None:
        newest_per_key(batch, keys, version).withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode(
            "overwrite"
        ).parquet(f"{path}/part={batch_id:012d}")

    return (
        stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def newest_per_key(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_newest"))
    return newest.select(*keys, "_newest.*")


def current_cache(spark: SparkSession, path: str, *, keys: Sequence[str] = ("root", "path"), version: str = "updated"):
    rows = spark.read.option("basePath", path).parquet(f"{path}/part=*").drop("part")
    return newest_per_key(rows, list(keys), version, "batch_id").drop("batch_id")


def compact_cache(spark: SparkSession, path: str, target: str, **options) -> None:
    current_cache(spark, path, **options).withColumn("batch_id", F.lit(-1).cast("long")).write.mode("overwrite").parquet(
        f"{target}/part=000000000000"
    )


def stateful(
    stream: DataFrame, keys: Sequence[str], processor, schema: str, *, time_mode: str = "None"
) -> DataFrame:
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time_mode
    )

