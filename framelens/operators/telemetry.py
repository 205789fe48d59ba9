"""Span, event and worker telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.operators import ordered
from framelens.operators.ordered import time_bucket
from framelens.session import cut_lineage

MIB = 1024 * 1024


def union_telemetry(main: DataFrame, worker: DataFrame) -> DataFrame:
    return main.unionByName(worker, allowMissingColumns=True)


def span_summary(spans: DataFrame, *, keys: Sequence[str] = ("run_id", "name")) -> DataFrame:
    return spans.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.sum("duration_ns").alias("total_duration_ns"),
        F.avg("duration_ns").alias("average_duration_ns"), F.min("duration_ns").alias("min_duration_ns"),
        F.max("duration_ns").alias("max_duration_ns"), F.sum("thread_cpu_ns").alias("total_thread_cpu_ns"),
    )


def by_total(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.col("run_id"), F.col("total_duration_ns").desc(), F.col("name"))


# Additive counters kept per run.
RUN_COUNTERS = (
    "decoded_frames", "analyzed_frames", "detection_frames", "full_scans", "optical_flow_frames", "detected_faces",
    "recognition_inferences", "swapped_frames", "swapped_faces", "written_frames",
)
RUN_SECONDS = ("decode_seconds", "analysis_seconds", "swap_seconds", "postprocess_seconds", "encode_feed_seconds")


def run_counters(frame_events: DataFrame, columns: dict[str, Column], *, key: str = "run_id") -> DataFrame:
    """Sum of each counter per run; ``columns`` says how a frame event contributes, absent counters are 0."""
    unknown = set(columns) - set(RUN_COUNTERS) - set(RUN_SECONDS)
    if unknown:
        raise ValueError(f"unknown counters: {sorted(unknown)}")
    total = lambda name, kind: F.coalesce(F.sum(columns[name].cast(kind)), F.lit(0).cast(kind)) if name in columns else (
        F.first(F.lit(0).cast(kind))
    )
    return frame_events.groupBy(key).agg(
        *(total(name, "long").alias(name) for name in RUN_COUNTERS),
        *(total(name, "double").alias(name) for name in RUN_SECONDS),
    )


def throughput(stats: DataFrame, *, written: str = "written_frames", elapsed: str = "elapsed_seconds") -> DataFrame:
    rate = F.col(written) / F.greatest(F.col(elapsed), F.lit(1e-9))
    return stats.withColumn("effective_fps", F.round(rate, 3))


def clip_counters(
    events: DataFrame, counters: dict[str, Sequence[str]], *, keys: Sequence[str] = ("worker_request_id",)
) -> DataFrame:
    """Event counts per request under new names, and a name-to-total-duration map.

    Two steps: rows are combined per (request, name) first, so the map is built from distinct names only.
    """
    per_name = events.groupBy(*keys, "name").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("duration_ns").alias("_total")
    )
    counted = [
        F.coalesce(F.sum(F.when(F.col("name").isin(*names), F.col("_n"))), F.lit(0)).alias(out)
        for out, names in counters.items()
    ]
    pairs = F.array_sort(F.collect_list(F.struct("name", "_total")))
    return per_name.groupBy(*keys).agg(*counted, F.map_from_entries(pairs).alias("span_duration_ns"))


def run_sessions(events: DataFrame, memory: DataFrame | None = None, *, key: str = "run_id") -> DataFrame:
    """Start, end, elapsed seconds and, with memory rows, the peak per run."""
    bounds = events.groupBy(key).agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("events")
    )
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bounds = bounds.withColumn("elapsed_seconds", (micros("ended") - micros("started")) / 1e6)
    if memory is None:
        return bounds
    peak = memory.groupBy(key).agg(F.max("allocated_bytes").alias("peak_bytes"))
    return bounds.join(peak, key, "left")


def occupancy_flag(
    df: DataFrame, *, mode: str = "adaptive", threshold: float = 0.82, offload: Column | None = None,
    force: bool = False,
) -> DataFrame:
    """Reserved ratio, inactive bytes and whether the cache should be cleared."""
    if mode not in ("adaptive", "always", "never"):
        raise ValueError("mode must be adaptive, always or never")
    inactive = F.greatest(F.lit(0).cast("long"), F.col("reserved_bytes") - F.col("allocated_bytes"))
    ratio = F.col("reserved_bytes") / F.greatest(F.col("total_bytes"), F.lit(1).cast("long"))
    if force or mode == "always":
        clear = F.lit(True)
    elif mode == "never":
        clear = F.lit(False)
    else:
        offloading = F.col("offload") if offload is None else offload
        clear = (offloading & (inactive > 256 * MIB)) | ((ratio >= threshold) & (inactive > 512 * MIB))
    return df.withColumns({"inactive_bytes": inactive, "reserved_ratio": ratio, "should_clear": clear})


def correlate_requests(
    requests: DataFrame, responses: DataFrame, *, keys: Sequence[str] = ("run_id", "worker_request_id")
) -> DataFrame:
    """Each request with the events that answer it; unanswered requests stay.

    Answers are combined per request id before the join, so a busy id never multiplies rows.
    """
    keys = list(keys)
    answers = responses.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("worker_events"), F.sum("duration_ns").alias("worker_duration_ns"),
        F.min_by("span_id", F.struct("ts", "span_id")).alias("first_event"),
    )
    return requests.join(answers, keys, "left").withColumn(
        "worker_events", F.coalesce("worker_events", F.lit(0))
    )


def span_children(spans: DataFrame, *, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Children count, child total and self time per span."""
    keys = list(keys)
    totals = spans.filter(F.col("parent_span_id").isNotNull()).groupBy(*keys, "parent_span_id").agg(
        F.count(F.lit(1)).alias("children"), F.sum("duration_ns").alias("child_duration_ns")
    ).withColumnRenamed("parent_span_id", "span_id")
    zero = F.lit(0).cast("long")
    joined = spans.join(totals, [*keys, "span_id"], "left").withColumns(
        {"children": F.coalesce("children", zero), "child_duration_ns": F.coalesce("child_duration_ns", zero)}
    )
    return joined.withColumn("self_duration_ns", F.col("duration_ns") - F.col("child_duration_ns"))


def span_tree(spans: DataFrame, *, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Root, depth and path of every span, and ``complete``: its chain of parents ends in a root.

    Spans whose chain breaks off (the parent's line was lost) or runs in a circle stay, with null root, depth
    and path. Ancestor pointers double each round, so a tree of depth d takes about log2(d) joins. When a round
    finishes no span, only circles are left open: a chain that ends has a span to finish in every round.
    """
    keys = list(keys)
    links = cut_lineage(spans.select(
        *keys, "span_id", F.col("parent_span_id").alias("up"), F.col("span_id").alias("root"),
        F.lit(0).cast("long").alias("depth"), F.col("span_id").cast("string").alias("path"), F.lit(True).alias("complete"),
    ))
    lost = lambda kind: F.lit(None).cast(kind)
    kinds = dict(links.dtypes)
    broken = {"up": lost(kinds["up"]), "root": lost(kinds["root"]), "depth": lost("long"), "path": lost("string"), "complete": F.lit(False)}
    open_spans = links.filter(F.col("up").isNotNull()).count()
    while open_spans:
        target = links.select(
            *(F.col(c).alias(f"_of_{c}") for c in keys), F.col("span_id").alias("_id"), F.col("up").alias("_up"), F.col("root").alias("_root"),
            F.col("depth").alias("_depth"), F.col("path").alias("_path"), F.col("complete").alias("_complete"),
        )
        # Finished spans need no join; only open ones are shuffled on their ancestor.
        done = links.filter(F.col("up").isNull())
        same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys] + [F.col("up") == F.col("_id")]
        met = links.filter(F.col("up").isNotNull()).join(target, same, "left")
        whole = F.col("_id").isNotNull() & F.col("_complete")
        moved = met.select(
            *keys, "span_id", F.when(whole, F.col("_up")).alias("up"), F.when(whole, F.col("_root")).alias("root"),
            F.when(whole, F.col("depth") + F.col("_depth") + 1).alias("depth"),
            F.when(whole, F.concat_ws("/", "_path", "path")).alias("path"), whole.alias("complete"),
        )
        links = cut_lineage(done.unionByName(moved))
        before, open_spans = open_spans, links.filter(F.col("up").isNotNull()).count()
        if open_spans == before:
            break
    if open_spans:
        links = links.filter(F.col("up").isNull()).unionByName(links.filter(F.col("up").isNotNull()).withColumns(broken))
    return links.drop("up")


def top_functions(
    profile: DataFrame, n: int, *, scope: str = "run_id", time: str = "duration_ns", function: str = "span_id"
) -> DataFrame:
    """The ``n`` functions of largest cumulative time per scope; the ranking is cut before the shuffle."""
    order = Window.partitionBy(scope).orderBy(F.col(time).desc(), F.col(function))
    return profile.filter(F.col(time) > 0).withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= max(1, int(n))
    )


def dedupe_exceptions(logs: DataFrame, *, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Earliest record per exception; combined before the shuffle."""
    rest = [c for c in logs.columns if c not in keys]
    first = logs.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*keys, "_first.*").select(*logs.columns)


def stalled_runs(
    heartbeats: DataFrame, interval: float, *, tolerance: float = 2.0, key: str = "run_id", ts: str = "ts",
    tie: str = "event_id", depth: int = ordered.BUCKET_ROWS,
) -> DataFrame:
    """Heartbeats that came more than ``tolerance`` intervals after the one before.

    A run of more than ``depth`` heartbeats is cut at quantiles of time, so it spreads even if all of them fall on a day.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    placed = ordered.even_buckets(heartbeats, [key], micros(ts), "_part", depth=depth)
    lagged = ordered.ordered_lag(placed, [key], [ts, tie], F.col("_part"), {"_before": F.col(ts)}).drop("_part")
    gap = (micros(ts) - micros("_before")) / 1e6
    return lagged.withColumn("gap_seconds", gap).filter(gap > interval * tolerance).drop("_before")


def slow_waits(df: DataFrame, threshold_ns: int = 1_000_000_000, *, column: str = "wait_ns") -> DataFrame:
    """Stateless, so it serves batch and stream alike."""
    return df.filter(F.col(column) >= threshold_ns)


def lru_hits(
    accesses: DataFrame, capacity: int, *, key: str = "key", item: str = "item", order: Sequence[str] = ("ts", "event_id"),
    bucket: Column | None = None,
) -> DataFrame:
    """Adds ``hit``: the item is among the last ``capacity`` distinct ones used under its key.

    The cache at the start of a bucket is the ``capacity`` most recent distinct items of all earlier buckets.
    Each bucket contributes its own most recent ones (ranked and cut before the shuffle); a fold over these
    short lists gives every bucket its starting cache, and the buckets are then replayed independently.
    """
    capacity = max(1, int(capacity))
    order = list(order)
    cut = accesses.withColumn(ordered.BUCKET, time_bucket(order[0], 3600) if bucket is None else bucket)
    types = {f.name: f.dataType.simpleString() for f in accesses.schema.fields}
    last = cut.groupBy(key, ordered.BUCKET, item).agg(F.max(F.struct(*order)).alias("_at"))
    newest = Window.partitionBy(key, ordered.BUCKET).orderBy(F.col("_at").desc())
    tail = (
        last.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= capacity)
        .groupBy(key, ordered.BUCKET).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("_at", F.col(item).alias("i")))), lambda x: x["i"]).alias("_tail")
        )
    )

    def begin(k):
        return k[0], {}

    def advance(state, row):
        k, cache = state
        at, recent = row
        out = [(k, at, list(cache))]
        for i in recent:
            cache.pop(i, None)
            cache[i] = True
        while len(cache) > capacity:
            del cache[next(iter(cache))]
        return out

    starts = ordered.fold_sorted(
        tail, [key], [ordered.BUCKET], [ordered.BUCKET, "_tail"], begin, advance,
        f"`{key}` {types[key]}, {ordered.BUCKET} long, _cache array<{types[item]}>",
    )
    names = accesses.columns

    def replay_begin(k):
        return {"cache": None}

    def replay(state, row):
        *values, start = row
        if state["cache"] is None:
            state["cache"] = dict.fromkeys(start)
        cache = state["cache"]
        used = values[names.index(item)]
        hit = used in cache
        cache.pop(used, None)
        cache[used] = True
        while len(cache) > capacity:
            del cache[next(iter(cache))]
        return [(*values, hit)]

    starts = starts.withColumnsRenamed({c: f"_of_{c}" for c in (key, ordered.BUCKET)})
    joined = ordered.join_null_safe(cut, starts, [key, ordered.BUCKET])
    out_schema = ", ".join(f"`{n}` {types[n]}" for n in names) + ", hit boolean"
    return ordered.fold_sorted(
        joined.withColumn("_k", F.col(key)), ["_k", ordered.BUCKET], order, [*names, "_cache"], replay_begin, replay,
        out_schema,
    )
