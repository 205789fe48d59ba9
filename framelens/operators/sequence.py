"""Sequence operators over frames: cuts, gaps, smoothing, deltas, summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from framelens.functions import bhattacharyya, mean_abs_difference
from framelens.operators import ordered
from framelens.operators.ordered import frame_bucket
from framelens.operators.quantiles import exact_percentile
from framelens.operators.windows import in_bins
from framelens.session import cut_lineage

MAX_SMOOTHING = 0.98
JUMP_HISTORY = 20


def scene_cuts(
    frames: DataFrame, threshold: float, *, keys: Sequence[str] = ("video_id",), index: str = "frame_index",
    hist: str = "hist",
) -> DataFrame:
    """Add ``scene_cut``: histogram distance to the frame before is at least ``threshold``."""
    lagged = ordered.ordered_lag(frames, keys, index, frame_bucket(index), {"_hist": F.col(hist)})
    cut = F.coalesce(bhattacharyya("_hist", hist) >= threshold, F.lit(False))
    return lagged.withColumn("scene_cut", cut).drop("_hist")


def scene_id(
    frames: DataFrame, *, keys: Sequence[str] = ("video_id",), index: str = "frame_index", cut: str = "scene_cut"
) -> DataFrame:
    return ordered.ordered_running_sum(
        frames, keys, index, frame_bucket(index), F.col(cut).cast("long"), "scene_id"
    )


def missing_run(
    df: DataFrame, max_missing: int, *, keys: Sequence[str] = ("key",), index: str = "idx", hit: str = "hit"
) -> DataFrame:
    """Misses since the last hit (or the start), whether that loses the target, and whether it is held.

    ``index`` numbers the rows of a key without holes.
    """
    at = F.when(F.col(hit), F.col(index))
    seen = ordered.ordered_last_value(df, keys, index, frame_bucket(index), at, "_last_hit")
    run = F.col(index) - F.coalesce(F.col("_last_hit"), F.lit(-1))
    return seen.withColumns(
        {
            "missing_run": run.cast("long"),
            "expired": run > max_missing,
            "held": F.col("_last_hit").isNotNull() & (run <= max_missing),
        }
    ).drop("_last_hit")


def restart_after_gap(
    df: DataFrame, max_missing: int, *, keys: Sequence[str] = ("key",), index: str = "idx", hit: str = "hit"
) -> DataFrame:
    """Hits only, with ``restart``: no earlier hit is near enough to continue from."""
    at = F.when(F.col(hit), F.col(index))
    seen = ordered.ordered_last_value(
        df, keys, index, frame_bucket(index), at, "_last_hit", inclusive=False
    ).filter(F.col(hit))
    gone = F.col("_last_hit").isNull() | (F.col(index) - F.col("_last_hit") - 1 > max_missing)
    return seen.withColumn("restart", gone).drop("_last_hit")


def ema(
    df: DataFrame, alpha: float, *, keys: Sequence[str] = ("key",), index: str = "idx", value: str = "x",
    restart: str = "restart", name: str = "smoothed",
) -> DataFrame:
    """s = alpha * s_before + (1 - alpha) * x, starting over with x on the first and on restart rows.

    The recurrence is affine in the state that enters a bucket, so each bucket is summarised by two numbers
    (gain, offset), the states between buckets follow from those, and buckets are smoothed independently.
    """
    alpha = min(MAX_SMOOTHING, max(0.0, float(alpha)))
    keys = list(keys)
    cut = df.withColumn(ordered.BUCKET, F.coalesce(frame_bucket(index), F.lit(ordered.NO_ORDER)))
    item = F.struct(F.col(index).alias("at"), F.col(value).cast("double").alias("x"), F.col(restart).alias("r"))

    def compose(acc: Column, row: Column) -> Column:
        gain = F.when(row["r"], F.lit(0.0)).otherwise(acc["gain"] * alpha)
        offset = F.when(row["r"], row["x"]).otherwise(acc["offset"] * alpha + row["x"] * (1.0 - alpha))
        return F.struct(gain.alias("gain"), offset.alias("offset"))

    identity = F.struct(F.lit(1.0).alias("gain"), F.lit(0.0).alias("offset"))
    summary = cut.groupBy(*keys, ordered.BUCKET).agg(
        F.aggregate(F.array_sort(F.collect_list(item)), identity, compose).alias("_step")
    ).select(*keys, ordered.BUCKET, "_step.gain", "_step.offset")

    key_fields = [field for field in df.schema.fields if field.name in keys]
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields)
    key_names = [f.name for f in key_fields]

    def begin(key):
        return {"key": key, "value": 0.0}

    def advance(state, row):
        bucket, gain, offset = row
        entering = state["value"]
        state["value"] = gain * entering + offset
        return [(*state["key"], bucket, entering)]

    entering = ordered.fold_sorted(
        summary, key_names, [ordered.BUCKET], [ordered.BUCKET, "gain", "offset"], begin, advance,
        f"{key_ddl}, {ordered.BUCKET} long, _entering double",
    )
    entering = entering.withColumnsRenamed({c: f"_of_{c}" for c in (*keys, ordered.BUCKET)})
    joined = ordered.join_null_safe(cut, entering, [*keys, ordered.BUCKET]).withColumns({f"_key_{k}": F.col(k) for k in keys})
    names, marks = df.columns, [*(f"_key_{k}" for k in keys), ordered.BUCKET]

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, entered, group = (batch.column(batch.schema.get_field_index(c)) for c in (value, "_entering", "_group"))
            x, entered, group = (c.to_numpy(zero_copy_only=False) for c in (x.cast(pa.float64()), entered, group))
            begins = np.append(group[0] != before, group[1:] != group[:-1])
            restarts = batch.column(names.index(restart)).to_numpy(zero_copy_only=False).astype(bool)
            offset = np.where(restarts, x, (1.0 - alpha) * x + np.where(begins, alpha * entered, 0.0))
            gain = np.where(restarts | begins, 0.0, alpha)
            offset[0] += gain[0] * last
            now = affine_scan(gain, offset)
            before, last = group[-1], now[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(now, from_pandas=True)], names=[*names, name])

    # groups of a sorted partition are told apart by a hash of key and bucket and by their order
    grouped = joined.withColumn("_group", F.xxhash64(*(F.coalesce(F.col(m).cast("string"), F.lit("")) for m in marks), *(F.col(m).isNull() for m in marks)))
    arranged = grouped.repartition(*marks).sortWithinPartitions(*marks, index).select(*names, "_entering", "_group")
    return arranged.mapInArrow(smooth, StructType([*df.schema.fields, StructField(name, DoubleType())]))


def affine_scan(gain: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """s[i] = gain[i] * s[i - 1] + offset[i] from s[-1] = 0, by composing steps over distances 1, 2, 4 and so on."""
    gain, offset, reach = gain.copy(), offset.copy(), 1
    while reach < len(gain) and gain[reach:].any():
        goes_on = gain[reach:] != 0  # what is not a number ends where a sequence starts over
        offset[reach:] += np.where(goes_on, gain[reach:] * np.where(goes_on, offset[:-reach], 0.0), 0.0)
        gain[reach:] *= gain[:-reach].copy()
        reach *= 2
    return offset


def frame_pair_join(
    original: DataFrame, output: DataFrame, *, keys: Sequence[str] = ("video_id", "frame_index")
) -> DataFrame:
    """Frames present on both sides, side by side."""
    return original.join(output, list(keys))


def temporal_delta(
    frames: DataFrame, *, keys: Sequence[str] = ("video_id",), index: str = "frame_index", values: str = "values",
    present: Column | None = None, name: str = "delta",
) -> DataFrame:
    """Mean absolute change against the frame before; null when either frame has no target."""
    held = F.when(F.lit(True) if present is None else present, F.col(values))
    lagged = ordered.ordered_lag(frames, keys, index, frame_bucket(index), {"_values": held})
    return lagged.withColumn(name, mean_abs_difference("_values", held)).drop("_values")


def boundary_jump(
    df: DataFrame, *, keys: Sequence[str] = ("key",), index: str = "idx", delta: str = "delta",
    boundary: str = "boundary", name: str = "jump",
) -> DataFrame:
    """Boundary rows with their delta relative to the median of up to 20 earlier deltas."""
    moved = df.filter(F.col(delta).isNotNull())
    recent = ordered.ordered_recent(moved, keys, index, F.col(delta).cast("double"), "_recent", count=JUMP_HISTORY)
    ranked = F.array_sort("_recent")
    n = F.size("_recent")
    middle = (F.get(ranked, F.floor((n - 1) / 2).cast("int")) + F.get(ranked, F.floor(n / 2).cast("int"))) / 2
    baseline = F.when(n > 0, middle).otherwise(F.greatest(F.col(delta), F.lit(1.0)))
    return (
        recent.filter(F.col(boundary))
        .withColumn(name, F.col(delta) / F.greatest(F.lit(1.0), baseline))
        .drop("_recent")
    )


def timeline_positions(samples: int) -> list[float]:
    """Evenly spaced shares of a timeline from 5 to 95 per cent."""
    n = max(1, int(samples))
    return [0.05] if n == 1 else [0.05 + 0.90 * i / (n - 1) for i in range(n)]


def timeline_sample(frames: DataFrame, samples: int, *, key: str = "video_id", index: str = "frame_index"):
    """Frames at evenly spaced positions of each video; adds ``sample``. Frame indexes start at 0."""
    spots = F.array(
        *(
            F.struct(F.lit(i).alias("sample"), F.bround(F.lit(p) * (F.col("_n") - 1)).cast("long").alias(index))
            for i, p in enumerate(timeline_positions(samples))
        )
    )
    wanted = (
        frames.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).select(key, F.explode(spots).alias("_spot"))
        .select(key, "_spot.sample", f"_spot.{index}")
    )
    return frames.join(wanted, [key, index])


def metric_summary(df: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = ()) -> DataFrame:
    """count, mean, population deviation and interpolated p95 per metric, at six decimals; one row per key.

    The metrics are turned into rows, so all of them share the same passes over the data.
    """
    keys = list(keys)
    long = df.select(
        *keys,
        F.explode(
            F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns))
        ).alias("_m"),
    ).select(*keys, "_m.metric", "_m.value")
    parts = ("count", "mean", "std")
    stats = long.groupBy(*keys, "metric").agg(
        F.count("value").alias("count"), F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.stddev_pop("value"), 6).alias("std"),
    )
    p95 = exact_percentile(long, [*keys, "metric"], "value", 0.95, "p95").withColumn("p95", F.round("p95", 6))
    joined = stats.join(p95, [*keys, "metric"], "left")
    of = lambda metric, part: F.max(F.when(F.col("metric") == metric, F.col(part)))
    return joined.groupBy(*keys).agg(
        *(of(c, part).alias(f"{c}_{part}") for c in columns for part in (*parts, "p95"))
    )


QUALITY_METRICS = (
    "identity_similarity", "normalized_landmark_error", "outside_mask_mae", "temporal_frame_delta",
    "chunk_boundary_jump_ratio",
)


def quality_report(frames: DataFrame, *, key: str = "video_id") -> DataFrame:
    """One row per video with a {count, mean, std, p95} struct per quality metric."""
    narrow = cut_lineage(frames.select(key, *QUALITY_METRICS))
    flat = metric_summary(narrow, QUALITY_METRICS, keys=[key])
    metric = lambda m: F.struct(*(F.col(f"{m}_{part}").alias(part) for part in ("count", "mean", "std", "p95")))
    return flat.select(key, *(metric(m).alias(m) for m in QUALITY_METRICS))


def pose_for_range(
    track: DataFrame, clips: DataFrame, *, key: str = "video_id", clip_keys: Sequence[str] = ("clip_index",)
) -> DataFrame:
    """Median yaw and pitch of each clip over its located, unambiguous frames; 0, 0 when there is none.

    Clips and frames meet in bins (``windows.in_bins``); a clip is at most one window long.
    """
    usable = track.filter(F.col("located") & ~F.col("ambiguous")).select(key, "frame_index", "yaw", "pitch")
    spans = clips.select(key, *clip_keys, "start_frame", "valid_frames")
    medians = in_bins(spans, usable, key=key).groupBy(key, *clip_keys).agg(
        F.percentile("yaw", F.lit(0.5)).alias("yaw"), F.percentile("pitch", F.lit(0.5)).alias("pitch")
    )
    zero = F.lit(0.0)
    return clips.join(medians, [key, *clip_keys], "left").withColumns(
        {"yaw": F.coalesce("yaw", zero), "pitch": F.coalesce("pitch", zero)}
    )


def track_summary(track: DataFrame, *, key: str = "video_id") -> DataFrame:
    """Coverage, ambiguity and instance counts per video. The cut positions are rows: see ``cut_list``."""
    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    share = lambda condition: F.sum(F.when(condition, 1).otherwise(0)) / n
    return track.groupBy(key).agg(
        F.count(F.lit(1)).alias("frames"),
        share(F.col("located")).alias("coverage"),
        share(F.col("ambiguous")).alias("ambiguous_ratio"),
        F.avg("n_instances").alias("average_instances"),
        F.max("n_instances").alias("max_instances"),
        F.sum(F.when(F.col("n_instances") > 1, 1).otherwise(0)).alias("multi_instance_frames"),
        F.sum(F.col("scene_cut").cast("long")).alias("scene_cuts"),
    )


def cut_list(track: DataFrame, *, key: str = "video_id") -> DataFrame:
    return track.filter(F.col("scene_cut")).select(key, F.col("frame_index").alias("cut"))


