"""Ordered computations over long sequences without putting a whole sequence into one task.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task, which fails when one video or run
holds a large share of the table. Here every key is cut into buckets of its order column. Rows are shuffled
by (key, bucket); only one summary row per (key, bucket) is ordered by key alone, and its carry value is
joined back. Hot keys therefore spread over the cluster, and the big table is shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from framelens.session import bounded

FRAMES_PER_BUCKET = 4096
BUCKET, KEY = "_bucket", "_key_of_row"
NO_ORDER = -(2**62)
#: Rows of a key that stay in one bucket, and buckets a heavier key is cut into.
BUCKET_ROWS, MOST_BUCKETS = 1 << 18, 256


def frame_bucket(index: Column | str, size: int = FRAMES_PER_BUCKET) -> Column:
    column = F.col(index) if isinstance(index, str) else index
    return F.floor(column / F.lit(size)).cast("long")


def time_bucket(ts: Column | str, seconds: int = 86400) -> Column:
    """For TIMESTAMP columns, of either kind."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(column.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def even_buckets(df: DataFrame, keys: Sequence[str], value: Column, name: str, *, depth: int = BUCKET_ROWS) -> DataFrame:
    """Add a bucket of about equal depth that never decreases along ``value``, a number; for use as ``bucket`` below.

    Keys of at most ``depth`` rows are one bucket, so they cost nothing but a count. Heavier ones are cut at quantiles of a
    mergeable sketch, however their rows crowd together; only equal values stay together.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.withColumns({KEY: key, "_value": value})
    heavy = bounded(rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > depth).drop("_n"))
    if heavy.isEmpty():
        return df.withColumn(name, F.lit(0).cast("long"))
    shares = [i / MOST_BUCKETS for i in range(1, MOST_BUCKETS)]
    borders = rows.join(heavy, KEY).groupBy(KEY).agg(F.array_distinct(F.percentile_approx("_value", shares, 20 * MOST_BUCKETS)).alias("_borders"))
    cut = rows.join(bounded(borders), KEY, "left")
    passed = F.size(F.filter("_borders", lambda b: b < F.col("_value")))
    return cut.withColumn(name, F.when(F.col("_borders").isNotNull(), passed).otherwise(F.lit(0)).cast("long")).select(*df.columns, name)


def _order(order: str | Sequence[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def in_bucket(order: str | Sequence[str]):
    """Over rows of ``with_carry``, which lie by key and bucket already."""
    return Window.partitionBy(KEY, BUCKET).orderBy(*_order(order))


def with_carry(
    df: DataFrame, keys: Sequence[str], bucket: Column, summaries: dict[str, Column],
    carries: Callable[[object], dict[str, Column]],
) -> DataFrame:
    """Add the key as one column, ``_bucket`` and one column per carry, computed from the summaries of earlier buckets.

    ``carries`` receives the window over a key's earlier buckets, in order, the current one excluded. Null keys
    are a key like others; rows without an order value have a bucket of their own, before all others.

    The keys are packed into a struct, which is never null itself, so grouping, join and windows share one partitioning
    and the join is a plain equality.
    """
    packed = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    cut = df.withColumns({BUCKET: F.coalesce(bucket, F.lit(NO_ORDER)), KEY: packed})
    per_bucket = cut.groupBy(KEY, BUCKET).agg(*(agg.alias(name) for name, agg in summaries.items()))
    earlier = Window.partitionBy(KEY).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(KEY, BUCKET, *(value.alias(name) for name, value in carries(earlier).items()))
    return cut.join(carried, [KEY, BUCKET])


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, which ``right`` has under the names ``_of_<key>``; null equals null."""
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    return left.join(right, same, how).drop(*(f"_of_{c}" for c in keys))


def ordered_index(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], bucket: Column, name: str = "idx"
) -> DataFrame:
    """Zero-based position of each row in its key. ``bucket`` must not decrease along ``order``."""
    carried = with_carry(
        df, keys, bucket, {"_bucket_rows": F.count(F.lit(1))},
        lambda w: {"_rows_before": F.coalesce(F.sum("_bucket_rows").over(w), F.lit(0))},
    )
    position = F.row_number().over(in_bucket(order)) - 1 + F.col("_rows_before")
    return carried.withColumn(name, position.cast("long")).drop(KEY, BUCKET, "_rows_before")


def ordered_running_sums(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], bucket: Column, values: dict[str, Column],
) -> DataFrame:
    """Running sums, the row itself included, under new names; give integer values for exact results."""
    total, before, own = "_total_{}".format, "_before_{}".format, "_own_{}".format
    carried = with_carry(
        df.withColumns({own(n): v for n, v in values.items()}), keys, bucket,
        {total(n): F.sum(own(n)) for n in values},
        lambda w: {before(n): F.coalesce(F.sum(total(n)).over(w), F.lit(0)) for n in values},
    )
    frame = in_bucket(order).rowsBetween(Window.unboundedPreceding, 0)
    running = {n: F.coalesce(F.sum(own(n)).over(frame), F.lit(0)) + F.col(before(n)) for n in values}
    return carried.withColumns(running).drop(KEY, BUCKET, *(c(n) for n in values for c in (before, own)))


def ordered_running_sum(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], bucket: Column, value: Column, name: str
) -> DataFrame:
    return ordered_running_sums(df, keys, order, bucket, {name: value})


def ordered_lag(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], bucket: Column, columns: dict[str, Column]
) -> DataFrame:
    """Values of the row before, under new names; null on the first row of a key."""
    packed = F.struct(*(value.alias(name) for name, value in columns.items()))
    marker = F.struct(*_order(order))
    carried = with_carry(
        df.withColumn("_now", packed), keys, bucket, {"_last": F.max_by("_now", marker)},
        lambda w: {"_before": F.last("_last").over(w)},
    )
    within = in_bucket(order)
    first = F.row_number().over(within) == 1
    previous = F.when(first, F.col("_before")).otherwise(F.lag("_now").over(within))
    out = carried.withColumn("_previous", previous)
    return out.select(
        *(c for c in df.columns), *(F.col("_previous")[name].alias(name) for name in columns)
    )


def ordered_last_value(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], bucket: Column, value: Column, name: str,
    *, inclusive: bool = True,
) -> DataFrame:
    """Latest non-null value up to (or strictly before) each row."""
    marker = F.when(F.col("_value").isNotNull(), F.struct(*_order(order)))
    carried = with_carry(
        df.withColumn("_value", value), keys, bucket, {"_last": F.max_by("_value", marker)},
        lambda w: {"_before": F.last("_last", ignorenulls=True).over(w)},
    )
    frame = in_bucket(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    latest = F.coalesce(F.last("_value", ignorenulls=True).over(frame), F.col("_before"))
    return carried.withColumn(name, latest).drop(KEY, BUCKET, "_before", "_value")


def ordered_recent(
    df: DataFrame, keys: Sequence[str], index: str, value: Column, name: str, *, count: int,
    size: int = FRAMES_PER_BUCKET,
) -> DataFrame:
    """Array of up to ``count`` values strictly before each row, oldest first.

    ``index`` is an integer order column with few rows per value and ``value`` is never null: drop the rows
    without a value first, as they neither need nor feed the history.
    """
    newest = F.slice(
        F.sort_array(F.collect_list(F.struct(F.col(index).alias("at"), F.col("_value").alias("v"))), asc=False),
        1, count,
    )
    tail = F.reverse(F.transform(newest, lambda item: item["v"]))
    # Every summarised bucket holds a row, so ``count`` buckets always hold ``count`` values.
    carried = with_carry(
        df.withColumn("_value", value), keys, frame_bucket(index, size), {"_tail": tail},
        lambda w: {"_before": F.flatten(F.collect_list("_tail").over(w.rowsBetween(-count, -1)))},
    )
    inside = F.collect_list("_value").over(in_bucket(index).rowsBetween(-count, -1))
    recent = F.concat(F.col("_before"), inside)
    recent = F.when(F.size(recent) > count, F.slice(recent, -count, count)).otherwise(recent)
    return carried.withColumn(name, recent).drop(KEY, BUCKET, "_before", "_value")


def fold_sorted(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
    start: Callable[[tuple], object], step: Callable[[object, tuple], Iterable[tuple]], schema: str,
    *, finish: Callable[[object], Iterable[tuple]] | None = None,
) -> DataFrame:
    """Fold each key's rows in order; ``step`` gets the values of ``columns`` and returns output rows.

    Rows reach Python sorted, in Arrow batches, so a task holds one batch and one state however long a key is. Whole
    numbers keep their precision; a null among floats is NaN on the way in, and NaN is null on the way out.
    """
    width = len(keys)
    picked = [*keys, *columns]
    made = to_arrow_schema(StructType.fromDDL(schema))

    def values(column: pa.Array) -> list:
        return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_floating(column.type) else column.to_pylist()

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(zip(*out), made)], schema=made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = state = None
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*map(values, batch.columns)):
                key = row[:width]
                if key != current:
                    if current is not None and finish is not None:
                        out.extend(finish(state))
                    current, state = key, start(key)
                out.extend(step(state, row[width:]))
                if len(out) >= 10_000:
                    yield packed(out)
                    out = []
            if out:
                yield packed(out)
                out = []
        if current is not None and finish is not None:
            out.extend(finish(state))
        if out:
            yield packed(out)

    arranged = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return arranged.select(*picked).mapInArrow(run, schema)
