"""Shared helpers: written tables, unique ids, Arrow text as NumPy arrays, hashes, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.session import scratch_path

#: White space of every contract here, as bytes.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
NO_ID = -(2**63)
_MASK_ID = "_id"


# --- written tables -------------------------------------------------------------------------------------------------


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it again: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    saved = df.sparkSession.read.schema(df.schema).parquet(path)
    saved._written_at = path
    return saved


def forget(*tables: DataFrame) -> None:
    """Delete written tables that no later result reads."""
    for table in tables:
        path = getattr(table, "_written_at", None)
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


# --- documents ------------------------------------------------------------------------------------------------------


def one_row_per_id(df: DataFrame, key: str, value: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``_id`` (long, never null), ``value`` and those to ``keep``, one row per id.

    A null id counts as one more id. Of rows that share an id, the one with the greatest value stays (null is the
    least; then the columns kept decide). Where no id repeats, no value is shuffled: only the ids are counted.
    """
    ids = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias(_MASK_ID)
    rows = df.select(ids, F.col(value).alias("value"), *keep)
    repeated = df.select(ids).groupBy(_MASK_ID).count().where("count > 1").limit(1)
    if repeated.isEmpty():
        return rows
    return rows.groupBy(_MASK_ID).agg(F.max(F.struct("value", *keep)).alias("row")).select(_MASK_ID, "row.*")


def outer_id(column: str = _MASK_ID) -> Column:
    """The id as given: null where it was null."""
    return F.when(F.col(column) != F.lit(NO_ID), F.col(column))


def join_by_size(rows: DataFrame, table: DataFrame, keys: list[str], limit: int = 20_000) -> DataFrame:
    """``rows`` joined with a table of one row per key, safe for hot keys. Both are written tables, keys are not null.

    A table of at most ``limit`` rows and 16 MB of key text is broadcast. Of a larger one only the keys that hold over a
    thousandth of all rows are, which are under a thousand; the rest is shuffled, no key of it being hot.
    """
    text = [F.octet_length(k) for k, kind in table.dtypes if k in keys and kind == "string"]
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(sum(text, F.lit(0))), F.lit(0)).alias("bytes")).first()
    if size["n"] <= limit and size["bytes"] <= 16 << 20:
        return rows.join(F.broadcast(table), keys)
    counts = rows.groupBy(*keys).count()
    hot = save(counts.where(F.col("count") > rows.count() / 1000).select(*keys), "hot-keys")
    few = table.join(F.broadcast(hot), keys, "left_semi")
    rest = rows.join(F.broadcast(hot), keys, "left_anti").join(table.hint("shuffle_merge"), keys)
    return rows.join(F.broadcast(few), keys).unionByName(rest)


# --- Arrow text as arrays -------------------------------------------------------------------------------------------


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, and their offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    content = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return content[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs_of_documents(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive documents of about ``limit`` bytes; a longer document stands alone."""
    first, count = 0, len(offsets) - 1
    while first < count:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, last
        first = last


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of every ``[^\\x20\\x09-\\x0D]+`` word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_IS_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    before[cuts], after[cuts - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def lean(task):
    """A task that hands freed memory back at its end, since Python workers are kept and used again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run


# --- hashes ---------------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RATE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < count:
        size = 1 << max(16, (count - 1).bit_length())
        for i, rate in enumerate((_RATE, pow(_RATE, -1, 1 << 64))):
            steps = np.full(size, rate, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


class SpanHashes:
    """64-bit hashes of any byte spans of one array, by prefix sums of a polynomial over mixed byte values."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        up, self.down = _powers(len(data) + 1)
        values = (_BYTE[_LOWER] if lower else _BYTE)[data]
        values *= up[: len(data)]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


# --- a bounded filter of ids ----------------------------------------------------------------------------------------


class IdFilter:
    """A bitmap of fixed size (``2 ** 23`` bits, 1 MB) that says "perhaps" for every id put in.

    It spares shipping texts that no one asks for. Beyond some millions of ids it fills up and spares little, but
    never loses an id: an exact join always follows.
    """

    BITS = 23

    def __init__(self, ids: DataFrame, column: str):
        word = F.pmod(F.xxhash64(column), F.lit(1 << self.BITS))
        rows = (
            ids.select(word.alias("word")).selectExpr("shiftright(word, 6) AS at", "shiftleft(1L, cast(word % 64 AS int)) AS bit")
            .groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()
        )
        bits = np.zeros(1 << (self.BITS - 6), np.int64)
        for row in rows:
            bits[row["at"]] = row["bits"]
        self.bits = ids.sparkSession.sparkContext.broadcast(bits)

    def hashed(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with a last column for ``select``."""
        return df.withColumn("_filter", F.pmod(F.xxhash64(column), F.lit(1 << self.BITS)))

    @staticmethod
    def select(bits, batch: pa.RecordBatch, may: bool = True) -> pa.RecordBatch:
        """In a task: the rows whose id may be in (or cannot be), without the last column. ``bits`` is the broadcast."""
        at = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
        yes = pa.array(((bits.value[at >> 6] >> (at & 63)) & 1 == 1) == may)
        return pa.RecordBatch.from_arrays([c.filter(yes) for c in batch.columns[:-1]], names=batch.schema.names[:-1])

    def keep(self, df: DataFrame, column: str, may: bool = True) -> DataFrame:
        """Rows whose id may be in, or else those whose id cannot be."""
        bits, select = self.bits, self.select

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                some = select(bits, batch, may)
                if some.num_rows:
                    yield some

        return self.hashed(df, column).mapInArrow(task, df.schema)


# --- sorted rows ----------------------------------------------------------------------------------------------------


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], at_least: int = 1) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with equal keys (numbers, not null), one batch each, from a sorted partition.

    Groups of fewer than ``at_least`` rows come together with those that follow them.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        changed = np.zeros(whole.num_rows - 1, bool)
        for key in keys:
            values = whole.column(whole.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            changed |= values[1:] != values[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist()]
        a = 0
        for b in cuts[1:]:
            if b - a >= at_least:
                yield whole.slice(a, b - a)
                a = b
        held = [whole.slice(a)]
    yield from held


# --- connected components -------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``id, component_id`` of every id in ``edges (a, b)``: the smallest id reachable, itself included.

    Alternating large-star and small-star rounds, each one aggregate and one join on Spark; the edges of a round
    are written below the shared folder and those of the round before deleted. Null ends and loops are ignored.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    held = save(e, "edges")
    mark = _mark(held)
    while mark[0]:
        both = held.union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        middle = save(large, "edges")
        least = middle.groupBy("u").agg(F.min("v").alias("m"))
        near = middle.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = save(near.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(held, middle)
        held, last, mark = following, mark, _mark(following)
        if mark == last:
            break
    roots = held.select(F.col("v").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return held.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
