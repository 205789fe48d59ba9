"""Vector code compression: product codes by k-means in whole numbers, exact at every step.

Components become whole numbers, vectors are cut into equal parts, and each part is replaced by the index of its codebook's
nearest entry. Distances are exact: whole numbers are broken into limbs so small that a float64 matrix product of two
limbs stays below 2 ** 53, the products are put together in int64, and the first least distance wins. Where even int64
could overflow (components beyond about 2 ** 28 units), the same limb products are put together as Python's whole numbers.

A round is one pass over the vectors: tasks assign and send, per part, entry and limb, one row of sums, so what is
shuffled and what the driver holds depends on the size of the codebooks alone. Sums of limbs need no more than int64 and
are put together on the driver. Vectors are never shuffled; what is written is one short row per vector.

Defined cases: vectors that are null or hold null or non-finite components are dropped. Vectors shorter than the longest
count as having zeros behind, up to a multiple of the number of parts. Rows that share an id, and rows with a null id, are
rows of their own; null ids come last in the order that picks the first codebooks, ties go by the vector. With fewer
vectors than entries codebooks have fewer entries. An error beyond a long, or a sum of errors, is null. An empty table
gives an empty result. Other columns are left behind.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import join_by_size, lean, save
from framelens.llm.vectors import matrix, usable

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors coded at once in a task.
BLOCK = 8192


# --- exact arithmetic -----------------------------------------------------------------------------------------------


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)``: int64 where it surely fits, else Python's whole numbers. ``scale`` is a power of two."""
    if not x.size or np.abs(x).max() < 2.0**61 / scale:
        return np.floor(x * scale).astype(np.int64)
    exact = [math.floor(v * scale) if abs(v) < 2.0**61 else int(v) * scale for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def largest(*arrays: np.ndarray) -> int:
    """The largest absolute value."""
    return max((max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size), default=0)


def limb_bits(width: int) -> int:
    """Bits of a limb: ``width`` products of two limbs add up to less than 2 ** 53."""
    return (52 - max(width - 1, 0).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """``x`` as sum of ``limb << (bits * k)``; all but the last lie in 0 .. 2 ** bits - 1, the last one keeps the sign."""
    count = max(1, -(-(largest(x) + 1).bit_length() // bits))
    out = [((x >> (bits * k)) & ((1 << bits) - 1)) for k in range(count - 1)]
    return [np.asarray(part, np.int64) for part in [*out, x >> (bits * (count - 1))]]


def products(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``x`` and of ``entries``, exact; in int64 where they fit."""
    bits = limb_bits(x.shape[1])
    fits = x.shape[1] * largest(x) * largest(entries) < 1 << 62
    out = np.zeros((len(x), len(entries)), np.int64 if fits else object)
    right = [limb.astype(np.float64) for limb in limbs(entries, bits)]
    for i, left in enumerate(limbs(x, bits)):
        left = left.astype(np.float64)
        for j, limb in enumerate(right):
            part = (left @ limb.T).astype(np.int64)
            out += (part if fits else part.astype(object)) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of every row, and its squared distance."""
    if x.shape[1] * (largest(x) + largest(entries)) ** 2 >= 1 << 62:
        x, entries = x.astype(object), entries.astype(object)
    distance = products(x, entries) * -2 + (entries * entries).sum(1)
    code = distance.argmin(1) if distance.dtype != object else np.array([min(range(len(row)), key=row.__getitem__) for row in distance.tolist()], np.int64)
    return code, distance[np.arange(len(x)), code] + (x * x).sum(1)


# --- codebooks ------------------------------------------------------------------------------------------------------


class Codebooks:
    """Entries by part, entry, position; whole numbers."""

    def __init__(self, entries: list[np.ndarray], scale: int = SCALE):
        self.entries, self.scale = entries, scale
        self.width = sum(book.shape[1] for book in entries)

    def sha256(self) -> str:
        numbers = (str(int(v)) for book in self.entries for v in book.ravel().tolist())
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()

    def split(self, vectors: pa.Array) -> list[np.ndarray]:
        """The parts of vectors as whole numbers."""
        rows = whole(matrix(vectors, self.width), self.scale)
        return np.split(rows, np.cumsum([book.shape[1] for book in self.entries])[:-1], axis=1)

    def decode(self, codes: list[str]) -> np.ndarray:
        """The vectors that codes stand for."""
        at = np.array([list(bytes.fromhex(code)) for code in codes], np.int64).reshape(len(codes), len(self.entries))
        return np.concatenate([book[at[:, i]] for i, book in enumerate(self.entries)], axis=1).astype(np.float64) / self.scale


def _vectors(df: DataFrame) -> DataFrame:
    return df.where(usable("embedding")).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def fit(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks after ``rounds`` of assignment and floored means; None without vectors. At most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("a code holds one byte a part: 1 to 256 entries")
    vectors = _vectors(df)
    longest = vectors.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    width = max(1, -(-longest // parts))
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = matrix(pa.array([row["v"] for row in first], pa.list_(pa.float64())), width * parts)
    books = Codebooks(np.split(whole(start, scale), parts, axis=1), scale)
    for _ in range(rounds):
        books = _moved(vectors, books)
    return books


def _moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry replaced by the floored mean of the parts assigned to it."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums, counts = shared.value, {}, {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                for part, x in enumerate(own.split(batch.column(0).slice(at, BLOCK))):
                    code, _ = nearest(x, own.entries[part])
                    used, code = np.unique(code, return_inverse=True)
                    for entry, n in zip(used.tolist(), np.bincount(code).tolist()):
                        counts[part, entry] = counts.get((part, entry), 0) + n
                    for k, limb in enumerate(limbs(x, limb_bits(x.shape[1]))):
                        total = np.zeros((len(used), x.shape[1]), np.int64)
                        np.add.at(total, code, limb)
                        for entry, row in zip(used.tolist(), total):
                            sums[part, entry, k] = sums.get((part, entry, k), 0) + row
        rows = [(p, e, k, i, v, counts[p, e]) for (p, e, k), row in sums.items() for i, v in enumerate(row.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)

    names, types = ["part", "entry", "limb", "place", "total", "n"], [pa.int32()] * 4 + [pa.int64()] * 2
    sent = vectors.select("v").mapInArrow(lean(task), "part int, entry int, limb int, place int, total long, n long")
    means = sent.groupBy("part", "entry", "limb", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    shared.unpersist()
    totals, counts = {}, {}
    for row in means:
        where = row["part"], row["entry"], row["place"]
        bits = limb_bits(books.entries[row["part"]].shape[1])
        totals[where] = totals.get(where, 0) + (int(row["total"]) << (bits * row["limb"]))
        if row["limb"] == 0:
            counts[where] = row["n"]
    moved = [book.astype(object) for book in books.entries]
    for (part, entry, place), total in totals.items():
        moved[part][entry, place] = total // counts[part, entry, place]
    return Codebooks([book if largest(book) >= 1 << 61 else book.astype(np.int64) for book in moved], books.scale)


def encode(df: DataFrame, books: Codebooks, keep: tuple[str, ...] = ()) -> DataFrame:
    """``vec_id, code, error`` and the columns to ``keep``: two hex digits a part, and the squared error in whole units."""
    rows = df.where(usable("embedding")).select("vec_id", *keep, F.col("embedding").cast("array<double>").alias("v"))
    held = df.sparkSession.sparkContext.broadcast(books)
    schema = rows.drop("v").schema.add("code", "string").add("error", "long")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                codes, error = np.zeros((block.num_rows, len(own.entries)), np.uint8), 0
                for part, x in enumerate(own.split(block.column(block.num_columns - 1))):
                    codes[:, part], off = nearest(x, own.entries[part])
                    error = error + (off if largest(off) < (1 << 62) // len(own.entries) else off.astype(object))
                text = codes.tobytes().hex()
                size = 2 * len(own.entries)
                fits = [e if e < 1 << 63 else None for e in error.tolist()]
                yield pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array([text[i : i + size] for i in range(0, len(text), size)]), pa.array(fits, pa.int64())], names=schema.names)

    return rows.mapInArrow(lean(task), schema)


def report(df: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable vector."""
    books = fit(df)
    if books is None:
        return df.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = encode(df, books, ("label",)).select("vec_id", "code", "error", F.col("label").isNull().alias("unlabelled"), F.coalesce("label", F.lit(0)).alias("label"))
    coded = save(coded, "vector-codes")
    keys = ["label", "unlabelled"]
    whole_sum = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")))
    sums = save(coded.groupBy(*keys).agg(whole_sum.alias("total")), "vector-label-errors")
    return join_by_size(coded, sums, keys).select("vec_id", "code", "error", F.expr("try_cast(total AS BIGINT)").alias("label_error"), F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds written out, over one row per vector, part and position."""
    steps = [f"""cells AS MATERIALIZED (
  SELECT vec_id, part, place, list_extract(w, part * (len(w) // {PARTS}) + place + 1) AS x
  FROM whole, unnest(range({PARTS})) AS p(part), unnest(range(len(w) // {PARTS})) AS s(place)
), book0 AS MATERIALIZED (
  SELECT part, entry, place, x FROM cells JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM whole QUALIFY entry < {ENTRIES}) USING (vec_id)
)"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
  SELECT vec_id, part, min({{'d': d, 'entry': entry}}) AS best
  FROM (SELECT vec_id, part, entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM cells c JOIN book{i} b USING (part, place) GROUP BY ALL) GROUP BY ALL
)""")
        if i < ROUNDS:
            steps.append(f"""mean{i} AS (
  SELECT part, best.entry AS entry, place, CAST(sum(x) AS HUGEINT) AS total, count(*) AS n FROM cells JOIN near{i} USING (vec_id, part) GROUP BY ALL
), book{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, CASE WHEN m.n IS NULL THEN b.x ELSE CAST((m.total - ((m.total % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS x
  FROM book{i} b LEFT JOIN mean{i} m ON m.part = b.part AND m.entry = b.entry AND m.place = b.place
)""")
    return f"""
WITH whole AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), {", ".join(steps)},
coded AS (
  SELECT vec_id, string_agg(lpad(printf('%x', best.entry), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN whole USING (vec_id)
"""


SQL = _sql()
