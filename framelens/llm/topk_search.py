"""Exact top-k search by inner product, in three phases with a uniform threshold.

A vector's components are dealt to ``SLICES`` lists by position; its score for a query is the sum of its local scores,
one a list. A list of a block of candidates is a node.

1. Every node sends its best local entries per query. The whole scores of these few candidates give a score that k
   candidates reach: a safe cutoff, since the k-th best can only be higher.
2. A candidate whose local scores are all under cutoff / SLICES is under the cutoff. Nodes get the cutoff of each query
   and send the entries that reach that share, all of them.
3. Entries are joined per candidate; where the known local scores, and the share for the unknown ones, cannot reach the
   cutoff, the candidate goes. What is left is scored as a whole and ranked.

Queries are the stated set and meet all rows in blocks of ``BLOCK`` queries and ``BLOCK`` candidates. Equal vectors
are one candidate that remembers its k + 1 smallest ids (one may be the query's own), and one query, so copies and zero
vectors cost no more than others. Nothing but rows moves: no list, cutoff or score passes through the driver.

Vectors so long that sums of their products may leave a long take no part in these phases. Their pairs are scored with
Python's integers, block by block; each block of candidates sends the k best of a query.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import outer_id, save, sorted_groups
from framelens.llm.vectors import matrix, one_vector_per_id, usable

K, EVERY, SCALE = 5, 50, 256
SLICES, BLOCK = 2, 4096
#: Two vectors under this length have an inner product, and partial sums of it, that fit a long.
LONGEST = 2.0**31
#: Candidates and queries of a block scored with Python's integers.
LONG_BLOCK = 512
#: Where a score does not fit a long, components beyond this count as this in the score shown (not in the rank).
LARGEST = 1 << 28


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole-number inner products; by floating point where that is exact."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    return (q @ c.T).astype(np.int64) if top < 2**53 else q.astype(np.int64) @ c.astype(np.int64).T


def _nodes(classes: DataFrame) -> DataFrame:
    """Rows of every node: ``qb, cb, slice, role, id, v`` (the slice's components), queries repeated per candidate block."""
    n = classes.agg(F.count("*").alias("c"), F.count_if("asks").alias("q"), F.max(F.size("v")).alias("w")).first()
    query_blocks, candidate_blocks = max(1, -(-n["q"] // BLOCK)), max(1, -(-n["c"] // BLOCK))
    qb, cb = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)), F.pmod(F.xxhash64("id"), F.lit(candidate_blocks))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = classes.where("asks").select(qb.alias("qb"), numbers(candidate_blocks).alias("cb"), F.lit(0).alias("role"), "id", "v")
    given = classes.select(numbers(query_blocks).alias("qb"), cb.alias("cb"), F.lit(1).alias("role"), "id", "v")
    sliced = asked.unionByName(given).withColumn("slice", F.explode(F.array(*map(F.lit, range(SLICES)))))
    width = max(1, -(-(n["w"] or 0) // SLICES))
    return sliced.withColumn("v", F.slice("v", F.col("slice") * width + 1, F.lit(width)))


def _at_nodes(rows: DataFrame, chosen, cutoffs: DataFrame | None = None) -> DataFrame:
    """``query, id, slice, score`` of the entries that ``chosen(scores, shares)`` picks at each node."""
    rows = rows.withColumn("share", F.lit(None).cast("double")) if cutoffs is None else rows.join(cutoffs.withColumnsRenamed({"query": "of"}), (F.col("role") == 0) & (F.col("id") == F.col("of")), "left").drop("of")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ("qb", "cb", "slice")):
            role, ids = group.column("role").to_numpy(), group.column("id").to_numpy()
            asks, gives = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
            if not len(asks) or not len(gives):
                continue
            x = matrix(group.column("v"), int(max(group.column("v").value_lengths().to_numpy().max(), 1)))
            share = group.column("share").to_numpy(zero_copy_only=False)
            c = x[gives]
            for s in range(0, len(asks), 256):
                some = asks[s : s + 256]
                scores = _products(x[some], c)
                q, j = chosen(scores, share[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some[q]]), pa.array(ids[gives[j]]), pa.array(np.full(len(q), group.column("slice")[0].as_py(), np.int32)), pa.array(scores[q, j])],
                    names=["query", "id", "slice", "score"],
                )

    keyed = rows.select("qb", "cb", "slice", "role", "id", "v", "share").repartition("qb", "cb", "slice").sortWithinPartitions("qb", "cb", "slice")
    return keyed.mapInArrow(task, "query long, id long, slice int, score long")


def _best(scores: np.ndarray, _) -> tuple[np.ndarray, np.ndarray]:
    """The k + 1 best entries of each query at this node (one may be the query itself)."""
    k = min(K + 1, scores.shape[1])
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(len(scores)), k), best.reshape(-1)


def _reaching(scores: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(scores >= np.where(np.isnan(share), -np.inf, share)[:, None])


def _whole(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``query, id, score, ids`` with the whole scores of ``query, id``."""
    vectors = classes.select(F.col("id").alias("of"), F.col("v").alias("qv"))
    both = pairs.join(vectors, F.col("query") == F.col("of")).drop("of").join(classes.select("id", "v", "ids"), "id")
    product = F.aggregate(F.zip_with("qv", "v", lambda a, b: F.coalesce(a * b, F.lit(0)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return both.select("query", "id", product.alias("score"), "ids")


def _members(scored: DataFrame, asking: DataFrame) -> DataFrame:
    """Per query id: candidates by id, without the query's own."""
    opened = scored.select("query", "score", F.explode("ids").alias("vec_id"))
    return opened.join(asking, "query").where("vec_id <> query_id")


def _long_scores(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score, over, beyond`` of the ``k`` best candidates of each query in each block, from ``_id, v`` (components as given).

    ``over``: 1 and -1 where the true score is above and below a long; ``beyond`` then holds it as ordered bytes.
    """
    blocks = lambda df: max(1, -(-df.count() // LONG_BLOCK))
    query_blocks, candidate_blocks = blocks(queries), blocks(candidates)
    own = lambda n: F.pmod(F.xxhash64("_id"), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = queries.select(own(query_blocks).alias("qb"), every(candidate_blocks).alias("cb"), F.lit(0).alias("role"), "_id", "v")
    given = candidates.select(every(query_blocks).alias("qb"), own(candidate_blocks).alias("cb"), F.lit(1).alias("role"), "_id", "v")
    half = 1 << 2111  # above any sum of products of doubles times 256

    def whole(v: list[float]) -> list[int]:
        return [math.floor(x * SCALE) if abs(x) < 2.0**1000 else int(x) * SCALE for x in v]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ("qb", "cb")):
            role, ids, v = group.column("role").to_pylist(), group.column("_id").to_pylist(), [whole(x) for x in group.column("v").to_pylist()]
            held = lambda x: [max(-LARGEST, min(LARGEST, c)) for c in x]
            gives = [j for j, r in enumerate(role) if r]
            out = []
            for i in (i for i, r in enumerate(role) if not r):
                best = heapq.nsmallest(k, ((-sum(a * b for a, b in zip(v[i], v[j])), ids[j], j) for j in gives if ids[j] != ids[i]))
                for lost, vec_id, j in best:
                    over = (-lost >= 2**63) - (-lost < -(2**63))
                    shown = max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(held(v[i]), held(v[j]))))) if over else -lost
                    out.append((ids[i], vec_id, shown, over, (half - lost).to_bytes(264, "big") if over else None))
            columns = list(zip(*out)) if out else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["query_id", "vec_id", "score", "over", "beyond"])

    keyed = asked.unionByName(given).repartition("qb", "cb").sortWithinPartitions("qb", "cb")
    return keyed.mapInArrow(task, "query_id long, vec_id long, score long, over int, beyond binary")


def _search(points: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score, rank`` by the three phases, of saved ``_id, v`` (whole numbers), ``asks``."""
    # the k + 1 smallest ids of equal vectors, by partial sorting in the aggregate's window
    place = F.row_number().over(Window.partitionBy("v").orderBy("_id"))
    smallest = points.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("v").agg(F.min("_id").alias("id"), F.sort_array(F.collect_list("_id")).alias("ids"))
    asking = points.where("asks")
    classes = save(smallest.join(asking.select(F.col("v").alias("_v")).distinct(), F.col("v") == F.col("_v"), "left").select("id", "v", "ids", F.col("_v").isNotNull().alias("asks")), "topk-classes")
    asking = save(asking.join(classes.select(F.col("id").alias("query"), F.col("v").alias("_v")), F.col("v") == F.col("_v")).select(F.col("_id").alias("query_id"), "query"), "topk-asking")
    nodes = _nodes(classes)

    first = _whole(_at_nodes(nodes, _best).select("query", "id").distinct(), classes)
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    kth = _members(first, asking).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k)
    # queries of one class share the lowest cutoff of theirs; without k candidates there is none
    counted = asking.groupBy("query").agg(F.count("*").alias("n"))
    cutoffs = kth.groupBy("query").agg(F.min("score").alias("cutoff"), F.count("*").alias("found")).join(counted, "query").where("found = n")
    cutoffs = save(cutoffs.select("query", "cutoff", (F.col("cutoff") / SLICES).alias("share")), "topk-cutoffs")

    entries = _at_nodes(nodes, _reaching, cutoffs.select("query", "share"))
    joined = entries.groupBy("query", "id").agg(F.sum("score").alias("known"), F.count("*").alias("lists")).join(cutoffs, "query", "left")
    reach = F.col("known") + (SLICES - F.col("lists")) * F.col("share")
    left = joined.where(F.col("cutoff").isNull() | (reach >= F.col("cutoff"))).select("query", "id")
    return _members(_whole(left, classes), asking).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def search(embeddings: DataFrame, *, k: int = K, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of each query, ties to the smaller id, fewer if there are fewer.

    Queries: rows whose ``vec_id`` is divisible by ``every``; candidates: every other row. Components are
    ``floor(256 * x)`` in double precision; a shorter vector counts as filled with zeros. Ranks follow the true scores.
    A score that does not fit a long is shown with its components held within +-2**28; all others are exact. Null
    vectors and those with null or non-finite components take no part. Rows that share an id count as one (the largest
    vector stays). A null id is a candidate, the smallest, and no query. Other columns are not read; an empty table gives
    no rows.
    """
    rows = one_vector_per_id(embeddings)
    asks = (F.pmod(F.col("_id"), F.lit(every)) == 0) & outer_id().isNotNull()
    length2 = F.aggregate("v", F.lit(0.0), lambda total, x: total + (F.abs(x) * SCALE + 1) * (F.abs(x) * SCALE + 1))
    sound = rows.where(usable("v")).select("_id", "v", asks.alias("asks"), (length2 >= LONGEST**2).alias("long"))
    whole = F.transform("v", lambda x: F.floor(x * SCALE).cast("long"))
    ranked = _search(save(sound.where("not long").select("_id", whole.alias("v"), "asks"), "topk-points"), k)
    if not sound.where("long").limit(1).isEmpty():
        sound = save(sound, "topk-sound")
        long, others = sound.where("long"), sound.where("not long and asks")
        found = _long_scores(long.where("asks"), sound, k).union(_long_scores(others, long, k))
        both = ranked.select("query_id", "vec_id", "score", F.lit(0).alias("over"), F.lit(None).cast("binary").alias("beyond")).union(found)
        by_score = Window.partitionBy("query_id").orderBy(F.col("over").desc(), F.col("beyond").desc(), F.when(F.col("over") == 0, F.col("score")).desc(), "vec_id")
        ranked = both.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), outer_id("vec_id").alias("vec_id"), "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
