"""Identity analytics: reference banks, centroids, matching."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.functions import as_doubles, l2_norm, l2_normalize
from framelens.operators.detections import FRAME
from framelens.session import bounded, cut_lineage

# Yaw ranges (degrees) a bank tries to cover: left, frontal, right.
YAW_BINS = ((-90.0, -18.0), (-18.0, 18.0), (18.0, 90.0))
BANK_BROADCAST_ROWS = 4096
BANK_BYTES = 32 << 20
#: Detections or references that one matrix product takes from a code or block; larger ones have several parts.
BLOCK_ROWS = 1 << 15


def identity_centroid(
    references: DataFrame, *, key: str = "identity_id", with_best: bool = True
) -> DataFrame:
    """Weight-averaged unit embedding per identity, with the reference of largest weight.

    Averaging runs per array position with partial aggregation; only one value per dimension is collected.
    """
    unit = references.select(key, "weight", l2_normalize("embedding").alias("_unit")).filter("_unit IS NOT NULL")
    per_dimension = (
        unit.select(key, "weight", F.posexplode("_unit").alias("_pos", "_x"))
        .groupBy(key, "_pos")
        .agg((F.sum(F.col("weight") * F.col("_x")) / F.sum("weight")).alias("_mean"))
    )
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("_pos", "_mean"))), lambda item: item["_mean"]
    )
    centroids = per_dimension.groupBy(key).agg(l2_normalize(ordered).alias("centroid"))
    if not with_best:
        return centroids
    best = references.groupBy(key).agg(
        F.max_by("ref_id", F.struct(F.col("weight"), -F.col("ref_id"))).alias("best_ref"),
        F.count(F.lit(1)).alias("n_refs"),
    )
    return centroids.join(best, key)


def diverse_references(references: DataFrame, limit: int, *, key: str = "identity_id") -> DataFrame:
    """Best reference per yaw range, then the best of the rest, ``limit`` per identity; adds ``bank_order``.

    Both rankings keep at most ``limit`` rows per group, so the ranking is cut before the shuffle.
    """
    if limit <= 0:
        return references.limit(0).withColumn("bank_order", F.lit(None).cast("int"))
    yaw_bin = F.coalesce(
        *(F.when((F.col("yaw") >= low) & (F.col("yaw") < high), F.lit(i)) for i, (low, high) in enumerate(YAW_BINS))
    )
    ranked_by = [F.col("quality").desc(), F.col("weight").desc(), F.col("ref_id").asc()]
    binned = references.withColumn("_bin", yaw_bin)
    leaders = (
        binned.filter(F.col("_bin").isNotNull())
        .withColumn("_rank", F.row_number().over(Window.partitionBy(key, "_bin").orderBy(*ranked_by)))
        .filter(F.col("_rank") == 1)
        .withColumn("_leads", F.lit(0))
    )
    overall = (
        binned.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*ranked_by)))
        .filter(F.col("_rank") <= limit)
        .withColumn("_leads", F.lit(1))
    )
    # A reference may be both; its place as a leader wins.
    merged = leaders.unionByName(overall).withColumn(
        "_copy", F.row_number().over(Window.partitionBy(key, "ref_id").orderBy("_leads"))
    )
    place = Window.partitionBy(key).orderBy(
        "_leads", F.when(F.col("_leads") == 0, F.col("_bin")), "_rank", "ref_id"
    )
    return (
        merged.filter(F.col("_copy") == 1)
        .withColumn("bank_order", F.row_number().over(place))
        .filter(F.col("bank_order") <= limit)
        .select(*references.columns, "bank_order")
    )


def pack_references(references: DataFrame, block: Column, *, vector: str = "embedding") -> DataFrame:
    """One row per block holding its references as an array of (ref_id, embedding, norm)."""
    entry = F.struct(
        F.col("ref_id"), as_doubles(vector).alias("v"), l2_norm(vector).alias("norm")
    )
    usable = references.filter(F.col(vector).isNotNull()).select(block.alias("_block"), entry.alias("_entry"))
    return usable.groupBy("_block").agg(F.sort_array(F.collect_list("_entry")).alias("_bank"))


def match_identity(
    detections: DataFrame, references: DataFrame, *, min_sim: float, k: int = 1, id_col: str = "det_id",
    keys: Sequence[str] | None = None, vector: str = "embedding", bank_rows: int = BANK_BROADCAST_ROWS,
    bank_bytes: int = BANK_BYTES, recall: float | None = None,
) -> DataFrame:
    """Top ``k`` references per detection with cosine at least ``min_sim``; adds ref_id, similarity, rank.

    A bank of at most ``bank_rows`` rows is packed into one array and scored inside each detection row, so
    the detections are never shuffled and no pair is ever emitted. A larger bank of at most ``BANK_BYTES`` goes to
    the tasks as a matrix, and each Arrow batch of detections is multiplied with it block by block. A bank
    beyond that is cut into blocks, as are the detections, and each pair of blocks is one matrix product in a task of
    its own; each keeps ``k`` matches per detection before the blocks are merged. All three give the same matches; the
    matrices compare similarities to twelve digits.

    ``keys`` names a detection; by default those of video_id, frame_index and ``id_col`` that are there, since
    ids start over in each frame.

    With ``recall`` (say 0.95) matches may be missed: detections only meet references that share one of several codes of
    signs of random projections (``SignCodes``), so many that a pair just at ``min_sim`` is found with that
    probability or a higher one. Similarities are exact. It pays for large banks and high thresholds; where the codes
    would not leave out half of the bank, matching is exact after all. Vectors of other lengths than the longest
    reference match nothing then.
    """
    keys = list(keys or [c for c in (*FRAME, id_col) if c in detections.columns])
    if recall is not None:
        near = _approximate_hits(detections, references, min_sim, k, keys, vector, recall)
        if near is not None:
            return near
    head = cut_lineage(references.select("ref_id", vector).limit(bank_rows + 1))
    if head.count() <= bank_rows:
        references = head
        packed = F.broadcast(pack_references(references, F.lit(0), vector=vector))
        arranged = detections.withColumn("_block", F.lit(0))
    elif (bank := _bank_matrix(references, vector, bank_bytes)) is not None:
        kept = [c for c in detections.columns if c != vector]
        scored = detections.withColumn("_hits", _batch_hits(bank, references, min_sim, k)(as_doubles(vector)))
        return _opened(scored, kept)
    else:
        return _block_hits(detections, references, min_sim, k, keys, vector)

    scored = _scored(arranged, packed, vector, min_sim, k)
    return _opened(scored, [c for c in detections.columns if c != vector])


def _scored(arranged: DataFrame, packed: DataFrame, vector: str, min_sim: float, k: int) -> DataFrame:
    """Rows with the best ``k`` hits of the packed references of their ``_block``."""

    def score(entry: Column) -> Column:
        product = F.aggregate(
            F.zip_with(F.col("_v"), entry["v"], lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x
        )
        return F.struct(
            (-(product / F.nullif(F.col("_norm") * entry["norm"], F.lit(0.0)))).alias("_distance"), entry["ref_id"].alias("ref_id")
        )

    usable = arranged.filter(F.col(vector).isNotNull()).withColumns(
        {"_v": as_doubles(vector), "_norm": l2_norm(vector)}
    ).filter(F.col("_norm") >= 1e-12)
    return usable.join(packed, "_block").withColumn(
        "_hits",
        F.slice(
            F.array_sort(
                F.filter(F.transform("_bank", score), lambda hit: hit["_distance"] <= -min_sim)
            ), 1, k,
        ),
    )


def _merged(detections: DataFrame, scored: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Best hits over all blocks: at most k a block and as many blocks as a row was sent to; keys may be null."""
    best = scored.filter(F.size("_hits") > 0).groupBy(*(F.col(c).alias(f"_of_{c}") for c in keys)).agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_hits")))), 1, k).alias("_hits")
    )
    return detections.join(best, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])


class SignCodes:
    """Codes of vectors: in each of ``tables``, the signs of ``bits`` random projections.

    Two vectors at an angle share a sign with probability 1 - angle / pi, so a code with that to the power of ``bits``, and
    some code of several with a probability that ``plan`` brings to the recall asked for. Lookups also try the code with
    its least certain sign turned, which finds more than planned.
    """

    def __init__(self, width: int, tables: int, bits: int, seed: int = 7):
        self.tables, self.bits = tables, bits
        self.planes = np.random.default_rng(seed).normal(size=(tables * bits, width))

    @staticmethod
    def plan(min_sim: float, recall: float, references: int, most_tables: int = 32) -> tuple[int, int] | None:
        """Tables and bits, or None where codes would not leave out half of the bank."""
        same = 1 - np.arccos(min(1.0, max(-1.0, min_sim))) / np.pi
        for bits in range(min(30, max(1, int(np.log2(max(references, 2) / 16)))), 0, -1):
            one = same**bits
            tables = 1 if one >= recall else int(np.ceil(np.log(1 - recall) / np.log(1 - one)))
            if tables <= most_tables:
                return (tables, bits) if 2 * tables / 2**bits <= 0.5 else None
        return None

    def of(self, vectors: pd.Series, probes: bool) -> pd.Series:
        """Codes, one per table, and if asked those with one sign turned; none for null, zero or odd-length vectors."""
        out = [[] for _ in range(len(vectors))]
        fits = [i for i, v in enumerate(vectors) if v is not None and len(v) == self.planes.shape[1]]
        for s in range(0, len(fits), 1024):
            rows = fits[s : s + 1024]
            side = (np.stack([np.asarray(vectors.iloc[i], float) for i in rows]) @ self.planes.T).reshape(len(rows), self.tables, self.bits)
            codes = ((side > 0) << np.arange(self.bits)).sum(2) + (np.arange(self.tables) << self.bits)
            if probes:
                codes = np.concatenate([codes, codes ^ (1 << np.abs(side).argmin(2))], axis=1)
            for i, found in zip(rows, codes.tolist()):
                out[i] = found
        return pd.Series(out)


def _approximate_hits(detections, references, min_sim, k, keys, vector, recall) -> DataFrame | None:
    if not 0 < recall < 1:
        raise ValueError("recall must lie between 0 and 1")
    usable = references.filter(F.col(vector).isNotNull())
    size = usable.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("w")).first()
    planned = SignCodes.plan(min_sim, recall, size["n"]) if size["n"] else None
    if planned is None:
        return None
    codes = references.sparkSession.sparkContext.broadcast(SignCodes(size["w"], *planned))
    own = F.pandas_udf(lambda v: codes.value.of(v, False), "array<long>")
    tried = F.pandas_udf(lambda v: codes.value.of(v, True), "array<long>")
    filed = _distinct(usable, vector, k).select("ref_id", vector, F.explode(own(as_doubles(vector))).alias("_code"))
    sent = detections.select(*keys, vector, F.explode(tried(as_doubles(vector))).alias("_code"))
    # Codes are few next to their rows; those with more rows than a product takes are cut into parts on both sides.
    parts = lambda rows, name: rows.groupBy("_code").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias(name)).filter(F.col(name) > 1)
    wide, tall = F.broadcast(cut_lineage(parts(filed, "_wide"))), F.broadcast(cut_lineage(parts(sent, "_tall")))
    whole = lambda name: F.coalesce(F.col(name), F.lit(1))

    def placed(rows, id_hash, own_part, other_part):
        split = rows.join(wide, "_code", "left").join(tall, "_code", "left")
        part, other = F.pmod(id_hash, whole(own_part)), F.explode(F.sequence(F.lit(0).cast("long"), whole(other_part) - 1))
        return split.withColumn(own_part, part).withColumn(other_part, other).withColumn("_cell", F.xxhash64("_code", "_wide", "_tall")).drop("_code", "_wide", "_tall")

    sides = placed(sent, F.xxhash64(*keys, F.lit(1)), "_tall", "_wide"), placed(filed, F.xxhash64("ref_id", F.lit(1)), "_wide", "_tall")
    groups = max(1, size["n"] * planned[0] // BLOCK_ROWS)
    return _merged_hits(detections, *sides, groups, min_sim, k, keys, vector)


def _distinct(references: DataFrame, vector: str, k: int) -> DataFrame:
    """Of equal vectors only the first ``k`` can be among the best ``k``."""
    first = F.row_number().over(Window.partitionBy(vector).orderBy("ref_id"))
    return references.withColumn("_first", first).filter(F.col("_first") <= k).drop("_first")


def _block_hits(detections, references, min_sim, k, keys, vector) -> DataFrame:
    """Exact: every block of detections meets every block of references of its width, in a task of its own."""
    usable = cut_lineage(_distinct(references.filter(F.col(vector).isNotNull()).select("ref_id", vector), vector, k))
    wide, tall = (-(-rows.count() // BLOCK_ROWS) for rows in (usable, detections))
    block = F.xxhash64(F.size(vector), "_wide", "_tall").alias("_cell")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long")))
    own = lambda n, *ids: F.pmod(F.xxhash64(*ids, F.lit(1)), F.lit(max(n, 1)).cast("long"))
    sent = detections.filter(F.col(vector).isNotNull()).select(*keys, vector, own(tall, *keys).alias("_tall"), every(wide).alias("_wide"))
    filed = usable.select("ref_id", vector, own(wide, "ref_id").alias("_wide"), every(tall).alias("_tall"))
    sides = sent.select(*keys, vector, block), filed.select("ref_id", vector, block)
    return _merged_hits(detections, *sides, None, min_sim, k, keys, vector)


def _merged_hits(detections, sent, filed, groups, min_sim, k, keys, vector) -> DataFrame:
    """Best hits of detections over the cells they were sent to; cells go to tasks in ``groups``, or each by itself."""
    group = lambda cell: (F.col(cell) if groups is None else F.pmod(cell, F.lit(groups))).alias("_group")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in sent.select(*keys).schema.fields]
    kind = filed.schema["ref_id"].dataType.simpleString()
    # Both sides may come from one table: names of their own keep them apart.
    sent = sent.select(*keys, F.col(vector).alias("_asked"), F.col("_cell").alias("_cell_of"))
    filed = filed.select(F.col("ref_id").alias("_ref"), F.col(vector).alias("_filed"), "_cell")
    score = _cell_hits(keys, min_sim, k)
    met = sent.groupBy(group("_cell_of")).cogroup(filed.groupBy(group("_cell")))
    scored = met.applyInArrow(score, ", ".join([*kinds, f"_hits array<struct<_distance:double,ref_id:{kind}>>"]))
    return _opened(_merged(detections, scored, keys, k), [c for c in detections.columns if c != vector])


def _units(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of equal length, and which are usable."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    with np.errstate(all="ignore"):
        norms = np.sqrt((x * x).sum(1))
        good = np.isfinite(norms) & (norms >= 1e-12)
        return x / norms[:, None], good


def _best(q: np.ndarray, r: np.ndarray, min_sim: float, k: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and similarity of the ``k`` best of ``r`` for each of ``q``, all unit vectors; ties to the first of ``r``.

    Products only propose; the similarity of a pair is summed by itself and thus does not depend on the block.
    """
    found = []
    for s in range(0, len(q), 1024):
        x = q[s : s + 1024]
        least, row, col, sim = np.full(len(x), float(min_sim)), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for b in range(0, len(r), block):
            y = r[b : b + block]
            scores = x @ y.T
            limit = least
            if not b and len(y) > k:  # later blocks are held against what was found so far
                limit = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
            i, c = np.nonzero(scores >= (limit - 1e-11)[:, None])
            if not len(i):
                continue
            exact = np.concatenate([(x[i[p : p + 65536]] * y[c[p : p + 65536]]).sum(1) for p in range(0, len(i), 65536)])
            near = exact >= min_sim
            row, col, sim = np.append(row, i[near]), np.append(col, c[near] + b), np.append(sim, exact[near])
            order = np.lexsort((col, -np.round(sim, 12), row))
            row, col, sim = row[order], col[order], sim[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            last = place == k - 1
            least[row[last]] = sim[last]
            row, col, sim = row[place < k], col[place < k], sim[place < k]
        found.append((row + s, col, sim))
    return tuple(np.concatenate([f[n] for f in found]) for n in range(3)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _cell_hits(keys: list[str], min_sim: float, k: int):
    """Hits of a group's detections among the references of the same cell."""

    def score(sent: pa.Table, filed: pa.Table) -> pa.Table:
        sent, filed = sent.sort_by("_cell_of"), filed.sort_by([("_cell", "ascending"), ("_ref", "ascending")])
        cells = [sent.column("_cell_of").to_numpy(), filed.column("_cell").to_numpy()]
        rows, cols, sims = [], [], []
        for cell in np.intersect1d(*cells).tolist():
            (a, b), (c, d) = ([int(np.searchsorted(x, cell, side)) for side in ("left", "right")] for x in cells)
            (q, good), (r, fine) = _units(sent.column("_asked").slice(a, b - a)), _units(filed.column("_filed").slice(c, d - c))
            if q.shape[1] != r.shape[1]:
                continue
            row, col, sim = _best(q[good], r[fine], min_sim, k)
            rows.append(np.flatnonzero(good)[row] + a)
            cols.append(np.flatnonzero(fine)[col] + c)
            sims.append(sim)
        row, col, sim = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols, sims))
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
        hit = pa.StructArray.from_arrays([pa.array(-np.round(sim.astype(np.float64), 12)), filed.column("_ref").combine_chunks().take(pa.array(col))], names=["_distance", "ref_id"])
        hits = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), hit)
        return pa.table([*(sent.column(x).take(pa.array(row[first])) for x in keys), hits], names=[*keys, "_hits"])

    return score


def _opened(scored: DataFrame, kept: list[str]) -> DataFrame:
    return scored.select(*kept, F.posexplode("_hits").alias("_pos", "_hit")).select(
        *kept, F.col("_hit.ref_id").alias("ref_id"), (-F.col("_hit._distance")).alias("similarity"),
        (F.col("_pos") + 1).alias("rank"),
    )


def _bank_matrix(references: DataFrame, vector: str, most: int):
    """References and their unit vectors, by ``ref_id``; None if they take more bytes than ``most``."""
    usable = references.filter(F.col(vector).isNotNull())
    size = usable.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("w"), F.min(F.size(vector)).alias("least")).first()
    if not size["n"] or size["w"] != size["least"] or size["n"] * (size["w"] + 4) * 8 > most:
        return None
    rows = usable.select("ref_id", as_doubles(vector).alias("v")).toArrow().sort_by("ref_id")
    unit, good = _units(rows.column("v"))
    ids = rows.column("ref_id").filter(pa.array(good)).to_pylist()
    return references.sparkSession.sparkContext.broadcast((ids, unit[good]))


def _batch_hits(bank, references: DataFrame, min_sim: float, k: int):
    kind = references.schema["ref_id"].dataType.simpleString()

    @F.pandas_udf(f"array<struct<_distance:double,ref_id:{kind}>>")
    def hits(vectors: pd.Series) -> pd.Series:
        ids, unit = bank.value
        out = [[] for _ in range(len(vectors))]
        fits = [i for i, v in enumerate(vectors) if v is not None and len(v) == unit.shape[1]]
        for s in range(0, len(fits), 1024):
            rows = fits[s : s + 1024]
            x = np.stack([np.asarray(vectors.iloc[i], float) for i in rows])
            with np.errstate(all="ignore"):
                norms = np.sqrt((x * x).sum(1))
            good = np.isfinite(norms) & (norms >= 1e-12)
            rows = np.flatnonzero(good)
            row, col, sim = _best(x[good] / norms[good][:, None], unit, min_sim, k)
            for r, c, d in zip(rows[row].tolist(), col.tolist(), np.round(sim, 12).tolist()):
                out[fits[s + r]].append({"_distance": -d, "ref_id": ids[c]})
        return pd.Series(out)

    return hits


def reference_cost(entry: Column, yaw: Column, pitch: Column) -> Column:
    turn = F.pow((entry["yaw"] - yaw) / 35.0, F.lit(2.0)) + F.pow((entry["pitch"] - pitch) / 25.0, F.lit(2.0))
    return turn - 0.18 * entry["quality"]


def pick_reference(clips: DataFrame, bank: DataFrame, *, key: str = "identity_id") -> DataFrame:
    """Cheapest reference of the clip's bank for its pose (columns yaw, pitch; null pose takes the first).

    A bank is what ``diverse_references`` leaves: a few rows per identity, packed into one array per identity.
    """
    entry = F.struct(
        F.col("bank_order"), F.col("ref_id"), *(F.col(c).cast("double").alias(c) for c in ("yaw", "pitch", "quality"))
    )
    packed = bounded(bank.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_bank")))
    costs = F.transform(
        "_bank",
        lambda e: F.struct(
            reference_cost(e, F.col("yaw"), F.col("pitch")).alias("cost"), e["bank_order"].alias("bank_order"),
            e["ref_id"].alias("ref_id"),
        ),
    )
    joined = clips.join(packed, key)
    first = F.col("yaw").isNull() | F.col("pitch").isNull() | (F.size("_bank") == 1)
    chosen = F.when(first, F.element_at("_bank", 1)["ref_id"]).otherwise(F.array_min(costs)["ref_id"])
    return joined.withColumn("picked_ref", chosen).drop("_bank")


def remaining_references(references: DataFrame, selected: DataFrame, *, by: str = "path") -> DataFrame:
    return references.join(selected.select(by), by, "left_anti")
