"""N-gram Jaccard join over count vectors in an R-tree.

A document is the set of its distinct five-word shingles. Shingles are hashed to groups, and a document's counts per
group are a point. The overlap of two documents is at most the sum of the coordinate minima of their points, or of the
corners of two tree boxes, so boxes and points below the overlap that a Jaccard similarity of 0.75 needs are dropped; the
surviving pairs are verified on the sets themselves.

For unrelated documents of like size that bound only falls under the need once there are about n / 8 groups or more, so
a tree over dense points alone compares nearly all subtrees with each other. The top of the tree therefore branches on
the finest groups, one per shingle hash, where the same bound is sharp: in an order common to all documents, two points
whose minima are all zero on a document's first ``n - ceil(0.75 n) + 1`` own coordinates cannot reach the need. A
document goes to the subtree of each of these coordinates, and to no other. Shingles of many documents come last in that
order, so they seldom make a subtree. Exact on any data; the order only decides the cost.

Steps:
1. One pass counts sets: size, a 128-bit set signature, the point; and shingles met repeatedly. Equal sets become one.
2. A second pass sends each document to its subtrees. In each, documents of like size pair with the first of them;
   bounds and verification of these pairs give the links of nearly all groups of near copies, without all pairs.
3. Subtrees that still hold several components become R-trees; their pairs from different components are bounded,
   verified, and added. Copies thus never expand into all pairs, and no link between components is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import IdFilter, SpanHashes, components, flat_text, forget, lean, mix, one_row_per_id, outer_id, runs_of_documents, save, signed, sorted_groups, word_spans

WORDS = 5
#: Similarity of at least SIM[0] / SIM[1].
SIM = (75, 100)
#: Shingles counted this often come last in the common order, at most HOT_ROWS of them (4 MB). Cost only.
HOT_COUNT, HOT_ROWS = 16, 1 << 18
#: Rows of one subtree that one task takes; larger subtrees are taken block by block.
BLOCK = 1024
FAN = 16
_ODD = mix(np.arange(11, 11 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted shingle hashes of each document; all its words as one shingle where there are fewer than five."""
    starts, ends, document = word_spans(data, offsets)
    words = SpanHashes(data, lower=True).of(starts, ends)
    count = len(offsets) - 1
    upto = np.searchsorted(document, np.arange(count + 1), side="left")
    n = max(0, len(words) - WORDS + 1)
    codes = np.zeros(n, np.uint64)
    for k in range(WORDS):
        codes += words[k : n + k] * _ODD[k]
    codes = mix(codes)
    found = []
    for d in range(count):
        a, b = upto[d], upto[d + 1]
        if b - a >= WORDS:
            found.append(np.unique(codes[a : b - WORDS + 1]))
        elif b > a:
            found.append(mix(np.array([(words[a:b] * _ODD[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def _signature(s: np.ndarray) -> tuple[int, int]:
    a, b = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _groups(n: int) -> int:
    return 1 << max(3, int(n).bit_length())


def point(s: np.ndarray) -> np.ndarray:
    """Counts per group. Groups are a power of two between n and 2 n; folding a point in half gives that of half as many."""
    groups = _groups(len(s))
    counts = np.bincount((s >> np.uint64(7)).astype(np.int64) & (groups - 1), minlength=groups)
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32)


def _packed(p: np.ndarray) -> bytes:
    """Most counts are 0 or 1, so points travel deflated, at a fifth of their size or less."""
    return zlib.compress(p.tobytes(), 1)


def _as_point(raw: bytes, n: int) -> np.ndarray:
    counts = zlib.decompress(raw)
    return np.frombuffer(counts, np.uint8 if len(counts) == _groups(n) else np.uint32)


def fold(p: np.ndarray, groups: int) -> np.ndarray:
    """The point over fewer groups."""
    return p.reshape(-1, groups).sum(0, dtype=np.uint32) if len(p) > groups else p


def _need(a, b):
    """Least overlap of sets of sizes a and b that link (real; overlaps are whole)."""
    return SIM[0] / (SIM[0] + SIM[1]) * (a + b) - 1e-6


def _sets_of(batch: pa.RecordBatch) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Ids and sets of a batch, some hundred documents at a time."""
    ids = batch.column("_id").to_pylist()
    data, offsets = flat_text(batch.column("value"))
    for a, b in runs_of_documents(offsets, 1 << 18):
        yield list(zip(ids[a:b], shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])))


def _profiles(docs: DataFrame) -> DataFrame:
    """kind 0: ``id, n, s1, s2, point`` of each document. kind 1: ``id`` is a shingle seen ``n`` times by a task, at least twice."""

    def repeats(seen: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(seen), return_counts=True)
        often = counts > 1
        return rows(1, signed(keys[often]), counts[often])

    def rows(kind, ids, n, s1=None, s2=None, points=None) -> pa.RecordBatch:
        k = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * k, pa.int32()), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(s1 or [None] * k, pa.int64()), pa.array(s2 or [None] * k, pa.int64()), pa.array(points or [None] * k, pa.binary())],
            names=["kind", "id", "n", "s1", "s2", "point"],
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0
        for found in (x for batch in batches for x in _sets_of(batch)):
            ids, sizes, s1, s2, points = [], [], [], [], []
            for doc, s in found:
                a, b = _signature(s)
                ids.append(doc), sizes.append(len(s)), s1.append(a), s2.append(b), points.append(_packed(point(s)))
                seen.append(s)
                held += len(s)
                if held > 1_000_000:
                    yield repeats(seen)
                    seen, held = [], 0
            yield rows(0, ids, sizes, s1, s2, points)
        if seen:
            yield repeats(seen)

    return docs.mapInArrow(lean(task), "kind int, id long, n long, s1 long, s2 long, point binary")


def _subtrees(docs: DataFrame, hot: np.ndarray, rank: np.ndarray) -> DataFrame:
    """``key, id, n, cold``: a document (of equal sets in a task, the first) and each coordinate it must go to.

    ``cold`` counts its shingles that are not common. A text that many copies vary has none of its own, so it sorts
    before them.
    """
    common = docs.sparkSession.sparkContext.broadcast((hot, rank))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = common.value
        seen = set()
        for found in (x for batch in batches for x in _sets_of(batch)):
            keys, ids, sizes, own = [], [], [], []
            for doc, s in found:
                n = cold = len(s)
                if not n or (mark := (n, *_signature(s))) in seen:
                    continue
                seen.add(mark)
                first = n - -(-n * SIM[0] // SIM[1]) + 1
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    late = np.where(hot[at] == s, rank[at], 0)
                    if late.any():
                        s = s[np.argsort(late, kind="stable")]
                        cold = n - int(np.count_nonzero(late))
                keys.append(s[:first]), ids.append(np.full(first, doc)), sizes.append(np.full(first, n)), own.append(np.full(first, cold))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(own).astype(np.int32))], names=["key", "id", "n", "cold"])

    return docs.mapInArrow(lean(task), "key long, id long, n long, cold int")


def _shared(placed: DataFrame) -> DataFrame:
    """Rows of subtrees with two documents or more, each with the ``lead`` it pairs with first.

    Rows come sorted by key, size band and ``cold``. Within a key, documents of a size band pair with the first of the
    band, the one with the fewest shingles of its own, and that one with the first of the band before; the very first
    has none.
    """

    def emitter():
        held: list = [np.zeros(0, np.int64)] * 4

        def emit(key, ids, n, cold) -> Iterator[pa.RecordBatch]:
            """Rows up to the last change of key; the last key's rows wait for the next batch."""
            nonlocal held
            last = key is None
            key, ids, n, cold = held if last else (np.concatenate([a, b]) for a, b in zip(held, (key, ids, n, cold)))
            if not len(key):
                return
            end = len(key) if last else int(np.searchsorted(key, key[-1], side="left"))
            held = [key[end:], ids[end:], n[end:], cold[end:]]
            key, ids, n, cold = key[:end], ids[:end], n[:end], cold[:end]
            if not end:
                return
            new_key = np.concatenate([[True], key[1:] != key[:-1]])
            alone = new_key & np.concatenate([new_key[1:], [True]])
            key, ids, n, cold, new_key = key[~alone], ids[~alone], n[~alone], cold[~alone], new_key[~alone]
            if not len(key):
                return
            band = cold >> 40
            new_band = new_key | np.concatenate([[True], band[1:] != band[:-1]])
            at = np.arange(len(key))
            leader = np.maximum.accumulate(np.where(new_band, at, 0))
            before = leader[np.maximum(leader - 1, 0)]  # of the band before, if the key is the same
            lead = np.where(new_band, ids[before], ids[leader])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(n), pa.array(lead, mask=new_key)], names=["key", "id", "n", "lead"])

        return emit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = emitter()
        for batch in batches:
            yield from emit(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)))
        yield from emit(None, None, None, None)

    band = F.floor(F.log("n") / float(np.log(SIM[1] / SIM[0])) * 1024 + 0.5)
    placed = placed.withColumn("cold", F.floor(band / 1024) * (1 << 40) + F.col("cold"))
    return placed.repartition("key").sortWithinPartitions("key", "cold", "n", "id").select("key", "id", "n", "cold").mapInArrow(lean(run), "key long, id long, n long, lead long")


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose points can reach the needed overlap. ``sets``: ``id, n, point``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, pa_, pb = (batch.column(i).to_pylist() for i in range(2, 6))
            may = []
            for n, m, p, q in zip(na, nb, pa_, pb):
                p, q = _as_point(p, n), _as_point(q, m)
                groups = min(len(p), len(q))
                may.append(np.minimum(fold(p, groups), fold(q, groups)).sum() >= _need(n, m))
            chosen = pa.array(may, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(chosen), batch.column(1).filter(chosen)], names=["a", "b"])

    left, right = (sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("point").alias(f"p_{x}")) for x in "ab")
    like = (F.col("n_a") * SIM[1] >= F.col("n_b") * SIM[0]) & (F.col("n_b") * SIM[1] >= F.col("n_a") * SIM[0])
    return pairs.join(left, "a").join(right, "b").where(like).select("a", "b", "n_a", "n_b", "p_a", "p_b").mapInArrow(lean(task), "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs that link, decided on the sets, as a written table. Texts are read again; only documents in pairs ship their sets."""
    pairs = save(pairs, "ngram-pairs")
    ids = pairs.select("a").union(pairs.select("b")).distinct()

    def hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in (x for batch in batches for x in _sets_of(select(bits, batch))):
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["id", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y)) if len(x) + len(y) < 64 else int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                yes.append(both * SIM[1] >= SIM[0] * (len(x) + len(y) - both))
            chosen = pa.array(yes, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(chosen), batch.column(1).filter(chosen)], names=["a", "b"])

    asked = IdFilter(ids, "a")
    bits, select = asked.bits, asked.select
    sets = asked.hashed(docs, "_id").mapInArrow(lean(hash_sets), "id long, shingles binary").join(ids, F.col("id") == F.col("a"), "left_semi")
    left, right = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab")
    links = save(pairs.join(right, "b").join(left, "a").select("a", "b", "s_a", "s_b").mapInArrow(lean(compare), "a long, b long"), "ngram-links")
    forget(pairs)
    return links


class CountTree:
    """An R-tree over points of one width, packed by size and then by the coordinates that vary most; boxes keep upper corners.

    The top level has up to ``FAN`` boxes; so few points are that level themselves.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        if len(sizes) <= FAN:
            self.order = np.arange(len(sizes))
        else:
            squares = np.einsum("ij,ij->j", points, points, dtype=np.float64, casting="unsafe")  # without a copy as floats
            widest = np.argsort(points.mean(0) ** 2 - squares / len(points))[:2]
            tile = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // (FAN * FAN)
            self.order = np.lexsort((points[:, widest[1]], points[:, widest[0]], tile))
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > FAN:
            corner, low, high = self.levels[-1]
            cuts = np.arange(0, len(low), FAN)
            self.levels.append((np.maximum.reduceat(corner, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))

    def join(self, other: CountTree | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of point pairs that can link; with itself each pair once."""
        same = other is None
        other = self if same else other
        depth = max(len(self.levels), len(other.levels))
        mine, its = ([*tree.levels, *[tree.levels[-1]] * (depth - len(tree.levels))] for tree in (self, other))
        top = len(mine[-1][1]), len(its[-1][1])
        i, j = np.repeat(np.arange(top[0]), top[1]), np.tile(np.arange(top[1]), top[0])
        for step in range(depth - 1, -1, -1):
            if step < depth - 1:
                i, j = self._children(i, j, mine, its, step)
            if same:
                near = i <= j if step else i < j
                i, j = i[near], j[near]
            i, j = self._fitting(i, j, mine[step], its[step])
        return self.order[i], other.order[j]

    @staticmethod
    def _children(i, j, mine, its, step):
        def below(level, x):
            if level[step] is level[step + 1]:
                return x, np.ones(len(x), np.int64)
            return x * FAN, np.minimum(FAN, len(level[step][1]) - x * FAN)

        (a, n), (b, m) = below(mine, i), below(its, j)
        each = n * m
        which = np.repeat(np.arange(len(i)), each)
        k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        return a[which] + k // m[which], b[which] + k % m[which]

    @staticmethod
    def _fitting(i, j, a, b, chunk: int = 1 << 13):
        fits = (a[2][i] * SIM[1] >= b[1][j] * SIM[0]) & (b[2][j] * SIM[1] >= a[1][i] * SIM[0])
        i, j = i[fits], j[fits]
        if not len(i):
            return i, j
        keep = np.concatenate([np.minimum(a[0][i[s : s + chunk]], b[0][j[s : s + chunk]]).sum(1) >= _need(a[1][i[s : s + chunk]], b[1][j[s : s + chunk]]) for s in range(0, len(i), chunk)])
        return i[keep], j[keep]


def _tree_join(points: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that can link, of ``left`` with itself or with ``right``.

    Sets that can link have points of equal width, or one of twice the other's: a tree a width, and joins between them.
    """

    def trees(rows: np.ndarray) -> dict:
        width = np.array([len(points[r]) for r in rows])
        held = {}
        for w in np.unique(width).tolist():
            own = rows[width == w]
            whole = np.stack([points[r] for r in own])
            held[w] = own, lambda to, whole=whole, own=own: CountTree(whole if to == whole.shape[1] else whole.reshape(len(own), -1, to).sum(1, dtype=np.uint16 if whole.dtype == np.uint8 else np.uint32), sizes[own])
        return held

    mine = trees(left)
    its = mine if right is None else trees(right)
    for w, (own, build) in mine.items():
        for v in (w,) if right is None else (w, w // 2):
            if v in its:
                a, b = build(v).join(None if right is None else its[v][1](v))
                yield own[a], its[v][0][b]
        if 2 * w in its:
            a, b = build(w).join(its[2 * w][1](w))
            yield own[a], its[2 * w][0][b]


def _tree_pairs(rows: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs of different components in the same subtree that pass the tree's bounds. ``rows``: ``key, id, n, component``."""
    # subtrees of the same documents are one
    marks = rows.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("m"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("m2"))
    rows = rows.join(marks.groupBy("c", "m", "m2").agg(F.min("key").alias("key")).select("key"), "key")
    order = Window.partitionBy("key").orderBy("n", "id")
    blocked = rows.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK))
    blocked = blocked.withColumn("blocks", F.max("block").over(Window.partitionBy("key")) + 1)
    one, other = F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j")
    sent = blocked.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("key", one, other, "block", "id", "n", "component")
    sent = sent.join(points.select("id", "point"), "id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for group in sorted_groups(batches, ("key", "i", "j")):
            ids, n, component, block = (group.column(x).to_numpy(zero_copy_only=False) for x in ("id", "n", "component", "block"))
            dots = [_as_point(p, m) for p, m in zip(group.column("point").to_pylist(), n.tolist())]
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            left, right = np.flatnonzero(block == i), None if i == j else np.flatnonzero(block == j)
            for a, b in _tree_join(dots, n, left, right):
                apart = component[a] != component[b]
                if apart.any():
                    a, b = ids[a[apart]], ids[b[apart]]
                    found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            if sum(x.shape[1] for x in found[-64:]) > 10_000 or len(found) > 10_000:
                yield pairs(found)
                found = []
        if found:
            yield pairs(found)

    def pairs(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    # the first of two equal sets speaks for both, so a pair of one id does not come up
    sent = sent.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return sent.mapInArrow(lean(task), "a long, b long").distinct()


def near_copies(documents: DataFrame) -> DataFrame:
    """``_id, n_shingles, component_id`` of every document; components are of links with Jaccard 0.75 or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set has the distinct five-word shingles of the whole
    text, or all words as one shingle if there are fewer. Null and empty texts and those without words have empty sets
    and link with nothing. Rows that share an id count as one (``one_row_per_id``); a null id is the smallest id. Other
    columns are not read; an empty table gives no rows. Sets are compared by 64-bit shingle hashes.
    """
    docs = one_row_per_id(documents, "doc_id", "text")
    profiles = save(_profiles(docs), "ngram-profiles")
    repeated = profiles.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_COUNT)
    hot = repeated.orderBy(F.col("n").desc(), "id").limit(HOT_ROWS).toPandas()
    keys = hot["id"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    sets = profiles.where("kind = 0").select("id", "n", "s1", "s2", "point")
    classes = sets.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"))
    members = save(sets.where("n > 0").join(classes, ["n", "s1", "s2"]).select("id", "n", "rep"), "ngram-members")
    points = sets.join(members.where("id = rep").select("id"), "id", "left_semi").select("id", "n", "point")

    shared = save(_shared(_subtrees(docs, keys[order], hot["n"].to_numpy(np.int64)[order])), "ngram-subtrees")
    rep = members.select(F.col("id").alias("of"), "rep")

    def between_classes(pairs: DataFrame) -> DataFrame:
        a = pairs.join(rep, F.col("a") == F.col("of")).select(F.col("rep").alias("a"), "b")
        b = a.join(rep, F.col("b") == F.col("of")).select("a", F.col("rep").alias("b"))
        return b.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    first = shared.where("lead IS NOT NULL").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    links = _verified(_bounded(between_classes(first), points), docs)
    joined = components(links)

    # what is left: subtrees with several components
    named = members.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("id", "rep", F.coalesce("component_id", "rep").alias("component"))
    placed = shared.select("key", "id", "n").join(named, "id").select("key", F.col("rep").alias("id"), "n", "component").distinct()
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    open_ = save(placed.join(mixed, "key"), "ngram-open")
    forget(shared)
    more = _verified(_bounded(_tree_pairs(open_, points), points), docs)
    forget(open_)
    joined = components(links.union(more)) if not more.isEmpty() else joined
    out = sets.select("id", "n").join(named.select("id", "rep"), "id", "left").join(joined.select(F.col("id").alias("rep"), "component_id"), "rep", "left")
    out = save(out.select(F.col("id").alias("_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep", "id").alias("component_id")), "ngram-components")
    forget(profiles, members, links, more)
    return out


def report(documents: DataFrame) -> DataFrame:
    return near_copies(documents).select(outer_id().alias("doc_id"), "n_shingles", outer_id("component_id").alias("component_id"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS s FROM w
), g AS (SELECT doc_id, hash(s) AS s FROM s), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) c USING (doc_id)
"""
