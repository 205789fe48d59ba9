"""Embedding near-dedup by a forest of random-projection trees.

A tree splits at the median along a random direction, again and again. A vector is entered in the few leaves it would
reach by crossing the splits it lies closest to, so a pair at the threshold nearly always shares one (measured recall:
README). What travels to the leaves is not the vector but its hash and a sketch of 16 bytes: up to 32 orthogonal random
projections in steps of four bits, whose distance tells pairs below the threshold from those that may reach it. A
leaf only says which of its vectors hang together; vectors that hang together with no other are done.

The others, each sent once and whole, meet in their connected groups, where all pairs are decided by their cosine in
double precision and counted in place; no list of pairs is written. Groups beyond ``GROUP`` bytes meet block by block,
each pair of blocks a task, so their size bounds no memory and drops nothing.

Equal vectors are one row with a weight, so a hot vector costs nothing. Trees are fitted on a sample of at most ``SAMPLE``
distinct vectors, drawn by hash; every row is indexed. Each tree is as deep as the row count asks for, as far as the
sample goes. Vectors of different lengths are entered apart, by length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import components, flat_text, forget, lean, outer_id, save, sorted_groups
from framelens.llm.vectors import one_vector_per_id

THRESHOLD = 0.95
#: Leaves a vector is entered in per tree; nodes kept on the way down.
TREES, PROBES, BEAM = 4, 4, 8
LEAF, SAMPLE = 512, 1 << 17
#: Projections of a sketch, two to a byte, and the length of a step in parts of a near pair's mean difference along one.
SKETCH, STEP = 32, 1.25
#: Rows of a leaf compared with as many at once.
MEET = 512
#: Bytes of vectors in a block of a large group; rows of small groups taken together.
GROUP, TILE = 1 << 24, 512
#: Rows that a task holds back to put their entries in order; bytes of entries in a task.
HELD, ENTRIES = 1 << 16, 24 << 20
_SEED = 20240611


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so nothing under- or overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


# --- trees and sketches ---------------------------------------------------------------------------------------------


def _orthogonal(rng: np.random.Generator, width: int, count: int) -> np.ndarray:
    """Random directions as columns, orthogonal as far as the width allows."""
    parts = [np.linalg.qr(rng.standard_normal((width, width if count > width else count)))[0] for _ in range(-(-count // width))]
    return np.concatenate(parts, 1)[:, :count].astype(np.float32) if count else np.zeros((width, 0), np.float32)


def fit_forest(sample: np.ndarray, depth: int, trees: int = TREES) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Per tree a direction for each level, as columns, and for each level the medians of its nodes (a node's children are 2k and 2k + 1)."""
    rng = np.random.default_rng(_SEED)
    forest = []
    for _ in range(trees):
        directions = _orthogonal(rng, sample.shape[1], depth)
        along, nodes, medians = sample.astype(np.float32) @ directions, np.zeros(len(sample), np.int64), []
        for level in range(depth):
            order = np.lexsort((along[:, level], nodes))
            starts = np.searchsorted(nodes[order], np.arange(2**level + 1))
            low, high = (np.clip(starts[:-1] + (np.diff(starts) - up) // 2, 0, len(order) - 1) for up in (1, 0))
            middle = (along[order[low], level] + along[order[high], level]) / 2
            medians.append(np.where(np.diff(starts) > 0, middle, 0).astype(np.float32))
            nodes = 2 * nodes + (along[:, level] > medians[-1][nodes])
        forest.append((directions, medians))
    return forest


def leaves(x: np.ndarray, tree: tuple[np.ndarray, list[np.ndarray]], probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and leaf numbers: for each row the leaves with the least sum of squared distances to the splits crossed."""
    directions, medians = tree
    along = x.astype(np.float32) @ directions
    nodes, cost = np.zeros((len(x), 1), np.int32), np.zeros((len(x), 1), np.float32)
    for level, middle in enumerate(medians):
        gap = along[:, level, None] - middle[nodes]
        right = gap > 0
        nodes = np.concatenate([2 * nodes + right, 2 * nodes + ~right], 1)
        cost = np.concatenate([cost, cost + gap * gap], 1)
        most = probes if level + 1 == len(medians) else max(BEAM, probes)
        if nodes.shape[1] > most:
            best = np.argpartition(cost, most - 1, axis=1)[:, :most]
            nodes, cost = np.take_along_axis(nodes, best, 1), np.take_along_axis(cost, best, 1)
    return np.repeat(np.arange(len(x)), nodes.shape[1]), nodes.reshape(-1)


class Sketch(NamedTuple):
    """Projections in steps of four bits. Distances are squared and in steps; those of pairs at the threshold lie below ``cut``."""

    directions: np.ndarray
    centre: np.ndarray
    step: float
    cut: float

    @staticmethod
    def fit(sample: np.ndarray, threshold: float = THRESHOLD) -> Sketch:
        width = sample.shape[1]
        count = min(SKETCH, width)
        directions = _orthogonal(np.random.default_rng(_SEED + 1), width, count)
        step = STEP * np.sqrt(max(2 * (1 - threshold), 1e-9) / width)
        # a pair at the threshold: its difference falls on the projections as a Beta variable, rounding adds to it
        kept, spread = count / STEP**2, np.sqrt((width / count - 1) / (width / 2 + 1))
        deviation = np.sqrt((kept * spread) ** 2 + 4 * kept / 6 + 0.039 * count)
        return Sketch(directions, (sample.astype(np.float32) @ directions).mean(0), step, kept + count / 6 + 5 * deviation)

    def of(self, x: np.ndarray) -> np.ndarray:
        """16 bytes a row. Values beyond the range of a step count move to its ends, which brings rows closer, never apart."""
        steps = np.zeros((len(x), SKETCH), np.uint8)
        steps[:, : len(self.centre)] = np.clip(np.rint((x.astype(np.float32) @ self.directions - self.centre) / self.step), -8, 7) + 8
        return steps[:, 0::2] << 4 | steps[:, 1::2]


def _open(sketches: np.ndarray) -> np.ndarray:
    """Rows whose product with ``_facing`` others is minus half the squared distance."""
    x = np.empty((len(sketches), SKETCH + 2), np.float32)
    x[:, 0:SKETCH:2], x[:, 1:SKETCH:2] = sketches >> 4, sketches & 15
    x[:, :SKETCH] -= 7.5
    x[:, SKETCH], x[:, SKETCH + 1] = -0.5 * (x[:, :SKETCH] ** 2).sum(1), 1
    return x


def _facing(opened: np.ndarray) -> np.ndarray:
    return np.concatenate([opened[:, :SKETCH], opened[:, SKETCH + 1 :], opened[:, SKETCH : SKETCH + 1]], 1)


# --- connected rows of one task -------------------------------------------------------------------------------------


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking rows ``a`` and ``b``: the smallest row number reachable."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        labels = parent[labels]


def _connected(sketches: np.ndarray, cut: float) -> np.ndarray:
    """Per row the first row it hangs together with by distances up to ``cut``.

    A group that many rows belong to is found from a few of them; its rows then only meet the rows outside.
    """
    labels, rng, least = np.arange(len(sketches)), np.random.default_rng(_SEED), np.float32(-cut / 2)
    opened = _open(sketches)
    facing = _facing(opened)

    def meet(rows: np.ndarray, columns: np.ndarray | None, labels: np.ndarray) -> np.ndarray:
        """Of ``rows`` with ``columns``, or with one another."""
        own = columns is None
        columns = rows if own else columns
        for s in range(0, len(columns), MEET):
            right = columns[s : s + MEET]
            across = facing[right].T
            for t in range(0, s + 1 if own else len(rows), MEET):
                left = rows[t : t + MEET]
                near = opened[left] @ across >= least
                if own and t == s:
                    np.fill_diagonal(near, False)
                some = np.flatnonzero(near.any(1))
                if len(some):
                    i, j = np.divmod(np.flatnonzero(near[some]), len(right))
                    labels = _merge(labels, left[some[i]], right[j])
        return labels

    left = np.arange(len(sketches))
    while len(left) > 2 * LEAF:
        labels = meet(rng.choice(left, 32, replace=False), left, labels)
        found, at, count = np.unique(labels[left], return_inverse=True, return_counts=True)
        if count.max() < len(left) / 8:
            break
        group = at == count.argmax()
        labels = meet(left[group], left[~group], labels)
        left = left[~group]
    return meet(left, None, labels)


# --- tasks ----------------------------------------------------------------------------------------------------------


def _sound(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and matrix (-0.0 is 0.0) of the vectors that may link, by length."""
    column = batch.column("v")
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    for width in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == width)
        x = flat[starts[at][:, None] + np.arange(width)] if len(at) * width < len(flat) else flat.reshape(-1, width)
        fine = np.isfinite(x).all(1) & (x != 0).any(1)
        if fine.any():
            yield width, at[fine], np.ascontiguousarray(x[fine] + x.dtype.type(0))


def _hashes(x: np.ndarray) -> np.ndarray:
    """128 bits of every row, as two numbers."""
    data, size = x.tobytes(), x.shape[1] * x.itemsize
    return np.frombuffer(b"".join([blake2b(data[i : i + size], digest_size=16).digest() for i in range(0, len(data), size)]), np.int64).reshape(-1, 2)


def _blobs(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary values: rows of ``data`` from each start to the next."""
    data = np.ascontiguousarray(data)
    size = data.nbytes // max(1, len(data))
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * size).astype(np.int32)), pa.py_buffer(data)])


def _held(batches: Iterator[pa.RecordBatch], chosen: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Length, hashes, smallest id, number and matrix of distinct vectors, of many rows at once. ``chosen``: which hashes to take."""
    held: dict[int, list] = {}
    rows = size = 0

    def out() -> Iterator[tuple]:
        for width, parts in held.items():
            hashes, ids, x = (np.concatenate(p) for p in zip(*parts))
            order = np.lexsort((ids, hashes[:, 1], hashes[:, 0]))
            first = np.flatnonzero(np.r_[True, (np.diff(hashes[order], axis=0) != 0).any(1)])
            once = order[first]
            yield width, hashes[once], ids[once], np.diff(np.r_[first, len(order)]), x[once]

    for batch in batches:
        ids = batch.column("_id").to_numpy()
        for width, at, x in _sound(batch):
            hashes = _hashes(x)
            if chosen is not None:
                some = chosen(hashes[:, 0])
                hashes, at, x = hashes[some], at[some], x[some]
            if len(at):
                held.setdefault(width, []).append((hashes, ids[at], x))
                rows, size = rows + len(at), size + x.nbytes
        if rows >= HELD or size >= 4 * GROUP:
            yield from out()
            held, rows, size = {}, 0, 0
    yield from out()


class _Plan(NamedTuple):
    """Of vectors of one length: number of the first leaf, leaves of a tree, trees, sketch."""

    first: int
    leaves: int
    forest: list
    sketch: Sketch


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        widths, hashes = np.zeros(batch.num_rows, np.int32), np.zeros((batch.num_rows, 2), np.int64)
        for width, at, x in _sound(batch):
            widths[at], hashes[at] = width, _hashes(x)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(widths), pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy())], names=["_id", "width", "h", "g"])


def _entries(plans, slots: int) -> Callable:
    """Task: entries (leaf, hash, sketch) of the vectors, a few thousand to a row. ``plans``: a broadcast, by length."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, hashes, _, _, x in _held(batches):
            plan = plans.value[width]
            x = _unit(x.astype(np.float64)).astype(np.float32)
            sketches, rows, at = plan.sketch.of(x), [], []
            for s in range(0, len(x), 8192):
                for tree, held in enumerate(plan.forest):
                    row, leaf = leaves(x[s : s + 8192], held)
                    rows.append(row + s)
                    at.append(leaf.astype(np.int64) + (plan.first + tree * plan.leaves))
            rows, at = np.concatenate(rows), np.concatenate(at)
            order = np.lexsort((at, at % slots))
            rows, at = rows[order], at[order]
            starts = np.flatnonzero(np.r_[True, np.diff(at % slots) != 0, True])
            slot = pa.array((at[starts[:-1]] % slots).astype(np.int32))
            yield pa.RecordBatch.from_arrays([slot, _blobs(at.astype(np.int32), starts), _blobs(hashes[rows, 0], starts), _blobs(sketches[rows], starts)], names=["slot", "leaf", "h", "sketch"])

    return task


def _edges(plans) -> Callable:
    """Task: for entries that hang together within a leaf, hash and smallest hash."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[flat_text(batch.column(k))[0].copy() for k in (1, 2, 3)] for batch in batches if batch.num_rows]
        if not parts:
            return
        at, h, sketches = (np.concatenate(p) for p in zip(*parts))
        at, h, sketches = at.view(np.int32), h.view(np.int64), sketches.reshape(-1, SKETCH // 2)
        order = np.lexsort((h, at))
        order = order[np.r_[True, (np.diff(at[order]) != 0) | (np.diff(h[order]) != 0)]]
        at, h, sketches = at[order], h[order], sketches[order]
        starts = np.flatnonzero(np.r_[True, np.diff(at) != 0, True])
        own = sorted(plans.value.values())
        which = np.searchsorted([p.first for p in own], at[starts[:-1]], side="right") - 1
        for s, e, k in zip(starts[:-1].tolist(), starts[1:].tolist(), which.tolist()):
            if e - s > 1:
                labels = _connected(sketches[s:e], own[k].sketch.cut)
                tied = np.flatnonzero(labels != np.arange(e - s))
                if len(tied):
                    yield pa.RecordBatch.from_arrays([pa.array(h[s + tied]), pa.array(h[s + labels[tied]])], names=["a", "b"])

    return task


def _whole(bits) -> Callable:
    """Task: the vectors whose hash may be among those in the bitmap (a broadcast), equal ones of many rows as one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chosen(h: np.ndarray) -> np.ndarray:
            at = h & (64 * len(bits.value) - 1)
            return (bits.value[at >> 6] >> (at & 63)) & 1 == 1

        for _, hashes, ids, members, x in _held(batches, chosen):
            for s in range(0, len(x), 8192):
                e = min(s + 8192, len(x))
                columns = [np.ascontiguousarray(c[s:e]) for c in (hashes[:, 0], hashes[:, 1], ids, members)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), _blobs(x[s:e], np.arange(e - s + 1))], names=["h", "g", "id", "members", "v"])

    return task


def _links(kind: str, threshold: float) -> Callable:
    """Task: ``h, g, id, n_links, root, part`` of vectors that link, from whole groups or pairs of blocks of them; ``kind``: their NumPy type."""

    def counted(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = {name: group.column(name).to_numpy() for name in ("grp", "i", "j", "block", "h", "g", "id", "members", "blocks")}
        run = np.cumsum(np.r_[0, (np.diff(column["grp"]) != 0) | (np.diff(column["i"]) != 0) | (np.diff(column["j"]) != 0)])
        flat, offsets = flat_text(group.column("v"))
        sizes = np.diff(offsets)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            single = run[at[0]] == run[at[-1]]
            cross = bool(single and column["i"][at[0]] != column["j"][at[0]])
            if cross:
                at = np.concatenate([at[column["block"][at] == column["i"][at[0]]], at[column["block"][at] != column["i"][at[0]]]])
            c, own = {name: values[at] for name, values in column.items()}, run[at]
            x = _unit(flat[offsets[at][:, None] + np.arange(size)].view(kind).astype(np.float64))
            inner, weight = c["i"] == c["j"], c["members"].astype(np.float64)
            links, labels, n = np.where(inner, weight - 1, 0), np.arange(len(at)), len(at)
            border = int((c["block"] == c["i"]).sum()) if cross else n
            step = max(16, (1 << 21) // n)
            for s in range(0, border, step):
                e = min(s + step, border)
                first = border if cross else s
                near = x[s:e] @ x[first:].T >= threshold
                if not cross:
                    near &= np.arange(s, e)[:, None] < np.arange(first, n)
                if not single:
                    near &= own[s:e, None] == own[first:]
                    if not inner.all():
                        near &= inner[s:e, None] | (c["block"][s:e, None] != c["block"][first:])
                if near.any():
                    apart = near & (labels[s:e, None] != labels[first:])
                    near = near.astype(np.float64)
                    links[s:e] += near @ weight[first:]
                    links[first:] += weight[s:e] @ near
                    a, b = np.divmod(np.flatnonzero(apart), n - first)
                    labels = _merge(labels, a + s, b + first)
            least = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(least, labels, c["id"])
            some = np.flatnonzero(links > 0)
            out = [c["h"], c["g"], c["id"], links.astype(np.int64), least[labels], c["blocks"] > 1]
            yield pa.RecordBatch.from_arrays([pa.array(values[some]) for values in out], names=["h", "g", "id", "n_links", "root", "part"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ("grp", "i", "j"), TILE):
            yield from counted(group)

    return task


# --- the operator ---------------------------------------------------------------------------------------------------


def _bitmap(hashes: DataFrame, column: str, count: int) -> np.ndarray:
    """A bitmap of about eight bits a hash, at most 32 MB."""
    bits = int(np.clip(np.ceil(np.log2(8 * max(1, count))), 16, 28))
    word = F.pmod(F.col(column), F.lit(1 << bits).cast("long"))
    set_ = hashes.select(word.alias("word")).selectExpr("shiftright(word, 6) AS at", "shiftleft(1L, cast(word % 64 AS int)) AS bit").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[set_.column("at").to_numpy()] = set_.column("bits").to_numpy()
    return out


def _plans(rows: DataFrame, keys: DataFrame, trees: int, threshold: float) -> tuple[dict[int, _Plan], int]:
    """By length of vector, and the number of entries."""
    plans, first, entries = {}, 0, 0
    for width, count in sorted((r["width"], r["n"]) for r in keys.where("width > 0").groupBy("width").agg(F.count("*").alias("n")).collect()):
        depth, sample = max(0, int(np.ceil(np.log2(count / LEAF)))), np.zeros((1, width))
        if depth:
            most = min(SAMPLE, max(LEAF, (1 << 25) // width))
            share = int(min(1.0, most / count) * (1 << 30))
            drawn = rows.where((F.size("v") == width) & (F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < share)).select("v").distinct().limit(2 * most).toArrow()
            found = [x for batch in drawn.combine_chunks().to_batches() for _, _, x in _sound(batch)]
            sample = _unit(np.concatenate(found).astype(np.float32)) if found else sample
            depth = max(0, min(depth, int(np.log2(max(1, len(sample) / 4)))))
        forest = fit_forest(sample, depth, trees if depth else 1)
        plans[width] = _Plan(first, 1 << depth, forest, Sketch.fit(sample, threshold))
        first += len(forest) << depth
        entries += count * len(forest) * min(PROBES, 1 << depth)
    return plans, entries


def _linked(rows: DataFrame, keys: DataFrame, trees: int, threshold: float) -> DataFrame:
    """``h, g, id, n_links, component_id`` of every class of equal vectors that links."""
    spark = rows.sparkSession
    context = spark.sparkContext
    plans, entries = _plans(rows, keys, trees, threshold)
    held = context.broadcast(plans)
    tasks = max(context.defaultParallelism, -(-28 * entries // ENTRIES))
    placed = rows.mapInArrow(lean(_entries(held, 4 * tasks)), "slot int, leaf binary, h binary, sketch binary")
    groups = components(placed.repartition(tasks, "slot").mapInArrow(lean(_edges(held)), "a long, b long")).select(F.col("id").alias("h"), F.col("component_id").alias("grp"))
    count = groups.count()
    if not count:
        return spark.createDataFrame([], "h long, g long, id long, n_links long, component_id long")
    bits = context.broadcast(_bitmap(groups, "h", count))
    whole = rows.mapInArrow(lean(_whole(bits)), "h long, g long, id long, members long, v binary")
    classes = whole.repartition("h").groupBy("h", "g").agg(F.min("id").alias("id"), F.sum("members").alias("members"), F.first("v").alias("v")).join(groups, "h")
    block = max(64, GROUP // (8 * max(plans)))
    large = groups.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks")).where("blocks > 1")
    sent = classes.join(F.broadcast(large), "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    sent = sent.withColumn("block", F.pmod("g", "blocks")).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sent = sent.select("grp", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "blocks", "h", "g", "id", "members", "v")
    kind = "float32" if dict(rows.dtypes)["v"] == "array<float>" else "float64"
    keyed = sent.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    met = save(keyed.mapInArrow(lean(_links(kind, threshold)), "h long, g long, id long, n_links long, root long, part boolean"), "forest-links")
    out = met.where("not part").select("h", "g", "id", "n_links", F.col("root").alias("component_id"))
    parts = met.where("part")
    if parts.isEmpty():
        return out
    joined = components(parts.select(F.col("id").alias("a"), F.col("root").alias("b")))
    parts = parts.groupBy("h", "g", "id").agg(F.sum("n_links").alias("n_links")).join(joined, "id", "left")
    return out.union(parts.select("h", "g", "id", "n_links", F.coalesce("component_id", "id").alias("component_id")))


def near_vectors(embeddings: DataFrame, *, threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """``_id, n_links, component_id`` of every vector in ``embeddings (vec_id, embedding)``.

    Links: found pairs with cosine at the threshold or above; equal vectors always link. Null vectors, zero vectors, and
    those with null or non-finite components link with nothing and are their own component, as are empty ones. Vectors of
    different lengths never link. Rows that share an id count as one (the largest vector stays), a null id is the
    smallest id. Labels and other columns are not read; an empty table gives no rows.
    """
    kind = dict(embeddings.dtypes)["embedding"]
    rows = one_vector_per_id(embeddings, kind if kind == "array<float>" else "array<double>", written=True)
    keys = save(rows.mapInArrow(_keys, "_id long, width int, h long, g long"), "forest-keys")
    linked = _linked(rows, keys, trees, threshold)
    forget(rows)
    sound = keys.where("width > 0")
    equal = sound.groupBy("h", "g").agg((F.count("*") - 1).alias("n_links"), F.min("_id").alias("component_id")).where("n_links > 0")
    # a class in both has all its links in the first
    known = linked.select("h", "g", "n_links", "component_id").union(equal).groupBy("h", "g").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    found = sound.join(known, ["h", "g"], "left").select("_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "_id").alias("component_id"))
    return found.union(keys.where("width = 0").select("_id", F.lit(0).cast("long"), "_id"))


def report(embeddings: DataFrame) -> DataFrame:
    found = near_vectors(embeddings).withColumn("kept", F.col("_id") == F.col("component_id"))
    return found.select(outer_id().alias("vec_id"), "n_links", outer_id("component_id").alias("component_id"), "kept")


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), n AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND x.norm > 0 AND y.norm > 0
  WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.95
), r(vec_id, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id WHERE r.root < l.b
), c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN k USING (vec_id)
"""
