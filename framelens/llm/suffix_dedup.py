"""Suffix-array dedup: bytes that repeat a long earlier string go.

Every byte covered by a ``LENGTH``-byte string that also starts earlier is removed. All strings are judged on the input.

Suffixes of the whole corpus cannot meet in one array, so equal strings are brought together first. Of the ``WINDOW``
grams of ``GRAM`` bytes inside a string, the one with the least hash is its anchor, whatever surrounds the string; so two
equal strings have equal anchors at equal places. About one byte in 35 is an anchor. An anchor stands for the strings
whose least gram it is; the bytes these cover are its context.

1. One pass notes hash, context hash and place of each anchor. Anchors with equal contexts repeat each other whole: all
   but the earliest are marked without looking at bytes, those inside a task before the shuffle.
2. Where one anchor has different contexts, the first of each ships its bytes (about 130). A task joins the contexts of
   several anchors to one text and builds its suffix array by two-stage sorting: only suffixes smaller than their
   successors are sorted directly, the rest follow by one scan over the buckets of first bytes. Neighbours with a common
   prefix of ``LENGTH`` bytes are equal strings; all but the earliest are marked.
3. Marks are merged per document and cut out.

An anchor with more contexts than ``LARGEST`` bytes is compared by 128-bit digests of its strings, grouped on Spark, so
no group must fit one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import IdFilter, SpanHashes, flat_text, mix, one_row_per_id, outer_id, runs_of_documents, save, signed, sorted_groups

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
BUFFER, LARGEST = 1 << 20, 1 << 24
_FLUSH = 1_000_000


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every anchor: document number, first string start (from the document's), count of strings less one, place of the gram after that start, gram hash, context hash."""
    none = np.zeros(0, np.int64)
    count = len(data) - LENGTH + 1
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - LENGTH + 1))
    if not len(owner):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashes = SpanHashes(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = hashes.of(at, at + GRAM)
    bits = np.uint64(len(data).bit_length())
    least = (grams >> bits << bits) | at.astype(np.uint64)
    reach = 1
    while 2 * reach <= WINDOW:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < WINDOW:
        least = np.minimum(least[: count], least[WINDOW - reach :][:count])
    first = offsets[:-1][owner]
    begin = np.concatenate([[0], np.cumsum(np.maximum(0, sizes - LENGTH + 1))])
    starts = first + np.arange(len(owner)) - begin[owner]
    gram_at = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], gram_at[1:] != gram_at[:-1]]))
    low, high = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    gram_at, owner = gram_at[new], owner[new]
    return owner, low - offsets[owner], high - low, gram_at - low, grams[gram_at], hashes.of(low, high + LENGTH)


def _place(low, more, inner):
    return low << 14 | more << 7 | inner


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """kind 0: the first anchor (in the task) of each gram and context: ``h, c, id, place``. kind 1: later ones, for marking; ``h`` only spreads them."""

    def flush(rows: list) -> Iterator[pa.RecordBatch]:
        ids, places, h, c = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((places, ids, c, h))
        ids, places, h, c = ids[order], places[order], h[order], c[order]
        later = np.concatenate([[False], (h[1:] == h[:-1]) & (c[1:] == c[:-1])])
        h = np.where(later, mix(places.astype(np.uint64) ^ ids.astype(np.uint64)), h)
        for a in range(0, len(ids), 100_000):
            part = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(later[part].astype(np.int32)), *(pa.array(signed(x[part])) for x in (h, c)), pa.array(ids[part]), pa.array(places[part])], names=["kind", "h", "c", "id", "place"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            ids = batch.column("_id").to_numpy(zero_copy_only=False)
            data, offsets = flat_text(batch.column("value"))
            for a, b in runs_of_documents(offsets):
                owner, low, more, inner, h, c = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if len(owner):
                    rows.append((ids[a:b][owner], _place(low, more, inner), h, c))
                    held += len(owner)
                if held >= _FLUSH:
                    yield from flush(rows)
                    rows, held = [], 0
        if rows:
            yield from flush(rows)

    return docs.mapInArrow(task, "kind int, h long, c long, id long, place long")


def _compared(rows: DataFrame) -> DataFrame:
    """kind 1: marks ``id, place``. kind 2: first anchors of contexts that share a gram with other contexts: ``h, id, place``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4

        def decide(h, c, ids, places):
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
            group = np.cumsum(new_h) - 1
            several = np.bincount(group, new_c)[group] > 1
            kind = np.where(new_c, np.where(several, 2, 0), 1)
            some = kind > 0
            return pa.RecordBatch.from_arrays([pa.array(kind[some].astype(np.int32)), pa.array(h[some]), pa.array(ids[some]), pa.array(places[some])], names=["kind", "h", "id", "place"])

        for batch in batches:
            kind, *columns = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            marks = kind == 1
            if marks.any():
                yield pa.RecordBatch.from_arrays([pa.array(kind[marks]), *(pa.array(columns[i][marks]) for i in (0, 2, 3))], names=["kind", "h", "id", "place"])
            columns = [np.concatenate([a, b[~marks]]) for a, b in zip(held, columns)]
            if len(columns[0]):
                end = int(np.searchsorted(columns[0], columns[0][-1], side="left"))
                held = [x[end:] for x in columns]
                if end:
                    yield decide(*(x[:end] for x in columns))
        if len(held[0]):
            yield decide(*held)

    return rows.repartition("h").sortWithinPartitions("kind", "h", "c", "id", "place").mapInArrow(task, "kind int, h long, id long, place long")


# --- the suffix array of a task's text --------------------------------------------------------------------------------


def _eights(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number, zeros after the end."""
    padded = np.concatenate([text, np.zeros(8 + LENGTH, np.uint8)]).astype(np.uint64)
    key = np.zeros(len(text) + LENGTH, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + len(key)]
    return key


def _sort_directly(places: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Suffixes by their first ``LENGTH`` bytes and some: eight bytes at a time, each time only what is still tied."""
    order = places[np.argsort(key[places], kind="stable")]
    lead = key[order]
    new = np.concatenate([[True], lead[1:] != lead[:-1]])[: len(order)]
    group = np.flatnonzero(new)[np.cumsum(new) - 1]  # a group is named by the first place it takes
    for depth in range(8, LENGTH + 4, 8):
        if not len(order):
            break
        same = group[1:] == group[:-1]
        tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        if not len(tied):
            break
        part = order[tied]
        following = key[np.minimum(part + depth, len(key) - 1)]
        new = np.lexsort((following, group[tied]))
        order[tied] = part[new]
        following, own = following[new], group[tied]
        split = np.concatenate([[True], (own[1:] != own[:-1]) | (following[1:] != following[:-1])])
        group[tied] = tied[np.flatnonzero(split)][np.cumsum(split) - 1]
    return order


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` in the order of (at least) their first ``LENGTH`` bytes, by two-stage sorting."""
    size = len(text)
    wide = np.concatenate([text.astype(np.int16), [-1]])
    rises = np.sign(wide[1:] - wide[:-1])
    change = np.where(rises != 0, np.arange(size), size)
    nearest = np.minimum.accumulate(change[::-1])[::-1]  # where the run of equal bytes ends
    small = rises[nearest] > 0  # smaller than the successor
    key = _eights(text)
    direct = _sort_directly(np.flatnonzero(small), key)
    cuts = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([size - 1]))  # the last suffix is larger than what follows it: nothing
    out = []
    for c in range(256):
        own = [direct[cuts[c] : cuts[c + 1]]]
        part = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        induced = []
        while len(part):
            induced.append(part)
            part = part[part > 0] - 1
            part = part[(text[part] == c) & ~small[part]]
        waiting[c] = []
        bucket = np.concatenate(induced + own)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > c) & ~small[before]]
        heads = text[before]
        sort = np.argsort(heads, kind="stable")
        before, heads = before[sort], heads[sort]
        for d, a in zip(*np.unique(heads, return_index=True)):
            waiting[d].append(before[a : np.searchsorted(heads, d, side="right")])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeats(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of the given string starts, those whose string also starts at an earlier given one."""
    if not len(starts):
        return starts
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = suffix_array(text)
    order = order[wanted[order]]
    key = _eights(text)
    equal = np.ones(len(order) - 1, bool)
    for depth in (*range(0, LENGTH - 8, 8), LENGTH - 8):  # common prefix of neighbours
        left = np.flatnonzero(equal)
        equal[left] = key[order[left] + depth] == key[order[left + 1] + depth]
    group = np.concatenate([[0], np.cumsum(~equal)])
    first = np.full(group[-1] + 1, len(text))
    np.minimum.at(first, group, order)
    return np.sort(order[order != first[group]])


def _contexts(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """``h, id, start, context`` of the anchors ``h, id, place``."""
    wanted = firsts.groupBy("id").agg(F.collect_list(F.struct("h", "place")).alias("anchors"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, chosen in zip(batch.column("id"), batch.column("value"), batch.column("anchors")):
                raw = memoryview(text.as_buffer())
                h = chosen.values.field("h").to_numpy()
                place = chosen.values.field("place").to_numpy()
                low, end = place >> 14, (place >> 14) + (place >> 7 & 127) + LENGTH
                for a in range(0, len(h), 20_000):
                    part = slice(a, a + 20_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[part]), pa.array(np.full(len(h[part]), doc.as_py())), pa.array(low[part]), pa.array([bytes(raw[x:y]) for x, y in zip(low[part], end[part])], pa.binary())],
                        names=["h", "id", "start", "context"],
                    )

    return docs.join(wanted.hint("shuffle_hash"), F.col("_id") == F.col("id")).select("id", "value", "anchors").mapInArrow(task, "h long, id long, start long, context binary")


def _string_marks(contexts: DataFrame) -> DataFrame:
    """kind 1: marks ``id, start, end``. kind 3: strings of too large groups, ``d1, d2`` their digest, ``start`` their start."""
    names = ["kind", "id", "start", "end", "d1", "d2"]

    def rows(kind, ids, starts, ends=None, d1=None, d2=None) -> pa.RecordBatch:
        empty = pa.nulls(len(ids), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids), pa.array(starts), *(empty if x is None else pa.array(x) for x in (ends, d1, d2))], names=names)

    def strings(batch: pa.RecordBatch):
        data, at = flat_text(batch.column("context"))
        ids, start = batch.column("id").to_numpy(), batch.column("start").to_numpy()
        each = np.diff(at) - LENGTH + 1
        owner = np.repeat(np.arange(len(each)), each)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
        return data, at, ids, start, owner, inner

    def by_suffixes(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, at, ids, start, owner, inner = strings(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        found = repeats(data, at[owner] + inner)
        if len(found):
            own = np.searchsorted(at, found, side="right") - 1
            new = np.concatenate([[True], (found[1:] != found[:-1] + 1) | (own[1:] != own[:-1])])
            heads = np.flatnonzero(new)
            low, high, own = found[heads], found[np.append(heads[1:], len(found)) - 1], own[heads]
            begin = start[own] + low - at[own]
            yield rows(1, ids[own], begin, begin + high - low + LENGTH)

    def by_digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at, ids, start, owner, inner = strings(batch)
        hashes, a = SpanHashes(data), at[owner] + inner
        halves = hashes.of(a, a + LENGTH // 2), hashes.of(a + LENGTH // 2, a + LENGTH)
        return rows(3, ids[owner], start[owner] + inner, None, *(signed(x) for x in halves))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for key, group in _pieces(batches):
            if group is None:
                yield by_digests(key)
                continue
            held.append(group)
            size += group.nbytes
            if size >= BUFFER:
                yield from by_suffixes(held)
                held, size = [], 0
        if held:
            yield from by_suffixes(held)

    def _pieces(batches):
        """Whole groups; of groups above LARGEST, pieces instead (first of the pair, no group)."""
        now, parts, size, large = None, [], 0, False
        for part in (g for batch in batches for g in sorted_groups(iter([batch]), ("h",))):
            key = part.column("h")[0].as_py()
            if key != now:
                if parts:
                    yield None, pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                now, parts, size, large = key, [], 0, False
            size += part.nbytes
            parts.append(part)
            if large or size > LARGEST:
                yield from ((x, None) for x in parts)
                large, parts = True, []
        if parts:
            yield None, pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    return contexts.repartition("h").sortWithinPartitions("h", "id", "start").mapInArrow(task, "kind int, id long, start long, end long, d1 long, d2 long")


def _cut(docs: DataFrame) -> DataFrame:
    """docs: ``_id, value, marks``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, marks in zip(batch.column("value"), batch.column("marks")):
                raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                runs: list[list[int]] = []
                if marks.is_valid:
                    low, high = (marks.values.field(x).to_numpy() for x in ("start", "end"))
                    order = np.argsort(low, kind="stable")
                    for a, b in zip(low[order].tolist(), high[order].tolist()):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b)
                        else:
                            runs.append([a, b])
                ends = [0, *(x for run in runs for x in run), len(raw)]
                sizes.append(len(raw)), spans.append(len(runs)), removed.append(sum(b - a for a, b in runs))
                kept.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2])))
            longs = [pa.array(x, pa.int64()) for x in (sizes, removed, spans)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *longs, pa.array(kept, pa.binary())], names=["_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.mapInArrow(task, "_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup_strings(documents: DataFrame) -> DataFrame:
    """``_id, n_bytes, n_removed, n_spans, kept`` of every document; ``kept`` are the remaining bytes joined.

    Texts are UTF-8 bytes, a null one is empty; cuts may fall inside a character, so ``kept`` is binary. Strings never
    span documents. "Earlier" is a smaller id (null the smallest), or an earlier start in the same document. Rows that
    share an id count as one document (``one_row_per_id``). Other columns are not read; an empty table gives no rows.
    """
    docs = one_row_per_id(documents, "doc_id", "text")
    compared = save(_compared(_anchor_rows(docs)), "suffix-anchors")
    place = F.col("place")
    low = F.shiftright(place, 14)
    whole = compared.where("kind = 1").select("id", low.alias("start"), (low + F.shiftright(place, 7).bitwiseAND(F.lit(127)) + LENGTH).alias("end"))
    firsts = compared.where("kind = 2").select("h", "id", "place")
    strings = save(_string_marks(_contexts(IdFilter(firsts, "id").keep(docs, "_id"), firsts)), "suffix-marks")
    marks = whole.union(strings.where("kind = 1").select("id", "start", "end"))
    large = strings.where("kind = 3").select("id", "start", "d1", "d2")
    if not large.isEmpty():
        first = large.groupBy("d1", "d2").agg(F.min(F.struct("id", "start")).alias("first"))
        later = large.join(first, ["d1", "d2"]).where((F.col("id") != F.col("first.id")) | (F.col("start") != F.col("first.start")))
        marks = marks.union(later.select("id", "start", (F.col("start") + LENGTH).alias("end")))
    marked = marks.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("marks"))
    return _cut(docs.join(marked.hint("shuffle_hash"), F.col("_id") == F.col("id"), "left").select("_id", "value", "marks"))


def report(documents: DataFrame) -> DataFrame:
    return dedup_strings(documents).select(outer_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM b),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 200)) AS k FROM p),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM m),
t AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
r AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM t GROUP BY doc_id, run),
q AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS past FROM r),
k AS (
  SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS last,
         string_agg(substr(h, 2 * past + 1, 2 * (lo - past)), '' ORDER BY lo) AS head
  FROM q JOIN b USING (doc_id) GROUP BY doc_id
)
SELECT b.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(from_hex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN k ON b.doc_id = k.doc_id
"""
