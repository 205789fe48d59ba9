"""Benchmark decontamination by suffix arrays over the training text.

Training text is read in shards. A shard's words are numbered by the benchmark's vocabulary; a word that no item holds
ends a match and counts as a break, as does the end of a document. The suffixes of all stretches between breaks that are long
enough for one window are sorted: first by as many words as fit a machine word, then by doubling. Every suffix of every test item
is then looked up by binary search, one word deeper at a time, all of them at once; the range of training suffixes
that share the words so far is where the item's words occur. Ranges still open at the length of a window are verbatim matches with
their places; followed further they give the longest match. Documents with a match can be removed.

Words are compared whole: a training word gets a test word's number only if their bytes agree.

The test items are cut into blocks of at most ``ITEMS`` bytes, broadcast one block at a time; a long item is cut into
stretches that overlap by a window less one word. With one block (the usual benchmark) a single pass over the documents gives
the report and nothing is shuffled. With more, each block is a pass, and the hit places of a document are put together by its
id. Long documents are cut into shards that overlap likewise.

Defined cases: null texts have no words; items without words have no window. Documents that share an id are one document,
that with the greatest text (a null id is one more id). Items that share an id are one item with the windows of all its rows; a
null item id counts as one item and is written as an empty text. Empty tables: without documents no rows, without items
no hits. Other columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import NO_ID, flat_text, lean, mix, one_row_per_id, outer_id, runs_of_documents, save
from framelens.llm.terms import WORDS, eights, lowered, packed, spans

WINDOW = 10
#: Bytes of items in a block, words of an item in a stretch, bytes of training text read at once, words in a shard.
ITEMS, STRETCH, READ, SHARD = 4 << 20, 1 << 15, 2 << 20, 1 << 20


# --- words ----------------------------------------------------------------------------------------------------------


class Words:
    """The words of texts, A-Z in lower case: place, length, document, first sixteen bytes and a 64-bit hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = lowered(data)
        self.starts, self.lengths, self.doc = spans(data, offsets, WORDS)
        view = eights(self.data)
        self.heads = [packed(view, self.starts, self.lengths, i) for i in range(2)]
        self.hashes = mix(self.heads[0] + mix(self.heads[1] + self.lengths.astype(np.uint64)))
        self.long = np.flatnonzero(self.lengths > 16)
        for k in self.long:
            self.hashes[k] = int.from_bytes(hashlib.blake2b(self.text(k), digest_size=8).digest(), "little")

    def text(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.starts[k] + self.lengths[k]].tobytes()


class Vocabulary:
    """The distinct words of a block of items, numbered from 1 in order of their hashes."""

    def __init__(self, words: Words):
        self.hashes, first = np.unique(words.hashes, return_index=True)
        self.lengths, self.heads = words.lengths[first], [head[first] for head in words.heads]
        self.texts = {i: words.text(k) for i, k in enumerate(first.tolist()) if words.lengths[k] > 16}
        if (self.numbers(words) == 0).any():
            raise ValueError("two different test words share a 64-bit hash")

    def numbers(self, words: Words) -> np.ndarray:
        """The number of every word; 0 for words that are not in here, byte by byte."""
        out = np.zeros(len(words.hashes), np.int64)
        if not len(self.hashes) or not len(out):
            return out
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        equal = (self.hashes[at] == words.hashes) & (self.lengths[at] == words.lengths)
        for own, head in zip(self.heads, words.heads):
            equal &= own[at] == head
        for k in words.long[equal[words.long]]:
            equal[k] = words.text(k) == self.texts[int(at[k])]
        out[equal] = at[equal] + 1
        return out


# --- suffix arrays --------------------------------------------------------------------------------------------------


class SuffixArray:
    """Places of the suffixes of numbered words in sorted order; a suffix ends at the next break, a 0.

    ``numbers`` ends with a break. Stretches of fewer than ``least`` words between breaks hold no window and are left out.
    """

    def __init__(self, numbers: np.ndarray, least: int):
        self.numbers = numbers
        breaks = np.flatnonzero(numbers == 0)
        lengths = np.diff(breaks, prepend=-1) - 1
        keep = lengths >= max(least, 1)
        ends, lengths = breaks[keep], lengths[keep]
        end = np.repeat(ends, lengths)
        places = end - np.repeat(lengths, lengths) + np.arange(len(end)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.places = places[self._order(places, end - places)]

    def _order(self, places: np.ndarray, left: np.ndarray) -> np.ndarray:
        """By as many words as fit one number, then by doubling: a group of equals is ordered by the ranks that deep inside."""
        count = len(places)
        if not count:
            return np.zeros(0, np.int64)
        bits = int(self.numbers.max()).bit_length()
        deep = max(1, 62 // bits)
        key = np.zeros(count, np.int64)
        for k in range(deep):
            word = self.numbers[np.minimum(places + k, len(self.numbers) - 1)]
            key = (key << bits) | np.where(k < left, word, 0)
        order = np.argsort(key, kind="stable")
        new = np.append(True, np.diff(key[order]) != 0)
        index = np.full(len(self.numbers), -1)
        index[places] = np.arange(count)
        while True:
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, count))
            # equal suffixes that all end here are equal texts and stay as they are
            apart = (sizes > 1) & np.logical_or.reduceat(left[order] > deep, first)
            if not apart.any():
                return order
            rank = np.empty(count, np.int64)
            rank[order] = np.repeat(first, sizes)
            at = np.flatnonzero(np.repeat(apart, sizes))
            member = order[at]
            goes_on = left[member] > deep
            follow = np.zeros(len(member), np.int64)
            follow[goes_on] = rank[index[places[member[goes_on]] + deep]] + 1
            pair = rank[member] * (count + 1) + follow
            step = np.argsort(pair, kind="stable")
            order[at] = member[step]
            new[at[1:]] |= np.diff(pair[step]) != 0
            deep *= 2

    def find(self, test: np.ndarray, starts: np.ndarray, depth: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Range and length of the match of every test suffix: the first ``depth`` words, or the longest there is.

        With ``depth`` a suffix that does not match so far has an empty range. ``test`` ends with a break.
        """
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.places))
        length = np.zeros(len(starts), np.int64)
        live, k = np.flatnonzero(high > low), 0
        while len(live):
            word = test[starts[live] + k]
            live, word = live[word > 0], word[word > 0]
            a = self._bisect(low[live], high[live], word, k)
            b = self._bisect(a, high[live], word + 1, k)
            found = b > a
            if depth is not None:
                high[live[~found]] = low[live[~found]]
            live = live[found]
            low[live], high[live] = a[found], b[found]
            k += 1
            length[live] = k
            if depth is not None:
                live = live[depth[live] > k]
        return low, high, length

    def _bisect(self, low: np.ndarray, high: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
        """The first place in a range of suffixes, alike in ``k`` words, whose next word is not below ``word``."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            below = self.numbers[self.places[middle] + k] < word[open_]
            low[open_[below]] = middle[below] + 1
            high[open_[~below]] = middle[~below]
            open_ = open_[low[open_] < high[open_]]
        return low


# --- test items -----------------------------------------------------------------------------------------------------


def item_stretches(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item, first, short, text``: the words of every item, joined by spaces, in stretches of a bounded number of words.

    ``short`` is the number of words of an item that has fewer than a window, else 0; ``first`` the place in the item.
    """
    length = STRETCH

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_text(batch.column(1))
            words = Words(data, offsets)
            cuts = np.searchsorted(words.doc, np.arange(batch.num_rows + 1))
            rows = []
            for item, a, b in zip(batch.column(0).to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                for s in range(a, b, length):
                    if s == a or b - s >= window:
                        text = b" ".join(words.text(k) for k in range(s, min(b, s + length + window - 1)))
                        rows.append((item, s - a, b - a if b - a < window else 0, text.decode()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["item", "first", "short", "text"])

    types = [pa.string(), pa.int64(), pa.int32(), pa.string()]
    name = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    return items.where(F.col("text").isNotNull()).select(name, "text").mapInArrow(task, "item string, first long, short int, text string")


class Block:
    """A block of items as numbers: the suffixes that begin a window, how deep each goes, and its item."""

    def __init__(self, rows: list, window: int = WINDOW):
        texts = pa.array([row["text"] for row in rows], pa.large_string())
        words = Words(*flat_text(texts))
        self.vocabulary, self.window = Vocabulary(words), window
        names = sorted({row["item"] for row in rows}, key=str.encode)
        number = {name: i for i, name in enumerate(names)}
        self.names = np.array(names, object)
        self.test = np.zeros(len(words.starts) + len(rows), np.int64)
        places = np.arange(len(words.starts)) + words.doc
        self.test[places] = self.vocabulary.numbers(words)
        counts = np.bincount(words.doc, minlength=len(rows)) if len(rows) else np.zeros(0, np.int64)
        within = np.arange(len(words.starts)) - np.repeat(np.cumsum(counts) - counts, counts)
        short = np.array([row["short"] for row in rows], np.int64)[words.doc]
        begins = np.where(short > 0, within == 0, np.repeat(counts, counts) - within >= window)
        self.starts, self.depth = places[begins], np.where(short > 0, short, window)[begins]
        self.item = np.array([number[row["item"]] for row in rows], np.int64)[words.doc[begins]]
        self.at = within[begins] + np.array([row["first"] for row in rows], np.int64)[words.doc[begins]]
        self.least = int(self.depth.min()) if len(self.depth) else window


def blocks_of(items: DataFrame, window: int = WINDOW) -> Iterator[Block]:
    """All items, a bounded block at a time. Without any there is one empty block."""
    stretches = save(item_stretches(items, window), "benchmark-stretches")
    size = stretches.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // ITEMS))
    of = F.pmod(F.xxhash64("item", "first", "text"), F.lit(count))
    for k in range(count):
        yield Block(stretches.where(of == k).collect(), window)


# --- documents ------------------------------------------------------------------------------------------------------


class Shard(NamedTuple):
    """Documents ``rows`` of a batch; of their numbered words ``start`` on, with breaks, sorted."""

    rows: range
    counts: np.ndarray
    begins: np.ndarray
    start: int
    suffixes: SuffixArray


def shards(column: pa.Array, block: Block, overlap: int) -> Iterator[Shard]:
    """Suffix arrays over runs of documents; longer runs are cut with an overlap. ``begins``: where each document's words begin."""
    data, offsets = flat_text(column)
    for a, b in runs_of_documents(offsets, READ):
        words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        counts = np.bincount(words.doc, minlength=b - a)
        begins = np.append(0, np.cumsum(counts + 1))
        numbers = np.zeros(begins[-1], np.int64)
        numbers[np.arange(len(words.doc)) + words.doc] = block.vocabulary.numbers(words)
        del words
        for start in range(0, len(numbers), SHARD):
            part = np.append(numbers[start : start + SHARD + overlap], 0)
            yield Shard(range(a, b), counts, begins, start, SuffixArray(part, block.least))


def _places(suffixes: SuffixArray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places in ranges, and the number of the range of each."""
    sizes = high - low
    of = np.repeat(np.arange(len(low)), sizes)
    return suffixes.places[np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[of]], of


class Hits:
    """Hit words and items of one run of documents, gathered over its shards."""

    def __init__(self, size: int):
        self.marks = np.zeros(size + 1, bool)
        self.items: dict[int, list[np.ndarray]] = {}

    def add(self, shard: Shard, block: Block) -> None:
        low, high, _ = shard.suffixes.find(block.test, block.starts, block.depth)
        found = np.flatnonzero(high > low)
        if not len(found):
            return
        # equal windows have one range: it is looked at once, for all items that hold it
        key = np.stack([low[found], block.depth[found]], 1)
        ranges, of = np.unique(key, axis=0, return_inverse=True)
        of = of.ravel()
        one = found[np.unique(of, return_index=True)[1]]
        place, which = _places(shard.suffixes, low[one], high[one])
        place = place + shard.start
        marks = np.zeros(len(self.marks), np.int64)
        for depth in np.unique(ranges[:, 1]).tolist():
            own = place[ranges[which, 1] == depth]
            marks[own] += 1
            marks[own + depth] -= 1
        self.marks |= np.cumsum(marks) > 0
        pairs = np.unique(np.stack([np.searchsorted(shard.begins, place, side="right") - 1, which], 1), axis=0)
        order = np.argsort(of, kind="stable")
        first = np.searchsorted(of[order], np.arange(len(ranges) + 1))
        holders = block.item[found[order]]
        for doc, group in zip(*_grouped(pairs)):
            self.items.setdefault(doc, []).append(np.unique(np.concatenate([holders[first[r] : first[r + 1]] for r in group.tolist()])))


def _grouped(pairs: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    cuts = np.flatnonzero(np.diff(pairs[:, 0])) + 1
    return pairs[np.append(0, cuts), 0].tolist(), np.split(pairs[:, 1], cuts)


_HITS = "_id long, n_words long, starts array<long>, ends array<long>, items array<string>"


def _hits(rows: DataFrame, block: Block, every: bool) -> DataFrame:
    """Runs of hit words and items of every document, or of those that have some."""
    held = rows.sparkSession.sparkContext.broadcast(block)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            run, hits, last = None, None, None
            for shard in shards(batch.column(1), own, int(own.depth.max()) - 1 if len(own.depth) else 0):
                if shard.rows != run:
                    if run is not None:
                        yield result(ids, run, last, hits, own)
                    run, hits = shard.rows, Hits(int(shard.begins[-1]))
                hits.add(shard, own)
                last = shard
            if run is not None:
                yield result(ids, run, last, hits, own)

    def result(ids: list, run: range, shard: Shard, hits: Hits, own: Block) -> pa.RecordBatch:
        edges = np.flatnonzero(np.diff(hits.marks.astype(np.int8), prepend=0))
        begin, end = edges[0::2], edges[1::2]
        doc = np.searchsorted(shard.begins, begin, side="right") - 1
        cuts = np.searchsorted(doc, np.arange(len(run) + 1))
        out = []
        for k, row in enumerate(run):
            a, b = cuts[k], cuts[k + 1]
            if every or b > a:
                found = hits.items.get(k)
                items = own.names[np.unique(np.concatenate(found))].tolist() if found else []
                out.append((ids[row], int(shard.counts[k]), (begin[a:b] - shard.begins[k]).tolist(), (end[a:b] - shard.begins[k]).tolist(), items))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], names=names)

    names = ["_id", "n_words", "starts", "ends", "items"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
    return rows.mapInArrow(lean(task), _HITS)


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``_id, n_words, n_hit, items`` of every document: its words, those inside a window, and the items' ids in order."""
    rows = one_row_per_id(docs, "doc_id", "text")
    blocks = blocks_of(items, window)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda n, x: n + x)
        return _hits(rows, block, True).select("_id", "n_words", n_hit.alias("n_hit"), "items")
    counts = save(_hits(rows, block, True), "decontamination-hits")
    found = counts.where(F.size("items") > 0)
    while following is not None:
        found = found.unionByName(save(_hits(rows, following, False), "decontamination-hits"))
        following = next(blocks, None)
    covered = found.select("_id", F.explode(F.arrays_zip("starts", "ends")).alias("run")).select("_id", "run.starts", "run.ends")
    before = F.max("ends").over(Window.partitionBy("_id").orderBy("starts", "ends").rowsBetween(Window.unboundedPreceding, -1))
    own = F.greatest(F.lit(0), F.col("ends") - F.greatest("starts", F.coalesce("before", "starts")))
    n_hit = covered.withColumn("before", before).select("_id", own.alias("own")).groupBy("_id").agg(F.sum("own").alias("n_hit"))
    names = found.groupBy("_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    all_rows = counts.select("_id", "n_words").join(n_hit, "_id", "left").join(names, "_id", "left")
    return all_rows.select("_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    return hits(docs, items).select(
        outer_id().alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no window of any item, with all their columns. Rows that share an id go together."""
    bad = save(hits(docs, items, window).where("n_hit > 0").select("_id"), "contaminated")
    marked = docs.withColumn("_contaminated_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    bad = bad.withColumnRenamed("_id", "_contaminated_id")
    return marked.join(bad, "_contaminated_id", "left_anti").drop("_contaminated_id")


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item, item_at, doc_id, doc_at, words``: verbatim matches of at least a window (or a whole shorter item).

    Places count words from 0. A match is as long as the longest of its test suffix in the shard, and is not the rest of one
    that begins earlier. Shards end matches.
    """
    rows = one_row_per_id(docs, "doc_id", "text")
    found = None
    for block in blocks_of(items, window):
        part = save(_matches(rows, block), "decontamination-matches")
        found = part if found is None else found.unionByName(part)
    return found


def _matches(rows: DataFrame, block: Block) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(block)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for shard in shards(batch.column(1), own, int(own.depth.max()) - 1 if len(own.depth) else 0):
                low, high, length = shard.suffixes.find(own.test, own.starts)
                found = np.flatnonzero(length >= own.depth)
                place, of = _places(shard.suffixes, low[found], high[found])
                test = own.starts[found[of]]
                numbers = np.append(shard.suffixes.numbers, 0)  # the last one stands before the first
                head = (test == 0) | (numbers[place - 1] != own.test[test - 1]) | (own.test[test - 1] == 0)
                place, of = place[head], found[of[head]]
                doc = np.searchsorted(shard.begins, place + shard.start, side="right") - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(own.names[own.item[of]].tolist(), pa.string()), pa.array(own.at[of], pa.int64()), batch.column(0).take(pa.array(doc + shard.rows.start)),
                    pa.array(place + shard.start - shard.begins[doc], pa.int64()), pa.array(length[of], pa.int64()),
                ], names=["item", "item_at", "_id", "doc_at", "words"])

    out = rows.mapInArrow(lean(task), "item string, item_at long, _id long, doc_at long, words long")
    return out.select("item", "item_at", outer_id().alias("doc_id"), "doc_at", "words")


SQL = rf"""
WITH words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), tests AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS MATERIALIZED (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS gram
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS size FROM tests WHERE len(w) > 0))
), places AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size
), found AS MATERIALIZED (
  SELECT doc_id, item_id, pos, size
  FROM (SELECT doc_id, size, pos, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS gram FROM places) JOIN windows USING (size, gram)
), hit AS (
  SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM found) GROUP BY doc_id
), held AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(held.n, 0) AS n_items,
  sha256(coalesce(held.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
"""
