"""Best-fit packing: best-two-fit over token counts.

Documents become token ids and an end id; only longer ones than a sequence are cut, into full pieces behind a first that may be
shorter. A sequence is filled greedily with the longest pieces that fit; then its smallest piece gives way to two
unpacked pieces that fill the widened gap more tightly, where there are such.

Pieces of equal length are alike to the packer, so it works on the count of pieces per length, at most one number for
each length up to that of a sequence, whatever the corpus: the same filling is repeated while the counts last, which is
what packing piece by piece would do. The plan (fillings and how often each) is of like bound and goes to all tasks.
A piece finds its place from its length and its rank among pieces of that length. Ranks come in two steps, rank within
a chunk of rows noted while tokenising, and a running sum over chunks; no length has to fit one task.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import SpanHashes, flat_text, lean, runs_of_documents, save

TOKENS = 2048
END_ID = 0
CACHE_CHUNKS = 1 << 20
#: Bytes of text that a task takes at once.
BLOCK = 1 << 19

# --- tokens ---------------------------------------------------------------------------------------------------------

#: What a byte is, as bits.
_SPACE, _PLAIN, _WORD, _STOP = 1, 2, 4, 8
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[0x21:0x7F] = _PLAIN
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] |= _WORD
_STOPS = b".,;:!?*#$%&)"


class Tokens:
    """Token ids of texts, by the tokenizer itself on distinct chunks.

    A byte-level vocabulary of this kind never joins a byte that is no white space with white space after it. Texts
    are cut there, so a chunk is white space and what follows it, and each distinct chunk is encoded once. Cuts are
    made only after plain ASCII and after letters of two bytes starting with C3; elsewhere chunks just stay longer.
    Nor does it join a letter or digit with a stop after it, so a word is the same chunk before any of ``_STOPS`` that no
    added token of the vocabulary contains.
    A worker keeps up to ``CACHE_CHUNKS`` chunks.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel part
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path)
        added = "".join(t.content for t in self.encode.get_added_tokens_decoder().values())
        self.kind = _KIND.copy()
        self.kind[[c for c in _STOPS if chr(c) not in added]] |= _STOP
        self.clear()

    def clear(self) -> None:
        self.known, self.begin, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.slot = np.zeros(0, np.int64)

    def _learn(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Slots of new chunks, whose hashes belong at ``at`` among the known."""
        raw = memoryview(data)
        found = self.encode.encode_batch_fast([bytes(raw[a:b]).decode() for a, b in zip(starts.tolist(), ends.tolist())], add_special_tokens=False)
        ids = [x.ids for x in found]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        slots = len(self.begin) - 1 + np.arange(len(ids))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))])
        self.known, self.slot = np.insert(self.known, at, hashes), np.insert(self.slot, at, slots)
        return slots

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, and where each document's begin."""
        count = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(count + 1, np.int64)
        cut, kind = np.zeros(len(data), bool), self.kind[data]
        before, after = kind[:-1], kind[1:]
        two = data[:-2] == 0xC3
        spaced, stopped = (before & _PLAIN) != 0, (before & _WORD) != 0
        spaced[1:] |= two & (data[1:-1] >= 0x80)
        stopped[1:] |= two & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)  # all letters but two
        cut[1:] = ((after & _SPACE) != 0) & spaced | ((after & _STOP) != 0) & stopped
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        distinct, first, which = np.unique(SpanHashes(data).of(starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_CHUNKS:
            self.clear()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        slot = np.empty(len(distinct), np.int64)
        slot[~new] = self.slot[at[~new]]
        if new.any():
            slot[new] = self._learn(data, distinct[new], starts[first[new]], ends[first[new]], at[new])
        slot = slot[which]
        sizes = self.begin[slot + 1] - self.begin[slot]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.arange(upto[-1]) + np.repeat(self.begin[slot] - upto[:-1], sizes)]
        return ids, upto[np.searchsorted(starts, offsets, side="left")]


_HELD: dict[str, Tokens] = {}


def pieces(documents: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",), *, ids: bool = False, tokens: int = TOKENS) -> DataFrame:
    """One row per piece: columns ``keep``, ``piece, start, length, ids_crc32, chunk, local`` and, if asked for, ``ids``.

    ``ids`` are little-endian 32-bit numbers, ``ids_crc32`` is the unsigned CRC-32 of them.
    ``local`` counts the pieces of that length before in the same ``chunk``.
    """
    wanted = ids

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _HELD.setdefault(tokenizer, None) or Tokens(tokenizer)
        _HELD[tokenizer] = held
        chunk, seen = TaskContext.get().partitionId(), np.zeros(tokens + 1, np.int64)
        for batch in batches:
            data, offsets = flat_text(batch.column(batch.num_columns - 1))
            for a, b in runs_of_documents(offsets, BLOCK):
                ids, begin = held.of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sizes = np.diff(begin) + 1
                each = -(-sizes // tokens)
                owner = np.repeat(np.arange(b - a), each)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
                head = (sizes - (each - 1) * tokens)[owner]
                length = np.where(piece == 0, head, tokens)
                start = np.where(piece == 0, 0, head + (piece - 1) * tokens)
                local = np.zeros(len(owner), np.int64)
                order = np.argsort(length, kind="stable")
                run = np.concatenate([[True], length[order][1:] != length[order][:-1]])
                at = np.arange(len(owner))
                local[order] = at - np.maximum.accumulate(np.where(run, at, 0))
                local += seen[length]
                seen += np.bincount(length, minlength=tokens + 1)
                end = np.array([END_ID], "<u4").tobytes()
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                content, sums = [], []
                for d, s, n, last in zip(owner.tolist(), start.tolist(), length.tolist(), (piece == each[owner] - 1).tolist()):
                    x = begin[d] + s
                    part = raw[4 * x : 4 * (x + n - last)]
                    sums.append(zlib.crc32(end, zlib.crc32(part)) if last else zlib.crc32(part))
                    if wanted:
                        content.append(bytes(part) + (end if last else b""))
                rows = pa.array(owner + a)
                longs = [pa.array(x) for x in (start, length)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(rows) for i in range(len(keep))), pa.array(piece.astype(np.int32)), *longs, pa.array(sums, pa.int64()), pa.array(np.full(len(owner), chunk)), pa.array(local), *([pa.array(content, pa.binary())] if wanted else [])],
                    names=[*keep, "piece", "start", "length", "ids_crc32", "chunk", "local", *(["ids"] if wanted else [])],
                )

    given = documents.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(lean(task), f"{columns}, piece int, start long, length long, ids_crc32 long, chunk long, local long" + (", ids binary" if ids else ""))


# --- the plan -------------------------------------------------------------------------------------------------------


@dataclass
class Plan:
    """Per filling and length: how often (``times``), its first sequence, and where its copies of the length lie."""

    length: np.ndarray  # sorted; rows of one length by rank
    rank: np.ndarray  # first rank among the length's pieces that this row places
    sequence: np.ndarray
    places: list[tuple[int, ...]]


def best_two_fit(counts: np.ndarray, tokens: int = TOKENS) -> list[tuple[list[int], int]]:
    """Fillings (lengths, longest first) and how often each is used; ``counts[n]`` pieces have length n."""
    left = counts.astype(np.int64).copy()
    found = []
    while True:
        open_ = np.flatnonzero(left)
        if not len(open_):
            return found
        filling, used, gap = [], {}, tokens
        while True:
            fits = open_[open_ <= gap]
            while len(fits) and left[fits[-1]] <= used.get(int(fits[-1]), 0):
                fits = fits[:-1]
            if not len(fits):
                break
            n = int(fits[-1])
            filling.append(n)
            used[n] = used.get(n, 0) + 1
            gap -= n
        smallest = filling[-1]
        if gap and len(filling) > 1:
            used[smallest] -= 1
            two = _two(left, used, open_, gap + smallest, smallest)
            if two:
                filling = sorted([*filling[:-1], *two], reverse=True)
        need = np.bincount(filling, minlength=len(left))
        times = int((left[filling] // need[filling]).min())
        left -= need * times
        found.append((filling, times))


def _two(left: np.ndarray, used: dict[int, int], open_: np.ndarray, room: int, smallest: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum of at most ``room``, above ``smallest``."""
    spare = left[open_] - np.array([used.get(n, 0) for n in open_.tolist()])
    free, spare = open_[(spare > 0) & (open_ < room)], spare[(spare > 0) & (open_ < room)]
    if not len(free):
        return None
    at = np.searchsorted(free, room - free, side="right") - 1
    at = np.where((at == np.arange(len(free))) & (spare < 2), at - 1, at)
    sums = np.where(at >= 0, free + free[np.maximum(at, 0)], -1)
    best = int(sums.argmax())
    return (int(free[best]), int(free[at[best]])) if sums[best] > smallest else None


def make_plan(counts: np.ndarray, tokens: int = TOKENS) -> Plan:
    rows, first, placed = [], 0, np.zeros(len(counts), np.int64)
    for filling, times in best_two_fit(counts, tokens):
        offset, places = 0, {}
        for n in filling:
            places.setdefault(n, []).append(offset)
            offset += n
        for n, own in places.items():
            rows.append((n, int(placed[n]), first, tuple(own)))
            placed[n] += len(own) * times
        first += times
    rows.sort(key=lambda r: r[:2])
    return Plan(*(np.array([r[i] for r in rows], np.int64) for i in range(3)), [r[3] for r in rows])


def pack(cut: DataFrame, *, tokens: int = TOKENS) -> DataFrame:
    """The pieces of a written table of ``pieces`` with ``sequence_id, offset``; ``chunk`` and ``local`` go."""
    by_chunk = cut.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    totals = by_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most one row a length
    counts = np.zeros(tokens + 1, np.int64)
    for row in totals:
        counts[row["length"]] = row["n"]
    plan = cut.sparkSession.sparkContext.broadcast(make_plan(counts, tokens))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    firsts = by_chunk.select("length", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cut.join(firsts, ["length", "chunk"]).withColumn("_rank", F.col("local") + F.col("before")).select(*[c for c in cut.columns if c not in ("chunk", "local")], "_rank")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = plan.value
        code = held.length * (1 << 44) + held.rank
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy()
            row = np.searchsorted(code, length * (1 << 44) + rank, side="right") - 1
            each = np.array([len(held.places[r]) for r in row.tolist()], np.int64) if len(row) else row
            inner = rank - held.rank[row]
            offset = [held.places[r][k] for r, k in zip(row.tolist(), (inner % np.maximum(each, 1)).tolist())]
            sequence = held.sequence[row] + inner // np.maximum(each, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset, pa.int64())], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(task, f"{columns}, sequence_id long, offset long")


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def sequences(documents: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every row.

    Null and empty texts are the end id alone. Repeated rows and null ids are rows like others; each is packed. A text
    may hold the vocabulary's special tokens, which the tokenizer reads as such. Pieces are packed in full, offsets in a
    sequence have no gaps. Other columns are not read; an empty table gives no rows.
    """
    return pack(save(pieces(documents, tokenizer or public_tokenizer()), "pack-pieces")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
