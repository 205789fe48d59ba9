"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

A word is a run of letters. Its score for a language is the log-likelihood of its byte n-grams under counts learned from
labelled documents; a language takes part only for scripts its own words use. Viterbi with a switching penalty then
labels each text in spans, so mixed texts come apart. The document's language is that of most of its letters.

The model is fitted in tasks on a bounded sample: up to about ``SAMPLE`` documents a language, drawn by a hash of the
id, whole texts. It is ``2 ** TABLE_BITS`` rows a language, whatever the corpus. Prediction is one pass without a
shuffle; distinct words of a block of texts are scored once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import SpanHashes, flat_text, lean, mix, runs_of_documents

SAMPLE = 1000
TABLE_BITS = 16
ORDERS = (1, 2, 3, 4)
SWITCH = 12.0
FOREIGN = -1e4
BLOCK = 1 << 20
#: Distinct words whose n-grams are scored at once.
SCORED = 1 << 13

#: First code points of script ranges, and the script from there on.
SCRIPTS = (
    (0x0000, "common"), (0x0041, "latin"), (0x005B, "common"), (0x0061, "latin"), (0x007B, "common"), (0x00AA, "latin"),
    (0x00AB, "common"), (0x00BA, "latin"), (0x00BB, "common"), (0x00C0, "latin"), (0x00D7, "common"), (0x00D8, "latin"), (0x00F7, "common"), (0x00F8, "latin"), (0x0300, "common"),
    (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "odia"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "common"), (0x2C00, "other"), (0x2E80, "han"), (0x3000, "common"), (0x3040, "kana"), (0x3100, "other"),
    (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0xFB50, "arabic"), (0xFE00, "common"), (0xFE70, "arabic"), (0xFF00, "common"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "common"),
    (0x10000, "other"), (0x1F000, "common"), (0x20000, "han"), (0x31350, "other"),
)
_NAMES = ["common", *sorted({s for _, s in SCRIPTS} - {"common"})]
_FROM = np.array([x for x, _ in SCRIPTS])
_SCRIPT = np.array([_NAMES.index(s) for _, s in SCRIPTS])
_IN_WORD = np.zeros(256, bool)
_IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


@dataclass
class Model:
    """Log-probabilities of n-gram rows (rows x languages) and which languages use which script."""

    languages: list[str]
    table: np.ndarray
    uses: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and code points of the characters of UTF-8 bytes."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    a, b, c, d = (padded[at + i].astype(np.int32) for i in range(4))
    two, three = (a & 0x1F) << 6 | b & 0x3F, (a & 0x0F) << 12 | (b & 0x3F) << 6 | c & 0x3F
    four = (a & 0x07) << 18 | (b & 0x3F) << 12 | (c & 0x3F) << 6 | d & 0x3F
    return at, np.select([a < 0x80, a < 0xE0, a < 0xF0], [a, two, three], four)


@dataclass
class Words:
    """Words of a block of texts, distinct ones apart."""

    starts: np.ndarray
    ends: np.ndarray
    document: np.ndarray
    first: np.ndarray  # a place of each distinct word
    which: np.ndarray  # the distinct word of each word
    scripts: np.ndarray  # of each distinct word
    letters: np.ndarray  # of each word


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(data) else inside
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    if len(starts):
        _, first, which = np.unique(SpanHashes(data, lower=True).of(starts, ends), return_index=True, return_inverse=True)
        at, points = _code_points(data)
        letters_upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        script = _SCRIPT[np.searchsorted(_FROM, points, side="right") - 1]
        highest = np.maximum.reduceat(np.concatenate([script, [0]]), letters_upto[starts])  # up to the next word's start: what lies between is common
        scripts, letters, first = highest[first], letters_upto[ends] - letters_upto[starts], starts[first]
        real = scripts[which] > 0  # signs alone are no word
        if not real.all():
            starts, ends, which, letters = starts[real], ends[real], which[real], letters[real]
    else:
        first = which = scripts = letters = np.zeros(0, np.int64)
    return Words(starts, ends, np.searchsorted(offsets, starts, side="right") - 1, first, which, scripts, letters)


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all n-grams of the words (with both ends marked), and the word of each."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = ends - starts + 2
    begin = np.concatenate([[0], np.cumsum(sizes)])
    word = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(begin[-1]) - begin[word]
    inner = (place > 0) & (place < sizes[word] - 1)
    flat = np.zeros(begin[-1] + max(ORDERS), np.uint64)
    flat[: begin[-1]][inner] = _LOWER[data[(starts[word] + place - 1)[inner]]].astype(np.uint64) + np.uint64(1)
    rows, owners = [], []
    for n in ORDERS:
        fits = np.flatnonzero(place + n <= sizes[word])
        code = np.full(len(fits), n, np.uint64)
        for k in range(n):
            code += flat[fits + k] * _ODD[k]
        rows.append((mix(code) >> np.uint64(64 - TABLE_BITS)).astype(np.int64))
        owners.append(word[fits])
    return np.concatenate(rows), np.concatenate(owners)


def fit(documents: DataFrame, *, sample: int = SAMPLE) -> Model:
    """Learn from text and language of the documents that are not held out (an id is needed for that)."""
    learn = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    share = {r["lang"]: min(1.0, sample / r["count"]) for r in learn.groupBy("lang").count().collect()}  # one row a language
    languages = sorted(share)
    if not languages:
        return Model([], np.zeros((1 << TABLE_BITS, 0), np.float32), np.ones((len(_NAMES), 0), bool))
    ranked = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, share[k])]), F.col("lang")) * (1 << 20))
    code = {k: i for i, k in enumerate(languages)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, scripts = np.zeros((len(code), 1 << TABLE_BITS), np.int64), np.zeros((len(code), len(_NAMES)), np.int64)
        for batch in batches:
            own = np.array([code[x] for x in batch.column("lang").to_pylist()], np.int64)
            data, offsets = flat_text(batch.column("text"))
            for a, b in runs_of_documents(offsets, BLOCK):
                block, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                words = find_words(block, at)
                for k in np.unique(own[a:b]):
                    mine = own[a:b][words.document] == k
                    rows, _ = _grams(block, words.starts[mine], words.ends[mine])
                    counts[k] += np.bincount(rows, minlength=1 << TABLE_BITS)
                    scripts[k] += np.bincount(words.scripts[words.which[mine]], minlength=len(_NAMES))
        for kind, held in (("gram", counts), ("script", scripts)):
            k, row = np.nonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(k)), pa.array(k), pa.array(row), pa.array(held[k, row])], names=["kind", "k", "row", "n"])

    found = learn.where(ranked).mapInArrow(lean(task), "kind string, k long, row long, n long").groupBy("kind", "k", "row").agg(F.sum("n").alias("n")).toPandas()  # bounded: rows of the table
    counts, scripts = np.zeros((1 << TABLE_BITS, len(languages))), np.zeros((len(_NAMES), len(languages)))
    for kind, held in (("gram", counts), ("script", scripts)):
        part = found[found["kind"] == kind]
        held[part["row"], part["k"]] = part["n"]
    logs = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * len(counts)))
    return Model(languages, ((logs - logs.max(1, keepdims=True)) / len(ORDERS)).astype(np.float32), scripts > 0.005 * scripts.sum(0))


def word_scores(model: Model, data: np.ndarray, words: Words) -> np.ndarray:
    """Score of each distinct word for each language; languages that do not use its script are out, unless none does."""
    sizes = np.zeros(len(words.first), np.int64)
    sizes[words.which] = words.ends - words.starts
    scores = np.zeros((len(sizes), len(model.languages)))
    for s in range(0, len(sizes), SCORED):
        part = slice(s, s + SCORED)
        rows, owners = _grams(data, words.first[part], words.first[part] + sizes[part])
        for k in range(len(model.languages)):
            scores[part, k] = np.bincount(owners, model.table[rows, k], minlength=len(sizes[part]))
    uses = model.uses[words.scripts]
    return np.where(uses | ~uses.any(1, keepdims=True), scores, FOREIGN).astype(np.float32)


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every word; words of document d are ``offsets[d]:offsets[d + 1]``. All documents step at once."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = offsets[:-1][order], sizes[order]
    alive = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")  # documents longer than t
    kind = np.min_scalar_type(max(scores.shape[1], 1))  # as narrow as the number of labels allows
    back, last = np.zeros(scores.shape, kind), np.zeros((len(sizes), scores.shape[1]), np.float32)
    own = np.arange(scores.shape[1], dtype=kind)
    for t, k in enumerate(alive):
        held, at = last[:k], begin[:k] + t
        if t:
            best = held.argmax(1)
            moved = (held[np.arange(k), best] - switch)[:, None]
            stays = held >= moved
            back[at] = np.where(stays, own, best[:, None].astype(kind))
            held = np.where(stays, held, moved)
        last[:k] = held + scores[at]
    labels = np.zeros(len(scores), kind)
    state = last.argmax(1)
    for t in range(len(alive) - 1, -1, -1):
        k = alive[t]
        at = begin[:k] + t
        labels[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return labels


def _label(model: Model, data: np.ndarray, offsets: np.ndarray, spans: bool) -> tuple[list, list, list]:
    count = len(offsets) - 1
    words = find_words(data, offsets)
    names, shares, found = ["und"] * count, [0.0] * count, [[] for _ in range(count)]
    if len(words.starts) and model.languages:
        upto = np.searchsorted(words.document, np.arange(count + 1), side="left")
        labels = viterbi(word_scores(model, data, words)[words.which], upto)
        held = np.zeros((count, len(model.languages)))
        np.add.at(held, (words.document, labels), words.letters)
        total, best = held.sum(1), held.argmax(1)
        for d in np.flatnonzero(total):
            names[d], shares[d] = model.languages[best[d]], float(held[d, best[d]] / total[d])
        if spans:
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            new = np.ones(len(labels), bool)
            new[1:] = (labels[1:] != labels[:-1]) | (words.document[1:] != words.document[:-1])
            heads = np.flatnonzero(new)
            for a, b in zip(heads, np.append(heads[1:], len(labels)) - 1):
                d = words.document[a]
                found[d].append({"start": int(chars[words.starts[a]] - chars[offsets[d]]), "end": int(chars[words.ends[b]] - chars[offsets[d]]), "lang": model.languages[labels[a]]})
    # letters that no word holds, or none learned: ask the text itself
    for d in range(count):
        if names[d] != "und" and not (64 < _first_letter(data, offsets, d) < 128):
            text = data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace")
            if not any(map(str.isalpha, text)):
                names[d], shares[d], found[d] = "und", 0.0, []
        elif names[d] == "und" and model.languages and offsets[d + 1] > offsets[d]:
            if any(map(str.isalpha, data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))):
                names[d] = model.languages[0]
    return names, shares, found


def _first_letter(data: np.ndarray, offsets: np.ndarray, d: int) -> int:
    """Some ASCII letter of the document's first bytes, or 0: spares decoding the text."""
    part = data[offsets[d] : min(offsets[d] + 4096, offsets[d + 1])]
    hit = part[_IN_WORD[part] & (part < 128)]
    return int(hit[0]) if len(hit) else 0


def identify(documents: DataFrame, model: Model, *, spans: bool = False) -> DataFrame:
    """All rows and columns of ``documents`` with ``lang_pred, score`` and, if asked for, ``lang_spans`` added.

    ``lang_pred``: a learned language, or ``und`` where the text is null or has no letter (or nothing was learned).
    ``score``: share of the letters that lie in spans of that language, 0 for ``und``. A text whose letters are of
    scripts that no learned language uses keeps its best guess. Only ``text`` is read. Equal texts get equal answers,
    repeated rows and null ids are rows like others; columns of these names are replaced.
    """
    added = {"lang_pred": "string", "score": "double"} | ({"lang_spans": "array<struct<start:int,end:int,lang:string>>"} if spans else {})
    kept = documents.drop(*added)
    held = documents.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            data, offsets = flat_text(batch.column(at))
            for a, b in runs_of_documents(offsets, BLOCK):
                names, shares, found = _label(held.value, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], spans)
                new = [pa.array(names, pa.string()), pa.array(shares, pa.float64())] + ([pa.array(found, span_type)] if spans else [])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *new], names=[*batch.schema.names, *added])

    from pyspark.sql import types as T

    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in added.items())).fields])
    return kept.mapInArrow(lean(task), schema)


def report(documents: DataFrame) -> DataFrame:
    model = fit(documents)
    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
