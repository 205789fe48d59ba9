"""Vector codes, source divergence and benchmark decontamination against plain versions, with every awkward case."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.llm import common, decontamination, divergence, vector_codes
from framelens.llm.common import join_by_size
from framelens.llm.terms import LETTERS, eights, packed, radix_order, spans
from tests.llm import cases
from tests.llm.test_vectors_pages import sound, vectors

# --- vector codes ---------------------------------------------------------------------------------------------------


def labelled(spark, rows, label=lambda i: None if i is None or i % 4 == 0 else i % 4):
    df = spark.createDataFrame([(i, v, label(i)) for i, v in rows], "vec_id long, embedding array<double>, label int")
    for name in ("id", "v", "code", "error", "unlabelled", "total", "part", "n"):
        df = df.withColumn(name, F.lit("other"))
    return df


def plain_codes(rows, label, entries=16, rounds=6, parts=8):
    """Python's whole numbers all the way."""
    kept = [(i, v, label(i)) for i, v in rows if sound(v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    whole = [[math.floor(x * 4096) if abs(x) < 2.0**61 else int(x) * 4096 for x in v] + [0] * (width * parts - len(v)) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    cut = [[w[p * width : (p + 1) * width] for w in whole] for p in range(parts)]
    books = [[list(cut[p][k]) for k in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p: [min((gap(x, e), k) for k, e in enumerate(books[p])) for x in cut[p]]
    for _ in range(rounds):
        for p in range(parts):
            best = [k for _, k in nearest(p)]
            for e in range(len(books[p])):
                own = [x for x, k in zip(cut[p], best) if k == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    best = [nearest(p) for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(b[i][0] for b in best) for i in range(len(kept))]
    total = Counter()
    for (_, _, name), e in zip(kept, errors):
        total[name] += e
    fits = lambda x: x if x < 1 << 63 else None
    broken = {name for (_, _, name), e in zip(kept, errors) if fits(e) is None}
    return [(i, "".join(f"{b[k][1]:02x}" for b in best), fits(errors[k]), None if name in broken else fits(total[name]), digest) for k, (i, _, name) in enumerate(kept)]


@pytest.mark.parametrize("scale", [1.0, 2.0**17, 2.0**40])
def test_vector_codes(spark, scale):
    rows = [(i, None if v is None else [None if x is None else x * scale for x in v]) for i, v in vectors(count=150, width=24)]
    label = lambda i: None if i is None or i % 4 == 0 else i % 4
    want = plain_codes(rows, label)
    got = [tuple(r) for r in vector_codes.report(labelled(spark, rows, label)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 100


def test_vector_codes_few_rows_and_empty(spark):
    rows = [(9, [1.0, -1e-9, 3.0]), (9, [1.0, -1e-9, 3.0]), (None, [2.5]), (4, []), (5, None), (1, [float("nan")]), (2, [1e300, 0.0, 1.0])]
    label = lambda i: None
    got = [tuple(r) for r in vector_codes.report(labelled(spark, rows, label)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_codes(rows, label)))
    assert vector_codes.report(labelled(spark, [])).collect() == [] and vector_codes.report(labelled(spark, rows[4:6])).collect() == []


def test_codes_decode_and_limbs_are_exact(spark):
    books = vector_codes.fit(labelled(spark, vectors(count=240, width=16)), entries=4, rounds=2)
    rows = vector_codes.encode(labelled(spark, vectors(count=240, width=16)), books, ("label",)).collect()
    back = books.decode([r["code"] for r in rows])
    assert back.shape == (len(rows), 16) and rows[0]["label"] is None
    rng = np.random.default_rng(4)
    for top in (20, 30, 45, 60, 90):
        x = np.array([[int(v) << max(0, top - 30) for v in row] for row in rng.integers(-(2 ** min(top, 30)), 2 ** min(top, 30), (9, 5))], object)
        y = x[:4] - 1
        if top <= 60:
            x, y = x.astype(np.int64), y.astype(np.int64)
        bits = vector_codes.limb_bits(5)
        assert 5 * (2 ** (2 * bits)) < 2**53
        assert sum(np.asarray(p, object) << (bits * k) for k, p in enumerate(vector_codes.limbs(x, bits))).tolist() == x.tolist()
        assert [[int(v) for v in row] for row in vector_codes.products(x, y)] == [[sum(int(a) * int(b) for a, b in zip(r, e)) for e in y] for r in x]


def test_join_by_size_splits_hot_keys(spark):
    rows = common.save(spark.range(4000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id) END AS k", "id"), "rows")
    table = common.save(rows.groupBy("k").count(), "table")
    got = join_by_size(rows, table, ["k"], limit=10)
    assert got.count() == 4000 and {r["count"] for r in got.where("k = 'hot'").collect()} == {1334}


# --- source divergence ----------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(rows, least):
    counts, seen, groups = {}, Counter(), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = Counter(cases.lower(t) for t in TERM.findall(text or ""))
        own = counts.setdefault((lang, source), Counter())
        own.update(found)
        seen.update((lang, t) for t in found)
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for (g, t), n in seen.items() if g == lang and n >= least)
        sources = sorted(s for g, s in groups if g == lang)
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        every = Counter()
        for s in sources:
            every.update(counts[lang, s])
        q, p = share(every), {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms[:50])]
    return out


def divergent_rows():
    rng = random.Random(8)
    vocabulary = [rng.choice(["a", "Eß", "word", "señor", "internationalisation", "überaus"]) + "".join(rng.choice("abcdefgé") for _ in range(rng.randint(0, 14))) for _ in range(36)]
    rows = [(i % 70, "".join(rng.choice([" ", "1", "-", "\n", "_", "\x7f"]) + w for w in rng.choices(vocabulary, k=rng.randint(0, 60))), rng.choice(["x", "y", None, "z"]), rng.choice(["s1", "é", None, "t"]), 0) for i in range(200)]
    rows += [(None, None, None, None, None), (1, "", "empty", "a", 0), (2, "12 34", "empty", "b", 0), (3, "lone", "lone", "only", 0), (4, "Ä" * 5000 + " " + "q" * 70000, "x", "s1", 0)]
    return rows + rows[:5]


@pytest.mark.parametrize("sources", [256, 2])
def test_source_divergence(spark, monkeypatch, sources):
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "BUCKET", 16)
    monkeypatch.setattr(divergence, "BLOCK", 2000)
    rows = divergent_rows()
    got = [tuple(r) for r in divergence.report(cases.frame(spark, rows)).collect()]
    want = plain_divergence(rows, 30)
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(r[2] == "term" for r in want) > 40
    assert any(r[2] == "pair" and r[4] == 0 for r in want)


def test_source_divergence_empty_and_textless(spark):
    assert divergence.report(cases.frame(spark, [])).collect() == []
    got = divergence.report(cases.frame(spark, [(1, None, "l", "b", 0), (2, "", "l", "a", 0)])).collect()
    assert sorted(map(tuple, got)) == [("l", "a", "pair", "b", 0, 1), ("l", "b", "pair", "a", 0, 1)]


def test_packed_terms_sort_as_bytes():
    data = np.frombuffer("zeta\x00ab abc été abcdefgh abcdefghi abcdefghijklmnop q".encode(), np.uint8)
    starts, lengths, doc = spans(data, np.array([0, 6, 6, len(data)]), LETTERS)
    texts = [data[s : s + n].tobytes() for s, n in zip(starts, lengths)]
    assert texts[:3] == [b"zeta", b"a", b"b"] and doc[:3].tolist() == [0, 0, 2]
    words = [packed(eights(data), starts, lengths, i) for i in range(2)]
    assert [texts[i] for i in radix_order(*words)] == sorted(texts)


# --- benchmark decontamination --------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(rows, items):
    tests = [("" if i is None else str(i), WORD.findall(cases.lower(t or ""))) for i, t in items]
    windows: dict = {}
    for name, w in tests:
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(name)
    sizes, out = {len(x) for x in windows}, set()
    for i, text in cases.by_id(rows).items():
        w = WORD.findall(cases.lower(text))
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found, key=str.encode)).encode()).hexdigest()
        out.add((cases.shown(i), len(w), len(hit), len(found), digest, bool(hit)))
    return out


def benchmark(rows):
    w = [WORD.findall(r[1] or "") for r in rows]
    long = next(x for x in w if len(x) > 5000)
    return [
        (1, " ".join(w[0][:14])), (10, "No, " + "-".join(w[0][3:16]).upper() + "!"), (2, " ".join(w[5][:10])), (None, " ".join(w[7][2:13])), (3, None), (4, "?!"), (5, "one"),
        (6, "one two three"), (2, "nothing here at all that any document holds in this way ok"), (7, " ".join(long[100:900])), (8, "ka " * 12), (9, "x" * 1500), (11, " ".join(long[-30:])), (12, "ab" * 400),
    ]


@pytest.mark.parametrize("small", [False, True])
def test_decontamination(spark, monkeypatch, small):
    if small:
        for name, value in (("ITEMS", 1500), ("STRETCH", 50), ("READ", 3000), ("SHARD", 300)):
            monkeypatch.setattr(decontamination, name, value)
    rows = cases.documents()
    items = benchmark(rows)
    frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS item", "1 AS first", "2 AS short", "3 AS doc_id")
    want = plain_hits(rows, items)
    got = {tuple(r) for r in decontamination.report(cases.frame(spark, rows), frame).collect()}
    assert got == want and sum(r[5] for r in want) > 5 and not all(r[5] for r in want)
    clean = decontamination.decontaminate(cases.frame(spark, rows), frame)
    kept = sorted(str(r["doc_id"]) for r in clean.collect())
    assert kept == sorted(str(r[0]) for r in rows if r[0] not in {x[0] for x in want if x[5]}) and clean.columns == cases.frame(spark, rows).columns


def test_decontamination_longest_matches(spark):
    rng = random.Random(1)
    prose = lambda n: [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)]
    shared, doc, item = prose(40), prose(30), prose(20)
    docs = spark.createDataFrame([(7, " ".join(doc + shared + doc[:5])), (8, " ".join(shared[5:17]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join([*item, "#", *shared, "only here"]))], "item_id long, text string")
    got = {tuple(r) for r in decontamination.matches(docs, items).collect()}
    assert ("1", 20, 7, 30, 40) in got and all(r[2] == 7 or r[4] == 12 for r in got)


def test_decontamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = cases.documents(count=45)
    got = decontamination.report(cases.frame(spark, rows), none).collect()
    assert {tuple(r) for r in got} == plain_hits(rows, [])
    assert decontamination.report(cases.frame(spark, []), none).collect() == []


def test_suffix_array_of_words():
    rng = np.random.default_rng(2)
    for t in range(30):
        numbers = np.append(rng.integers(0, (3, 5, 40)[t % 3], int(rng.integers(1, 300))), 0)
        if len(numbers) > 200:
            numbers[100:180] = numbers[:80]
        least = (1, 3)[t % 2]
        ends = np.flatnonzero(numbers == 0)
        tail = {i: numbers[i : ends[np.searchsorted(ends, i)]].tolist() for i in range(len(numbers)) if numbers[i]}
        whole = {}
        for i in tail:
            a = i
            while a and numbers[a - 1]:
                a -= 1
            whole[i] = len(tail[a])
        array = decontamination.SuffixArray(numbers, least)
        held = [tail[i] for i in array.places.tolist()]
        assert sorted(array.places.tolist()) == [i for i in tail if whole[i] >= least] and held == sorted(held)
