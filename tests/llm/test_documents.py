"""Document operators against plain versions, with every awkward case of ``cases``."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.llm import language_id, line_dedup, mixing, ngram_join, packing, pii, suffix_dedup
from tests.llm import cases


@pytest.fixture(scope="module")
def rows():
    return cases.documents()


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def test_line_dedup(spark, rows):
    texts = cases.by_id(rows)
    key = lambda line: cases.lower(line.strip(" \t\n\v\f\r"))
    holders: dict[str, set[int]] = {}
    for i, text in texts.items():
        for line in text.split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    assert gone
    want = set()
    for i, text in texts.items():
        lines = text.split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i]
        want.add((cases.shown(i), len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    got = line_dedup.digest(cases.frame(spark, rows)).collect()
    assert len(got) == len(texts) and {tuple(r) for r in got} == want


def test_ngram_join(spark, rows):
    texts = cases.by_id(rows)
    sets = {}
    for i, text in texts.items():
        w = cases.words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(links) > 10
    own = cases.components(ids, links)
    got = ngram_join.report(cases.frame(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((cases.shown(i), len(sets[i]), cases.shown(own[i]))) for i in ids)


def test_ngram_tree_bounds_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    sets = []
    for k in range(60):
        base = np.unique(rng.integers(0, 2**63, 30 + 20 * k, dtype=np.uint64))
        sets += [base, *(np.unique(np.concatenate([base[j:], rng.integers(0, 2**63, j, dtype=np.uint64)])) for j in (2, 9, len(base) // 9))]
    sizes = np.array([len(s) for s in sets])
    points = [ngram_join.point(s).astype(np.int64) for s in sets]
    join = lambda left, right: {(min(x, y), max(x, y)) for a, b in ngram_join._tree_join(points, sizes, left, right) for x, y in zip(a.tolist(), b.tolist())}
    found = join(np.arange(len(sets)), None)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (sizes[i] + sizes[j] - both):
                assert (j, i) in found
    assert len(found) < len(sets) * 4
    half = len(sets) // 2
    assert join(np.arange(half), np.arange(half, len(sets))) == {(i, j) for i, j in found if i < half <= j}


def test_ngram_large_subtrees_are_taken_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    points = spark.createDataFrame([(i, 40, ngram_join._packed(ngram_join.point(np.arange(40, dtype=np.uint64) << np.uint64(20)))) for i in range(7)], "id long, n long, point binary")
    placed = points.selectExpr("1L AS key", "id", "n", "id AS component")
    got = {tuple(r) for r in ngram_join._tree_pairs(placed, points).collect()}
    assert got == {(a, b) for a in range(7) for b in range(7) if a < b}


def brute_strings(texts: dict[int, str]) -> dict[int, list[tuple[int, int]]]:
    seen, out = set(), {}
    for i in sorted(texts):
        raw, runs = texts[i].encode(), []
        for s in range(len(raw) - 99):
            part = raw[s : s + 100]
            if part in seen:
                if runs and s <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], s + 100)
                else:
                    runs.append((s, s + 100))
            seen.add(part)
        out[i] = runs
    return out


@pytest.mark.parametrize("largest", [1 << 24, 400])
def test_suffix_dedup(spark, rows, monkeypatch, largest):
    monkeypatch.setattr(suffix_dedup, "LARGEST", largest)
    texts = cases.by_id(rows)
    want = set()
    for i, runs in brute_strings(texts).items():
        raw = texts[i].encode()
        ends = [0, *(x for r in runs for x in r), len(raw)]
        want.add((cases.shown(i), len(raw), sum(b - a for a, b in runs), len(runs), sha(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2])))))
    got = {tuple(r) for r in suffix_dedup.report(cases.frame(spark, rows)).collect()}
    assert got == want and sum(r[2] for r in want) > 1000


def test_suffix_array_orders_and_finds_repeats():
    rng = np.random.default_rng(1)
    for t in range(40):
        text = rng.integers(97, 97 + (2, 3, 26)[t % 3], int(rng.integers(1, 400))).astype(np.uint8)
        if len(text) > 250:
            text[120:240] = text[:120]
        raw, order = text.tobytes(), suffix_dedup.suffix_array(text)
        parts = [raw[i : i + 100] for i in order]
        assert sorted(order) == list(range(len(text))) and parts == sorted(parts)


def test_mixing(spark, rows):
    got = mixing.report(cases.frame(spark, rows)).collect()
    sizes: dict = {}
    for row in rows:
        sizes.setdefault(row[3], []).append(len(cases.words(row[1] or "")))
    names = sorted((s for s in sizes if s is not None)) + [None]
    total, weight = sum(map(sum, sizes.values())), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest, share = total - sum(3 * sum(sizes[s]) for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * sum(sizes[s]) if s in full else rest * weight[s] / share for s in names}
        over = {s for s in names if target[s] > 3 * sum(sizes[s])}
        if not over:
            break
        full |= over
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    taken = {s: 0 for s in names}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sum(sizes[s]) and math.isclose(r["target"], target[s], rel_tol=1e-9)
        assert r["taken"] in ({0} if not r["size"] else {k * r["size"] for k in range(4)})
        taken[s] += r["taken"]
    off = {s: (taken[s], target[s], max(sizes[s])) for s in names if abs(taken[s] - target[s]) > max(20, 0.02 * target[s])}
    assert all(abs(a - b) <= large / 2 and large > 0.5 * b for a, b, large in off.values()), off  # one document outweighs the target
    again = mixing.report(cases.frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    copied = mixing.repeat(cases.frame(spark, rows))
    assert copied.columns == cases.frame(spark, rows).columns
    assert sum(len(cases.words(r["text"] or "")) for r in copied.select("text").collect()) == sum(taken.values())


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 1}, {"a": 1, "b": 1000, "c": 1000, "d": 3}, {"a": 0, "b": 5}])
def test_mixing_targets_stop_at_three_times(spark, sizes):
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")).collect()}
    full, names, total = set(), sorted(sizes), sum(sizes.values())
    while True:
        share = sum((5, 2, 1)[i % 3] for i, s in enumerate(names) if s not in full)
        rest = total - sum(3 * sizes[s] for s in full)
        want = {s: 3.0 * sizes[s] if s in full else rest * (5, 2, 1)[i % 3] / share for i, s in enumerate(names)}
        if not (over := {s for s in names if want[s] > 3 * sizes[s]}):
            break
        full |= over
    assert got == pytest.approx(want)


@pytest.mark.parametrize("sizes, want", [
    ({"a": 100, "b": 100, "c": 100, "d": 100}, [400 * w / 13 for w in (5, 2, 1, 5)]),
    ({"a": 500, "b": 200}, [500, 200]),
    ({"a": 10, "b": 4, "c": 986}, [30, 12, 958]),  # both tied sources are full
])
def test_mixing_targets_of_sources_that_fill_at_one_level(spark, sizes, want):
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).orderBy("source").collect()
    assert [r["target"] for r in got] == pytest.approx(want) and sum(r["target"] for r in got) == pytest.approx(sum(sizes.values()))


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public_tokenizer())
    rows = [*rows, (500, "a <|endoftext|> b   c  d\r\n\r\n  e'll été là", None, None, 1)]
    want = []
    for row in rows:
        ids = np.array([*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 0], "<u4")
        head = len(ids) - (-(-len(ids) // 2048) - 1) * 2048
        for piece, (a, b) in enumerate(zip([0, *range(head, len(ids), 2048)], [*range(head, len(ids) + 1, 2048)])):
            want.append((row[0], piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    got = packing.sequences(cases.frame(spark, rows)).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    filled: dict = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048 and len(filled) <= 1.02 * sum(filled.values()) / 2048 + 1


def test_best_two_fit_replaces_the_smallest():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]  # greedily 6 + 3; the 3 gives way to 2 + 2
    assert packing.best_two_fit(counts, 10) == [([6, 2, 2], 1), ([3], 1)]
    rng = np.random.default_rng(2)
    counts = np.bincount(rng.integers(1, 101, 5000), minlength=101)
    used = np.zeros(101, np.int64)
    plan = packing.best_two_fit(counts, 100)
    for filling, times in plan:
        assert sum(filling) <= 100
        used += np.bincount(filling, minlength=101) * times
    assert (used == counts).all() and sum(t for _, t in plan) <= 1.03 * (counts * np.arange(101)).sum() / 100


def test_language_id(spark):
    rng = __import__("random").Random(4)
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))
    kinds = {"aa": ("the", "ing", "wh"), "bb": ("ión", "que", "lla"), "cc": ("привет", "да", "нет")}
    rows = [(i, make(kinds[k], 60), k, "s", 1) for i, k in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(900, None, "aa", "s", 1), (901, "", "bb", "s", 1), (902, "12 !? 😀", None, "s", 1), (None, make(kinds["aa"], 9), None, "s", 1), (903, make(kinds["bb"], 30), None, None, 1)]
    df = cases.frame(spark, rows)
    found = {r["doc_id"]: r for r in language_id.report(df).collect()}
    assert [found[i]["lang_pred"] for i in (900, 901, 902, None, 903)] == ["und", "und", "und", "aa", "bb"]
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(120)) and not found[None]["held_out"]
    held = [i for i in range(120) if found[i]["held_out"]]
    assert all(found[i]["lang_pred"] == rows[i][2] for i in held) and all(0 <= r["score"] <= 1 for r in found.values())
    changed = {r["doc_id"]: r for r in language_id.report(df.withColumn("lang", F.when(~language_id.held_out(F.col("doc_id")), F.col("lang")))).collect()}
    assert found == changed  # held-out labels are not read
    first, second = make(kinds["aa"], 20), make(kinds["cc"], 20)
    mixed = spark.createDataFrame([(1, f"{first} {second}")], "doc_id long, text string")
    spans = language_id.identify(mixed, language_id.fit(df), spans=True).first()["lang_spans"]
    assert [(s["start"], s["end"], s["lang"]) for s in spans] == [(0, len(first), "aa"), (len(first) + 1, len(first) + 1 + len(second), "cc")]


def test_language_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(11, 3)).astype(np.float32)
    offsets = np.array([0, 5, 5, 11])
    got = language_id.viterbi(scores, offsets, 0.7)
    import itertools

    for a, b in zip(offsets, offsets[1:]):
        value = lambda path: sum(scores[a + t, s] for t, s in enumerate(path)) - 0.7 * sum(x != y for x, y in zip(path, path[1:]))  # noqa: E731, B023
        if b > a:
            assert value(got[a:b]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=int(b - a)))), abs=1e-5)


PLANTED = [
    "write to Ann.B+c@mail.example.org. or x@y or @z.com or a@b.c.d@e.f", "host 10.0.0.255 and 10.0.0.256 and 1.2.3.4.5 and 001.2.3.04",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 1 2", "ring +1 (521) 555-6210 or +44 20 7946 0958. +12", "é 😀 +49 30 1234567 4111111111111111", "", "no numbers here",
]


def test_pii_base_spans_equal_the_patterns():
    import re

    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    rng = __import__("random").Random(8)
    texts = [*PLANTED, *("".join(rng.choice("0123456789012.@+- ()ab") for _ in range(300)) for _ in range(200))]
    for text in texts:
        want = []
        for kind, pattern in enumerate(patterns):
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m.group())
                fits = (True, kind == 1 and all(int(x) <= 255 for x in m.group().split(".")), 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15)[kind]
                if fits:
                    want.append((m.start(), kind, m.end()))
        assert pii.base_spans(text) == sorted(want)


def test_pii_report(spark, rows):
    texts = [(i, f"some words before {x} and some more behind it, to fill a window or two of text", None, None, 1) for i, x in enumerate(PLANTED * 6, start=1000)]
    got = {r["doc_id"]: r for r in pii.report(cases.frame(spark, texts + [(800, None, None, None, 0)] + rows[:40])).collect()}
    for i, text, *_ in texts:
        base = pii.base_spans(text)
        assert got[i]["base_sha256"] == sha(pii._join(base).encode())
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(k == s[1] for s in base) for k in range(4)]
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert set(pii._join(base).split(",")) - {""} <= set(spans)
    assert got[800]["spans"] == "" and got[800]["base_sha256"] == sha(b"")


def test_pii_tagger_learns_held_out_spans():
    rng = __import__("random").Random(6)

    def text() -> str:
        fill = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(9))
        n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
        item = rng.choice((f"{n(3)}{'abc'}@site{n(1)}.org", f"+{n(2)} ({n(3)}) {n(3)}-{n(4)}", f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.0.{rng.randint(0, 255)}", f"in {n(4)} no {n(2)}"))
        return f"{fill()} {item} {fill()}"

    windows = [w for _ in range(400) for w in pii._training_windows(text())]
    symbols, tags = (np.frombuffer(b"".join(w[i] for w in windows), np.uint8).reshape(-1, pii.WINDOW) for i in (0, 1))
    tagger = pii.Tagger()
    losses = tagger.train(symbols, tags, steps=150)
    assert np.mean(losses[-10:]) < 0.1 * losses[0]
    test = [text() for _ in range(100)]
    base = [pii.base_spans(t) for t in test]
    found = pii.added_spans(tagger, test, [[] for _ in test])
    right = sum(len({s for s in a} & {s for s in b}) for a, b in zip(found, base))
    assert right >= 0.8 * sum(len(b) for b in base if b and b[0][1] != 2)


def test_pii_gradients():
    tagger = pii.Tagger(3)
    rng = np.random.default_rng(1)
    symbols, tags = rng.integers(0, 90, (3, 12)), np.zeros((3, 12), np.int64)
    tags[:, 4], tags[:, 5:8] = 3, 4
    _, grads = tagger._loss(symbols, tags)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, values = tagger.p[k][at], []
        for step in (0.01, -0.01):
            tagger.p[k][at] = old + step
            values.append(tagger._loss(symbols, tags)[0])
        tagger.p[k][at] = old
        assert g[at] == pytest.approx((values[0] - values[1]) / 0.02, rel=0.02, abs=1e-2)


@pytest.mark.parametrize("report", [line_dedup.digest, ngram_join.report, suffix_dedup.report, mixing.report, mixing.repeat, packing.sequences, language_id.report, pii.report])
def test_empty_tables(spark, report):
    empty = cases.frame(spark, [])
    assert report(empty).collect() == []
    nothing = cases.frame(spark, [(1, None, None, None, None), (None, None, None, None, None)])
    assert len(report(nothing).collect()) == (0 if report is mixing.repeat else 2)
