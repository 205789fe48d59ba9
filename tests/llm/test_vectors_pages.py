"""Vector search, vector near-dedup and archives against plain versions."""

import base64
import hashlib

import numpy as np
import pytest

from framelens.llm import embedding_dedup, topk_search, warc
from framelens.llm.common import components
from framelens.llm.embedding_dedup import _unit, fit_forest, leaves
from tests.llm import cases


def vectors(count=400, width=16, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(count, width))
    for i in range(0, 120, 2):  # near copies
        x[i + 1] = x[i] + rng.normal(size=width) * 0.05
    x[200:230] = x[7]  # many equal
    rows = [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]
    rows[50] = (50, None)
    rows[51] = (51, [0.0] * width)
    rows[52] = (52, [float("nan")] + [1.0] * (width - 1))
    rows[53] = (53, [None] + [1.0] * (width - 1))
    rows[54] = (54, [float("inf")] + [1.0] * (width - 1))
    rows[55] = (55, [])
    rows[56] = (56, [1.0] * 5)
    rows[100] = (100, [0.0] * width)
    rows[57] = (None, rows[7][1])
    rows.append(rows[3])
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("id", "v", "a", "b", "label", "_id", "tree", "leaf", "query", "rank"):
        df = df.selectExpr("*", f"'other' AS {name}")
    return df


def held(rows):
    """Ids as the operators see them, and vectors in single precision."""
    return {(-(2**63) if i is None else i): None if v is None else [None if x is None else float(np.float32(x)) for x in v] for i, v in rows}


def sound(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("leaf", [512, 60])
def test_embedding_dedup(spark, monkeypatch, leaf):
    monkeypatch.setattr(embedding_dedup, "LEAF", leaf)
    own = held(vectors())
    good = [i for i, v in own.items() if sound(v) and any(v)]
    links = set()
    for a in good:
        for b in good:
            if a < b and len(own[a]) == len(own[b]):
                x, y = np.array(own[a]), np.array(own[b])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                    links.add((a, b))
    root = cases.components(own, links)
    want = {(cases.shown(i), sum(i in p for p in links), cases.shown(root[i]), i == root[i]) for i in own}
    got = {tuple(r) for r in embedding_dedup.report(frame(spark, vectors())).collect()}
    assert got == want and len(links) > 400


def test_forest_recall():
    rng = np.random.default_rng(5)
    x = _unit(rng.normal(size=(20_000, 64)))
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    near = 0.951 * x + np.sqrt(1 - 0.951**2) * _unit(y)  # every pair just above the threshold
    forest = fit_forest(x[:8192], 6)
    met = np.zeros(len(x), bool)
    for levels in forest:
        for i in range(0, len(x), 4000):
            (r, a), (s, b) = leaves(x[i : i + 4000], levels), leaves(near[i : i + 4000], levels)
            both = set(zip(r.tolist(), a.tolist())) & set(zip(s.tolist(), b.tolist()))
            met[i + np.array(sorted({k for k, _ in both}), int)] = True
    assert met.mean() > 0.995


@pytest.mark.parametrize("block", [4096, 100])
def test_topk_search(spark, monkeypatch, block):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    own = held(vectors())
    good = sorted(i for i, v in own.items() if sound(v))
    whole = {i: np.pad(np.floor(256 * np.array(own[i], float)).astype(int), (0, 16 - len(own[i]))) for i in good}
    want = set()
    for q in good:
        if q % 50 == 0 and q >= 0:
            best = sorted((-int(whole[q] @ whole[c]), c) for c in good if c != q)[:5]
            want |= {(q, k + 1, cases.shown(c), -s) for k, (s, c) in enumerate(best)}
    got = topk_search.search(frame(spark, vectors())).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_topk_few_candidates_and_large_values(spark):
    rows = [(0, [3e38, 1.0]), (1, [1.0, 1.0]), (50, [-3e38, 2.0])]
    got = {tuple(r) for r in topk_search.search(frame(spark, rows)).collect()}
    top = 1 << 28
    assert got == {(0, 1, 1, 256 * top + 65536), (0, 2, 50, -(top**2) + 131072), (50, 1, 1, -256 * top + 131072), (50, 2, 0, -(top**2) + 131072)}


@pytest.mark.parametrize("block", [512, 16])
def test_topk_long_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(topk_search, "LONG_BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * 2.0 ** (22 if i % 3 else 0)]) for i in range(120)]
    rows[7], rows[8], rows[9] = (7, [1e30, *[0.0] * 5]), (8, [2e30, *[0.0] * 5]), (9, [2.0**21, 0.0, 3.5])  # held alike, 8 is the better or worse one
    got = {(r["query_id"], r["rank"]): r for r in topk_search.search(frame(spark, rows)).collect()}
    whole = {i: [int(np.floor(256 * float(np.float32(x)))) if abs(x) < 1e9 else int(float(np.float32(x))) * 256 for x in v] for i, v in rows}
    assert len(got) == 3 * 5
    for q in (0, 50, 100):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q)[:5]
        for k, (s, c) in enumerate(best):
            assert got[q, k + 1]["vec_id"] == c and (got[q, k + 1]["score"] == -s or abs(s) >= 2**63)
    assert any(2**40 < abs(r["score"]) for r in got.values())


def test_vectors_empty(spark):
    assert embedding_dedup.report(frame(spark, [])).collect() == [] and topk_search.search(frame(spark, [])).collect() == []


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "'y' AS file", "1 AS target", "2 AS size", "3 AS d", "4 AS n")


ROWS = [
    (3, "http://a/1", "<p>one</p>"), (9, "http://a/2", "<p>one</p>"), (5, None, "<p>one</p>"), (1, "http://b/é?x\r\ny", None), (2, "", ""),
    (7, "u", "long é " * 40_000), (8, "u", "with\r\n\r\nWARC/1.1\r\nblank lines\n"), (None, "n", "<p>one</p>"), (None, "n", "alone"), (9, "http://a/2", "<p>one</p>"),
]


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ", 2000)
    newest = {}
    for page_id, _, html in ROWS:
        newest[html or ""] = max(newest.get(html or "", -(2**63)), -(2**63) if page_id is None else page_id)
    want = []
    for page_id, _, html in ROWS:
        raw, top = (html or "").encode(), newest[html or ""]
        first = (-(2**63) if page_id is None else page_id) == top
        want.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else top))
    got = [tuple(r) for r in warc.round_trip(pages(spark, ROWS)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_warc_selected_records(spark, tmp_path):
    import gzip

    index = warc.write_archives(pages(spark, ROWS).coalesce(1), str(tmp_path))
    some = warc.read_records(index.where("page_id IN (7, 8, 5)")).collect()
    payload = {r["page_id"]: r["payload"] for r in some}
    assert payload[7].decode() == ROWS[5][2] and payload[8].decode() == ROWS[6][2] and payload[5] is None
    assert {r["url"] for r in some} == {"u", None}
    for path in tmp_path.glob("*.warc.gz"):
        assert gzip.decompress(path.read_bytes()).startswith(b"WARC/1.1\r\n")
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_components(spark):
    rng = np.random.default_rng(9)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(400 + i, 401 + i) for i in range(40)] + [(900, 900), (None, 3)]
    ids = {x for p in links for x in p if p[0] != p[1] and None not in p}
    want = cases.components(ids, [p for p in links if None not in p and p[0] != p[1]])
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
