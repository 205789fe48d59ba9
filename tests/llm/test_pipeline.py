"""The pipeline against plain versions of its stages, on tables with every awkward case."""

from collections import Counter

import pytest

import corpus_pipeline as pipeline
from framelens.llm import packing
from tests.llm import cases


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    cases.frame(spark, cases.documents()).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages_take_effect_one_after_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    named, lines, near, mixed, packed = (f for _, f in pipeline.STAGES)
    after = []
    for stage in (named, lines, near, mixed):
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), cases.DOCUMENTS)
        assert docs.columns == pipeline.COLUMNS
        after.append([tuple(r) for r in docs.collect()])
    rows = cases.documents()

    lettered = [r for r in rows if any(map(str.isalpha, r[1] or ""))]
    assert sorted(map(str, ((r[0], r[1], r[3], r[4]) for r in after[0]))) == sorted(map(str, ((r[0], r[1], r[3], r[4]) for r in lettered)))
    assert all(r[2] in ("aa", "bb") for r in after[0])  # a missing language is filled in

    texts = cases.by_id(after[0])
    key = lambda line: cases.lower(line.strip(" \t\n\v\f\r"))
    holders: dict = {}
    for i, text in texts.items():
        for line in text.split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    want = {i: "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i) for i, t in texts.items()}
    assert {r[0]: (r[1], r[4]) for r in after[1]} == {cases.shown(i): (t, len(t)) for i, t in want.items()}

    sets = {}
    for i, text in want.items():
        w = cases.words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    own = cases.components(sets, links)
    assert len(links) > 3 and sorted(str(r[0]) for r in after[2]) == sorted(str(cases.shown(i)) for i in own if own[i] == i)
    assert {r[0]: r[1] for r in after[2]} == {cases.shown(i): want[i] for i in own if own[i] == i}

    copies = Counter(r[0] for r in after[3])
    assert max(copies.values()) <= 3 and set(copies) <= {r[0] for r in after[2]}
    pieces = packed(spark, docs, folder).collect()
    assert Counter(p["doc_id"] for p in pieces if p["piece"] == 0) == copies
    filled: dict = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == filled.get(p["sequence_id"], 0)
        filled[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(filled.values()) <= packing.TOKENS


def test_run_and_empty_table(spark, folder, tmp_path):
    assert pipeline.run(spark, folder).count() > 10
    cases.frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []
