"""Vector near-dedup: what it moves, deep trees, large groups."""

import numpy as np
import pytest

from framelens.llm import embedding_dedup
from framelens.llm.embedding_dedup import Sketch, _connected, _unit, fit_forest, leaves
from tests.llm import cases


def near(x, cosine, rng):
    """A vector of that cosine to each row."""
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine**2) * _unit(y)


def plain(x):
    """Per row the number of links and the smallest row reachable."""
    x, links = _unit(x.astype(np.float64)), []
    for s in range(0, len(x), 1000):
        a, b = np.nonzero(x[s : s + 1000] @ x.T >= 0.95)
        links += [(int(i) + s, int(j)) for i, j in zip(a, b) if i + s != j]
    root = cases.components(range(len(x)), links)
    counts = np.bincount([a for a, _ in links], minlength=len(x))
    return {(i, int(counts[i]), root[i], root[i] == i) for i in range(len(x))}


def found(spark, x):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    return {tuple(r) for r in embedding_dedup.report(df).collect()}


def shuffled(spark):
    """Bytes written to shuffles so far."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = store.stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_vectors_are_not_sent_to_every_leaf(spark):
    rng = np.random.default_rng(3)
    x = _unit(rng.normal(size=(20_000, 64)))
    x[10_000:11_000] = near(x[:1000], 0.97, rng)
    x[12_000:12_300] = x[5]  # equal
    x = x.astype(np.float32)
    before = shuffled(spark)
    got = found(spark, x)
    assert shuffled(spark) - before < 4 * x.nbytes
    assert got == plain(x)


def test_deep_forest_recall():
    rng = np.random.default_rng(5)
    x = _unit(rng.normal(size=(1 << 16, 64)))
    forest = fit_forest(x, 13)
    x, met = x[:20_000], np.zeros(20_000, bool)
    y = near(x, 0.951, rng)  # every pair just above the threshold
    for tree in forest:
        (_, a), (_, b) = leaves(x, tree), leaves(y, tree)
        a, b = a.reshape(len(x), -1), b.reshape(len(x), -1)
        assert a.shape[1] == embedding_dedup.PROBES and all(len(set(row)) == len(row) for row in a[:100].tolist())
        met |= (a[:, :, None] == b[:, None]).any((1, 2))
    assert met.mean() > 0.99


@pytest.mark.parametrize("width", [1, 2, 31, 64, 700])
def test_sketches_keep_pairs_at_the_threshold(width):
    rng = np.random.default_rng(width)
    x = _unit(rng.normal(size=(3000, width)) + 0.3)
    y = near(x, 0.9501, rng) if width > 1 else x
    sketch = Sketch.fit(x)
    for a, b in zip(x[:500], y[:500]):
        assert _connected(sketch.of(np.stack([a, b])), sketch.cut).tolist() == [0, 0]
    apart = _unit(rng.normal(size=(1500, width)))
    if width > 31:
        assert _connected(sketch.of(apart), sketch.cut).tolist() == list(range(1500))


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "GROUP", 1)  # blocks of 64 vectors
    rng = np.random.default_rng(8)
    x = _unit(rng.normal(size=(900, 24)))
    x[:300] = _unit(x[:1] + 0.035 * rng.normal(size=(300, 24)))  # links at and below the threshold
    for i in range(300, 420):  # a chain
        x[i] = near(x[i - 1 : i], 0.96, rng)[0]
    x[500:540] = x[310]
    x = x[rng.permutation(len(x))].astype(np.float32)
    want = plain(x)
    assert found(spark, x) == want and max(n for _, n, _, _ in want) > 200
