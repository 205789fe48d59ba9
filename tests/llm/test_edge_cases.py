"""Texts and label sets that once broke an operator."""

import numpy as np
import pytest

from framelens.llm import mixing, pii
from framelens.llm.language_id import viterbi
from tests.llm import cases


def test_addresses_with_thousands_of_digits(spark):
    texts = ["0" * 5000 + "1.1.1.1", "1.2.3." + "0" * 6000 + "4", "1.2.3." + "9" * 5000, "0.0.0." + "0" * 9]
    assert [pii.base_spans(t) for t in texts] == [[(0, 1, 5007)], [(0, 1, 6007)], [], [(0, 1, 15)]]
    rows = pii.report(cases.frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])).collect()
    assert sorted((r["doc_id"], r["n_ip"]) for r in rows) == [(0, 1), (1, 1), (2, 0), (3, 1)]


def test_short_texts_train_the_tagger():
    (symbols, tags), *_ = pii._training_windows("mail a.b@c.de now")
    assert len(symbols) == len(tags) == pii.WINDOW and np.flatnonzero(np.frombuffer(tags, np.uint8)).tolist() == list(range(5, 13))


def test_viterbi_with_many_labels():
    scores = np.zeros((12, 300), np.float32)
    scores[:6, 150] = scores[6:, 299] = 5
    labels = viterbi(scores, np.array([0, 6, 12]))
    assert labels.tolist() == [150] * 6 + [299] * 6


@pytest.mark.parametrize("rounds", [0, 60])
def test_tilts_are_found_by_bisection_too(spark, monkeypatch, rounds):
    monkeypatch.setattr(mixing, "ROUNDS", rounds)
    sized = spark.createDataFrame([("a", n % 9 + 1) for n in range(60)] + [("b", n % 5 + 1) for n in range(300)], "source string, size long")
    targets = mixing.source_targets(sized)
    tilts = {r["source"]: (r["tilt"], r["mean"]) for r in mixing.solve_tilts(sized, targets).collect()}
    for row in targets.collect():
        tilt, mean = tilts[row["source"]]
        sizes = np.array([r["size"] for r in sized.where(sized.source == row["source"]).collect()])
        words = (sizes * 3 / (1 + 2 * np.exp(-tilt * sizes / mean))).sum() if np.isfinite(tilt) else 3 * sizes.sum()
        assert words == pytest.approx(row["target"], rel=1e-5)
