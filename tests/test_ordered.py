import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.operators import ordered, sequence, telemetry
from framelens.operators.quantiles import exact_percentile, select_between


def long_sequences(spark, seed=1):
    """One key with most of the rows, so that it covers many small buckets."""
    rng = random.Random(seed)
    rows = []
    for key, n in ((1, 400), (2, 37), (3, 1)):
        at = 0
        for _ in range(n):
            at += rng.choice((1, 1, 1, 2, 9))
            rows.append((key, at, rng.random() * 10, rng.random() < 0.6))
    return rows, spark.createDataFrame(rows, "key long, at long, x double, hit boolean").repartition(5)


def by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(row[0], []).append(row)
    return out


def test_two_level_order_equals_plain_order(spark):
    rows, df = long_sequences(spark)
    bucket = ordered.frame_bucket("at", 16)
    df = ordered.ordered_index(df, ["key"], "at", bucket, "i")
    df = ordered.ordered_lag(df, ["key"], "at", bucket, {"px": F.col("x")})
    df = ordered.ordered_running_sum(df, ["key"], "at", bucket, F.col("hit").cast("long"), "hits")
    df = ordered.ordered_last_value(df, ["key"], "at", bucket, F.when(F.col("hit"), F.col("x")), "last", inclusive=False)
    got = {(r.key, r.at): (r.i, r.px, r.hits, r.last) for r in df.collect()}
    for key, items in by_key(rows).items():
        hits, last = 0, None
        for i, (_, at, x, hit) in enumerate(items):
            hits += hit
            assert got[(key, at)] == (i, items[i - 1][2] if i else None, hits, last)
            last = x if hit else last


def test_recent_values_cross_buckets(spark):
    rows, df = long_sequences(spark, 2)
    got = ordered.ordered_recent(df, ["key"], "at", F.col("x"), "recent", count=20, size=16).collect()
    want = {}
    for key, items in by_key(rows).items():
        for i, item in enumerate(items):
            want[(key, item[1])] = [v[2] for v in items[max(0, i - 20):i]]
    assert {(r.key, r.at): r.recent for r in got} == want


@pytest.mark.parametrize("alpha", [0.0, 0.65, 2.0])
def test_ema_across_buckets(spark, monkeypatch, alpha):
    monkeypatch.setattr(sequence, "frame_bucket", lambda c, size=16: ordered.frame_bucket(c, 16))
    rows, df = long_sequences(spark, 3)
    df = df.select("key", F.col("at").alias("idx"), "x", F.col("hit").alias("restart"))
    got = {(r.key, r.idx): r.smoothed for r in sequence.ema(df, alpha).collect()}
    a = min(0.98, alpha)
    for key, items in by_key(rows).items():
        state = None
        for i, (_, at, x, again) in enumerate(items):
            # The first row of a key continues from nothing unless it restarts, so start it as a restart.
            state = x if again else a * (0.0 if state is None else state) + (1 - a) * x
            assert got[(key, at)] == pytest.approx(state)


def test_missing_runs(spark):
    pattern = [False, True, False, False, True, False, False, False]
    df = spark.createDataFrame([(1, i, h) for i, h in enumerate(pattern)], "key long, idx long, hit boolean")
    rows = sorted(sequence.missing_run(df, 1).collect(), key=lambda r: r.idx)
    assert [r.missing_run for r in rows] == [1, 0, 1, 2, 0, 1, 2, 3]
    assert [r.held for r in rows] == [False, True, True, False, True, True, False, False]


@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_exact_percentile(spark, accuracy):
    rng = np.random.default_rng(0)
    values = {1: rng.normal(size=5000), 2: np.repeat([1.0, 5.0], [900, 100]), 3: rng.random(1), 4: rng.random(7)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [(1, None)]
    df = spark.createDataFrame(rows, "key long, v double")
    for share in (0.5, 0.95, 1.0):
        got = {r.key: r.q for r in exact_percentile(df, ["key"], "v", share, "q", accuracy=accuracy).collect()}
        for key, vs in values.items():
            assert got[key] == pytest.approx(np.quantile(vs, share))
    assert exact_percentile(df, [], "v", 0.95, "q").collect()[0].q == pytest.approx(
        np.quantile(np.concatenate(list(values.values())), 0.95)
    )


def test_percentile_with_a_false_bracket_and_wild_values(spark):
    rng = np.random.default_rng(3)
    values = {
        1: rng.normal(size=3000), 2: 10.0 ** rng.uniform(-300, 300, 2000) * rng.choice([-1, 1], 2000), 3: np.full(50, 7.0),
        4: np.array([5e-324, -5e-324, 0.0, -0.0, 1e-323]), None: np.array([1.0, 2.0, np.inf, -np.inf, 3.0]), 6: np.nextafter(1.0, 2.0) + np.arange(900) * 2.0**-52,
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "key long, v double")
    for share in (0.3, 0.5, 0.95):
        got = {r.key: r.q for r in exact_percentile(df, ["key"], "v", share, "q", accuracy=50).collect()}
        for key, vs in values.items():
            at = share * (len(vs) - 1)
            a, b = np.sort(vs)[[int(np.floor(at)), int(np.ceil(at))]]
            assert got[key] == (a if a == b else pytest.approx(a + (b - a) * (at - np.floor(at)), rel=1e-12, abs=0)), (key, share)
    rows = df.where("key = 1").selectExpr("struct(key) AS _key_of_row", "v AS _v")
    own = np.sort(values[1])
    for lo, hi in ((-99.0, -98.0), (98.0, 99.0), (own[0], own[1]), (0.0, 0.0)):
        guess = rows.groupBy("_key_of_row").agg(F.lit(1700).cast("long").alias("_r0"), F.lit(1701).cast("long").alias("_r1"), F.lit(0.5).alias("_fraction"), F.lit(float(lo)).alias("_lo"), F.lit(float(hi)).alias("_hi"))
        assert [(r._a, r._b) for r in select_between(rows, guess).collect()] == [(own[1700], own[1701])]
    assert exact_percentile(spark.createDataFrame([(1, 1.0), (1, float("nan")), (1, float("nan"))], "key long, v double"), ["key"], "v", 1.0, "q").collect()[0].q != 0


def test_metric_summary_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "m double")
    row = sequence.metric_summary(df, ["m"]).collect()[0]
    assert (row.m_count, row.m_mean, row.m_std, row.m_p95) == (0, None, None, None)


@pytest.mark.parametrize("capacity", [1, 3, 50])
def test_lru_hits(spark, capacity):
    rng = random.Random(5)
    rows = [(k, t, rng.randrange(8)) for k, n in ((1, 300), (2, 20)) for t in range(n)]
    df = spark.createDataFrame(rows, "key long, t long, item long").repartition(4)
    out = telemetry.lru_hits(df, capacity, order=["t"], bucket=ordered.frame_bucket("t", 16)).collect()
    got = {(r.key, r.t): r.hit for r in out}
    for key in (1, 2):
        cache = []
        for _, t, item in sorted(r for r in rows if r[0] == key):
            assert got[(key, t)] == (item in cache)
            cache = [c for c in cache if c != item] + [item]
            cache = cache[-capacity:]


def test_boundary_jump_keeps_history_over_gaps(spark):
    deltas = [4.0, None, 2.0, None, 8.0, 6.0]
    df = spark.createDataFrame([(1, i, d, i in (0, 4, 5)) for i, d in enumerate(deltas)], "key long, idx long, delta double, boundary boolean")
    got = {r.idx: r.jump for r in sequence.boundary_jump(df).collect()}
    assert got == {0: 1.0, 4: pytest.approx(8 / 3), 5: pytest.approx(6 / 4)}


def test_null_keys_null_orders_and_large_numbers_stay(spark):
    from framelens.operators import ordered
    from framelens.operators.ordered import frame_bucket

    big = 2**53 + 1
    rows = [("a", 5, big), ("a", None, None), ("a", 9000, 3), (None, 1, big), (None, 2, None)]
    df = spark.createDataFrame(rows, "key string, idx long, n long")
    got = {(r.key, r.idx): r.at for r in ordered.ordered_index(df, ["key"], "idx", frame_bucket("idx"), "at").collect()}
    assert got == {("a", None): 0, ("a", 5): 1, ("a", 9000): 2, (None, 1): 0, (None, 2): 1}
    lagged = {(r.key, r.idx): r.before for r in ordered.ordered_lag(df, ["key"], "idx", frame_bucket("idx"), {"before": df.n}).collect()}
    assert lagged == {("a", None): None, ("a", 5): None, ("a", 9000): big, (None, 1): None, (None, 2): big}
    folded = ordered.fold_sorted(
        df, ["key"], ["idx"], ["idx", "n"], lambda key: list(key), lambda state, row: [(state[0], *row)], "key string, idx long, n long"
    ).collect()
    assert sorted(map(str, map(tuple, folded))) == sorted(map(str, rows))


def test_span_tree_keeps_orphans_and_circles(spark):
    from framelens.operators import telemetry

    chain = [("r", str(i), str(i - 1) if i else None) for i in range(40)]
    rows = [*chain, ("r", "lost", "gone"), ("r", "under", "lost"), ("r", "x", "y"), ("r", "y", "x"), ("r", "hang", "x"), (None, "n", None), (None, "m", "n")]
    got = {(r.run_id, r.span_id): r for r in telemetry.span_tree(spark.createDataFrame(rows, "run_id string, span_id string, parent_span_id string")).collect()}
    assert len(got) == len(rows)
    assert all(got["r", str(i)].depth == i and got["r", str(i)].root == "0" for i in range(40)) and got["r", "3"].path == "0/1/2/3"
    assert [got["r", s].complete for s in ("39", "lost", "under", "x", "y", "hang")] == [True, False, False, False, False, False]
    assert got["r", "x"].root is None and got[None, "m"].root == "n"


def test_one_day_of_one_run_spreads(spark):
    rng = random.Random(6)
    rows = [(k, (k or 0) * 10**6 + i, t) for k, n in ((1, 6000), (2, 40), (None, 700)) for i, t in enumerate(sorted(int(10**9 * rng.random() ** 4) for _ in range(n)))]
    rows += [(1, 9 * 10**6 + i, 12345) for i in range(300)]  # many at one time
    df = spark.createDataFrame(rows, "run_id long, event_id long, us long").withColumn("ts", F.timestamp_micros("us"))
    placed = ordered.even_buckets(df, ["run_id"], F.col("us"), "part", depth=500)
    sizes = {(r.run_id, r.part): (r["n"], r.low, r.high) for r in placed.groupBy("run_id", "part").agg(F.count("*").alias("n"), F.min("us").alias("low"), F.max("us").alias("high")).collect()}
    own = sorted((p, *v) for (k, p), v in sizes.items() if k == 1)
    assert len(own) > 50 and max(n for _, n, _, _ in own) < 500 and all(a[3] < b[2] for a, b in zip(own, own[1:]))
    assert len([1 for k, _ in sizes if k == 2]) == 1 and len([1 for k, _ in sizes if k is None]) > 50
    show = lambda depth: sorted((str(r.run_id), r.event_id, r.gap_seconds) for r in telemetry.stalled_runs(df, 0.5, depth=depth).collect())
    assert show(300) == show(10**6) and len(show(300)) > 20


def test_affine_scan():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 1000):
        gain, offset = np.where(rng.random(n) < 0.1, 0.0, 0.8), rng.normal(size=n)
        offset[n // 2] = np.nan
        now, want = 0.0, []
        for g, o in zip(gain, offset):
            now = (g * now if g else 0.0) + o
            want.append(now)
        assert np.allclose(sequence.affine_scan(gain, offset), want, equal_nan=True)
