import random

import pytest
from pyspark.sql import functions as F

from framelens.operators import detections as det

BOXES = "video_id long, frame_index long, det_id long, x1 double, y1 double, x2 double, y2 double, det_score double, similarity double"


def iou(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda r: max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])
    union = area(a) + area(b) - w * h
    return w * h / union if union > 0 else 0.0


def greedy(rows, threshold):
    area = lambda r: max(0.0, r[5] - r[3]) * max(0.0, r[6] - r[4])
    kept = []
    for r in sorted(rows, key=lambda r: (-r[8], -r[7], -area(r), r[2])):
        if all(iou(r[3:7], k[3:7]) < threshold for k in kept):
            kept.append(r)
    return {r[2] for r in kept}


def crowd(seed, n=400, frames=2):
    """Piles of near-copies, exact copies and empty boxes."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.choice((10, 40, 42, 80)) + rng.gauss(0, 2), rng.choice((10, 14, 60)) + rng.gauss(0, 2)
        w, h = rng.choice((20, 24, 60)) * rng.uniform(0.9, 1.1), rng.choice((20, 26, 70)) * rng.uniform(0.9, 1.1)
        if i % 50 == 0:
            w = 0.0
        if i % 9 == 0 and rows:
            x, y, w, h = rows[-1][3], rows[-1][4], rows[-1][5] - rows[-1][3], rows[-1][6] - rows[-1][4]
        rows.append((1, i % frames, i, x, y, x + w, y + h, rng.choice((0.5, 0.9)), round(rng.random(), 1)))
    return rows


@pytest.mark.parametrize("threshold", [0.3, 0.72])
def test_suppression_routes_agree_with_the_greedy_fold(spark, threshold):
    rows = crowd(4)
    df = spark.createDataFrame(rows, BOXES).repartition(4)
    want = set().union(*(greedy([r for r in rows if r[1] == f], threshold) for f in (0, 1)))
    assert {r.det_id for r in det.nms(df, iou=threshold).collect()} == want
    assert {r.det_id for r in det.nms(df, iou=threshold, crowded=100).collect()} == want
    kept = [r for r in rows if r[2] in want]
    assert all(iou(a[3:7], b[3:7]) < threshold for a in kept for b in kept if a[1] == b[1] and a[2] < b[2])


def faces(spark):
    rows = [(1, 1, 0, 5.0, 5.0, 25.0, 25.0, 0.95), (1, 1, 1, 40.0, 5.0, 60.0, 25.0, 0.92), (1, 1, 2, 70.0, 5.0, 90.0, 25.0, 0.90)]
    return spark.createDataFrame(rows, BOXES.rsplit(",", 1)[0])


def picks(spark, tracks, **options):
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    active = None
    if tracks is not None:
        active = spark.createDataFrame([(1, 1, False, tracks)], f"video_id long, frame_index long, full_scan boolean, tracks array<{box}>")
    out = det.recognition_candidates(faces(spark), active, width=100.0, height=100.0, **options).collect()
    return [r.det_id for r in sorted(out, key=lambda r: r.pick)]


def test_recognition_candidates(spark):
    assert picks(spark, [(38.0, 4.0, 62.0, 26.0)]) == [1]
    assert len(picks(spark, None, max_faces=2)) == 2
    assert picks(spark, [(4.0, 4.0, 26.0, 26.0), (69.0, 4.0, 91.0, 26.0)]) == [0, 2]


def test_primary_and_layers(spark):
    df = faces(spark).withColumn("x2", F.when(F.col("det_id") == 2, F.lit(99.0)).otherwise(F.col("x2")))
    best = det.primary_detection(df, 100.0, 100.0).collect()[0]
    assert best.largest_det == 2
    assert {r.det_id: r.layer for r in det.composition_order(df).collect()} == {0: 0, 1: 1, 2: 2}


@pytest.mark.parametrize("iou", [0.0, 1.0])
def test_thresholds_are_held_in_range_on_both_routes(spark, iou):
    rows = [(1, 0, i, float(i % 7), 0.0, float(i % 7) + 20, 20.0, 0.9, 0.5 + i / 100) for i in range(14)]
    df = spark.createDataFrame(rows, "video_id long, frame_index long, det_id long, x1 double, y1 double, x2 double, y2 double, det_score double, similarity double")
    ids = lambda crowded: sorted(r.det_id for r in det.nms(df, iou=iou, crowded=crowded).collect())
    assert ids(None) == ids(3) and 0 < len(ids(None)) < 14


def test_a_missing_track_reserves_nothing(spark):
    assert picks(spark, [None, (69.0, 4.0, 91.0, 26.0)], max_candidates=2) == [2, 0]  # once [0, 2]
    assert picks(spark, [None]) == [0, 1, 2]  # no track at all: all by quality


def test_recognition_candidates_match_their_check_where_frames_lack_detections(spark, tmp_path):
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    whole = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    whole.where("pmod(xxhash64(vec_id), 3) <> 0").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(duck.sql(f"SELECT det_id, pick FROM ({oracle_sql()['win8_recognition_candidates']}) q").fetchall())
    got = queries()["win8_recognition_candidates"](spark, str(tmp_path)).select("det_id", "pick").collect()
    assert sorted(map(tuple, got)) == want and len(want) > 100
