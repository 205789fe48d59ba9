import random

import pytest
from pyspark.sql import functions as F

from framelens.operators import tracking
from framelens.operators.tracking import TrackConfig
from framelens.streaming import jobs, processors
from tests.test_tracking import DET, frames_of, random_video


def staged(df, path, files):
    """Write ``df`` as several files that arrive one by one."""
    for i, part in enumerate(files):
        df.filter(part).coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


def test_rows_leave_in_order_and_a_gap_holds(spark, tmp_path):
    rows = [(k, i, float(i)) for k in (1, 2) for i in range(12) if (k, i) != (2, 5)]
    df = spark.createDataFrame(rows, "key long, idx long, x double")
    path = staged(df, tmp_path / "in", [F.col("idx") % 3 == r for r in (2, 0, 1)])
    out = jobs.run_available(processors.ordered_emit(jobs.stream_files(spark, path, max_files=1)), "t").collect()
    assert sorted(r.idx for r in out if r.key == 1) == list(range(12))
    assert sorted(r.idx for r in out if r.key == 2) == list(range(5))


@pytest.mark.parametrize("max_faces", [1, 2])
def test_live_tracking_equals_batch(spark, tmp_path, max_faces):
    faces, motion, hists = random_video(21, 60)
    config = TrackConfig(min_similarity=0.3, max_missing=2, max_faces=max_faces, detection_interval=4, cut_threshold=0.2, width=240, height=80)
    frames, detections = frames_of(spark, 60, hists), spark.createDataFrame(faces, DET)
    moves = spark.createDataFrame(motion, "video_id long, frame_index long, m00 double, m01 double, m02 double, m10 double, m11 double, m12 double")
    rows = tracking.tracking_input(frames, tracking.frame_candidates(detections, config), moves, config).join(frames, ["video_id", "frame_index"])
    path = staged(rows, tmp_path / "frames", [F.col("frame_index") % 2 == r for r in (1, 0)])
    live = jobs.run_available(processors.stream_track(jobs.stream_files(spark, path, max_files=1), config), "t")
    show = lambda df: sorted(
        (r.frame_index, r.scene_cut, r.ambiguous, round(r.similarity, 9), [(i.det_id, round(i.x1, 6)) for i in r.instances]) for r in df.collect()
    )
    assert show(live) == show(tracking.track(frames, detections, moves, config))


def test_cache_upserts_and_compaction(spark, tmp_path):
    rng = random.Random(1)
    rows = [("r", f"p{rng.randrange(6)}", v, f"f{v}") for v in range(40)]
    df = spark.createDataFrame(rows, "root string, path string, updated long, fingerprint string")
    path = staged(df, tmp_path / "in", [F.col("updated") % 3 == r for r in range(3)])
    jobs.stream_upsert_cache(jobs.stream_files(spark, path, max_files=1), str(tmp_path / "c"), str(tmp_path / "k")).awaitTermination()
    want = {p: max(v for _, q, v, _ in rows if q == p) for _, p, _, _ in rows}
    show = lambda where: {r.path: r.updated for r in jobs.current_cache(spark, str(where)).collect()}
    assert show(tmp_path / "c") == want
    jobs.compact_cache(spark, str(tmp_path / "c"), str(tmp_path / "c2"))
    assert show(tmp_path / "c2") == want


def test_an_exception_is_told_once_and_its_earliest_record(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    hours = [(7, 0.10, "b"), (7, 0.0, "a"), (7, 3, "c"), (8, 5, "d"), (7, 12, "e"), (9, 12.1, "late ones wait"), (7, 30, "f")]
    df = spark.createDataFrame([(k, start + timedelta(hours=h), v, i) for i, (k, h, v) in enumerate(hours)], "fingerprint long, ts timestamp, body string, i int")
    path = staged(df, tmp_path / "in", [F.col("i").isin(*x) for x in ((0, 1), (2,), (3,), (4, 5), (6,))])
    once = jobs.stream_dedupe(jobs.stream_files(spark, path, max_files=1), ["fingerprint"])
    assert {tuple(r) for r in jobs.run_available(once.select("fingerprint", "body"), "t").collect()} == {(7, "a"), (8, "d"), (9, "late ones wait")}
    again = jobs.stream_dedupe(jobs.stream_files(spark, path, max_files=1), ["fingerprint"], keep_days=1)
    assert (7, "a") in {tuple(r) for r in jobs.run_available(again.select("fingerprint", "body"), "t").collect()}


def test_late_rows_are_counted(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + timedelta(hours=h), "e", 1.0, i) for i, h in enumerate((1, 30, 31, 2, 60))], "ts timestamp, event_type string, value double, i int")
    path = staged(df, tmp_path / "in", [F.col("i") == i for i in range(5)])
    rows, late = jobs.run_counted(jobs.stream_sliding(jobs.stream_files(spark, path, max_files=1), "1 hour", "1 hour"), "t")
    assert late == 1 and sum(r["count"] for r in rows.collect()) == 3


def test_a_lost_frame_delays_and_is_given_up(spark, tmp_path):
    faces, motion, hists = random_video(3, n=60)
    config = TrackConfig(min_similarity=0.3, max_missing=3, max_faces=2, detection_interval=2, cut_threshold=0.2, width=240, height=80)
    gone = {7, 8, 20}
    known = [i for i in range(60) if i not in gone]
    frames = frames_of(spark, 60, hists)
    detections = spark.createDataFrame([f for f in faces if f[1] not in gone], DET)
    moves = spark.createDataFrame([m for m in motion if m[1] not in gone], "video_id long, frame_index long, m00 double, m01 double, m02 double, m10 double, m11 double, m12 double")
    batch = {r.frame_index: (r.ambiguous, round(r.similarity, 9), [(i.det_id, i.track_id, round(i.x1, 6)) for i in r.instances]) for r in tracking.track(frames, detections, moves, config).collect()}
    shown = frames.filter(F.col("frame_index").isin(known))
    rows = tracking.tracking_input(shown, tracking.frame_candidates(detections, config), moves, config).join(shown, ["video_id", "frame_index"]).withColumn("ts", F.timestamp_seconds(F.col("frame_index") + 1000))
    path = staged(rows, tmp_path / "frames", [(F.col("frame_index") >= a) & (F.col("frame_index") < b) for a, b in ((0, 10), (10, 25), (25, 60))])
    live = jobs.run_available(processors.stream_track(jobs.stream_files(spark, path, max_files=1), config, ts="ts", patience=3, keep=5), "t").collect()
    assert {r.frame_index: (r.ambiguous, round(r.similarity, 9), [(i.det_id, i.track_id, round(i.x1, 6)) for i in r.instances]) for r in live} == {f: batch[f] for f in known}
    assert {r.frame_index: r.lost_before for r in live if r.lost_before} == {9: 2, 21: 1} and len(live) == len(known)
    waits = jobs.run_available(processors.stream_track(jobs.stream_files(spark, path, max_files=1), config), "t").collect()
    assert max(r.frame_index for r in waits) == 6  # without a time column a gap holds
