import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelens.operators import windows
from framelens.operators.windows import WindowPlan, plan_windows


def planned(spark, n, cuts=(), plan=WindowPlan(), video=1):
    videos = spark.createDataFrame([(video, n)], "video_id long, requested_frames long")
    table = spark.createDataFrame([(video, c) for c in cuts], "video_id long, cut long") if cuts is not None else None
    rows = windows.plan_windows(videos, table, plan).collect()
    return sorted(rows, key=lambda r: r.clip_index)


def model(n, cuts, frame_num=49, overlap=17, snap=12):
    """Independent plain version: (start, valid, overlap, hard) per window."""
    starts = [(0, False)]
    while starts[-1][0] + frame_num < n:
        here = starts[-1][0]
        goal = here + frame_num - overlap
        near = [c for c in cuts if max(here + 1, goal - snap) <= c <= min(n - 1, here + frame_num - 1, goal + snap)]
        starts.append((min(near, key=lambda c: (abs(c - goal), c)), True) if near else (goal, False))
    out, end = [], 0
    for i, (start, hard) in enumerate(starts):
        valid = min(frame_num, n - start)
        out.append((start, valid, max(0, end - start) if i else 0, hard))
        end = start + valid
    return out


@pytest.mark.parametrize("cuts", [None, ()])
def test_regular_windows(spark, cuts):
    rows = planned(spark, 120, cuts)
    assert [r.start_frame for r in rows] == [0, 32, 64, 96]
    assert [r.overlap_before for r in rows] == [0, 17, 17, 17]
    assert [r.seed for r in rows] == [100, 132, 164, 196]
    assert rows[-1].valid_frames == 24


def test_window_snaps_to_a_cut(spark):
    second = planned(spark, 100, (29,))[1]
    assert (second.start_frame, second.hard_cut_before, second.overlap_before) == (29, True, 20)


def test_window_errors(spark):
    with pytest.raises(Exception, match="chunking is off"):
        planned(spark, 50, (), WindowPlan(chunking=False))
    with pytest.raises(Exception, match="must be positive"):
        planned(spark, 0)
    with pytest.raises(ValueError, match="4n"):
        WindowPlan(frame_num=48)
    assert len(planned(spark, 49, (), WindowPlan(chunking=False))) == 1


def test_many_videos_against_the_model(spark):
    rng = random.Random(7)
    videos, cuts = [], []
    for v in range(60):
        n = rng.randrange(1, 500)
        videos.append((v, n))
        cuts += [(v, rng.randrange(-5, n + 20)) for _ in range(rng.randrange(0, 25))]
    rows = windows.plan_windows(
        spark.createDataFrame(videos, "video_id long, requested_frames long"),
        spark.createDataFrame(cuts, "video_id long, cut long").repartition(3), WindowPlan(),
    ).collect()
    for v, n in videos:
        got = [
            (r.start_frame, r.valid_frames, r.overlap_before, r.hard_cut_before)
            for r in sorted((r for r in rows if r.video_id == v), key=lambda r: r.clip_index)
        ]
        assert got == model(n, sorted({c for w, c in cuts if w == v and 0 < c < n}))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 400), st.lists(st.integers(1, 400), max_size=12))
def test_model_windows_cover_every_frame(n, cuts):
    plan = model(n, sorted({c for c in cuts if c < n}))
    assert {f for s, v, _, _ in plan for f in range(s, s + v)} == set(range(n))


def stitched_model(clips):
    out = {}
    for i, (start, values, overlap, hard) in enumerate(clips):
        for o, v in enumerate(values):
            f = start + o
            soft = i and not hard and o < overlap
            w = 0.5 - 0.5 * math.cos(math.pi * (o + 1) / (overlap + 1)) if soft else 1.0
            before = out.get(f, (0.0, False))[0]
            out[f] = (before * (1 - w) + v * w, bool(i and o == 0 and (hard or overlap > 0)))
    return out


@pytest.mark.parametrize("plan", [WindowPlan(), WindowPlan(frame_num=9, overlap=7, snap=1)])
def test_stitch_against_a_fold(spark, plan):
    rng = random.Random(3)
    clips, values, want = [], [], {}
    for v in range(6):
        n = rng.randrange(60, 200)
        made = model(n, sorted(rng.sample(range(1, n), 6)), plan.frame_num, plan.overlap, plan.snap)
        spec = []
        for i, (start, valid, overlap, hard) in enumerate(made):
            clips.append((v, i, start, valid, overlap, hard))
            vals = [rng.random() for _ in range(valid)]
            values += [(v, i, o, x) for o, x in enumerate(vals)]
            spec.append((start, vals, overlap, hard))
        want.update({(v, f): x for f, x in stitched_model(spec).items()})
    out = windows.stitch(
        spark.createDataFrame(values, "video_id long, clip_index long, offset long, value double"),
        spark.createDataFrame(
            clips, "video_id long, clip_index long, start_frame long, valid_frames long, overlap_before long, hard_cut_before boolean"
        ), plan,
    ).collect()
    assert len(out) == len(want)
    for r in out:
        value, boundary = want[(r.video_id, r.frame_index)]
        assert r.value == pytest.approx(value) and r.boundary == boundary


def test_padding_and_cut_list(spark):
    rows = spark.createDataFrame([(1, 0, 0, 5.0), (1, 0, 1, 7.0)], "video_id long, clip_index long, offset long, value double")
    padded = sorted(windows.pad_to_length(rows, 4).collect(), key=lambda r: r.offset)
    assert [r.value for r in padded] == [5.0, 7.0, 7.0, 7.0]
    cuts = spark.range(1).select(
        windows.clean_cuts(F.array(*(F.lit(c) for c in (5, 0, 9, 5, -1, 3))), F.lit(9)).alias("c")
    ).collect()[0].c
    assert cuts == [3, 5]


def test_stitch_asks_the_clips_how_far_they_reach(spark):
    plan = windows.WindowPlan(frame_num=49, overlap=45, scene_aware=False)
    videos = spark.createDataFrame([(1, 200)], "video_id long, requested_frames long")
    clips = windows.plan_windows(videos, None, plan)
    values = clips.selectExpr("video_id", "clip_index", "explode(sequence(0L, valid_frames - 1)) AS offset").selectExpr("*", "100D AS value")
    assert {round(r.value, 6) for r in windows.stitch(values, clips).collect()} == {100.0}


@pytest.mark.parametrize("settings", [{}, {"frame_num": 9, "overlap": 0, "snap": 20}, {"frame_num": 17, "overlap": 16, "snap": 3}])
def test_plan_in_pieces_equals_one_walk(spark, settings):
    plan = WindowPlan(**settings)
    rng = random.Random(4)
    lengths = {None: 700, 1: 5, 2: 49, 3: 50, 4: 3000, 5: 64, 6: 65, 7: 1281}
    cuts = [(v, rng.randint(-5, n + 20)) for v, n in lengths.items() for _ in range(n // rng.choice((9, 60)))] + [(4, 640), (4, 639), (4, 641), (9, 7)]

    def walk(n, own):
        starts, here, end = [(0, 0, False)], 0, plan.frame_num
        while here + plan.frame_num < n:
            wanted = here + plan.stride
            near = [c for c in own if max(here + 1, wanted - plan.snap) <= c <= min(n - 1, here + plan.frame_num - 1, wanted + plan.snap)]
            here = min(near, key=lambda c: (abs(c - wanted), c)) if near else wanted
            starts.append((here, max(0, end - here), bool(near)))
            end = here + plan.frame_num
        return starts

    want = {(v, k, s, min(plan.frame_num, n - s), o, h) for v, n in lengths.items() for k, (s, o, h) in enumerate(walk(n, [c for w, c in cuts if w == v and 0 < c < n]))}
    videos = spark.createDataFrame(list(lengths.items()), "video_id long, requested_frames long")
    marks = spark.createDataFrame(cuts, "video_id long, cut long")
    for frames in (64, 16_384):
        got = plan_windows(videos, marks, plan, piece_frames=frames).select("video_id", "clip_index", "start_frame", "valid_frames", "overlap_before", "hard_cut_before").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_one_endless_video_spreads(spark):
    videos = spark.createDataFrame([(1, 1_000_000)], "video_id long, requested_frames long")
    cuts = spark.range(1, 1_000_000, 271).selectExpr("1L AS video_id", "id AS cut")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = plan_windows(videos, cuts).selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 2 and max(r["count"] for r in parts) < sum(r["count"] for r in parts) * 0.6
