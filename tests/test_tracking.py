import random

import pytest
from pyspark.sql import functions as F

from framelens.operators import sequence, tracking
from framelens.operators.tracking import TrackConfig, TrackFold

KPS = "array<struct<x:double,y:double>>"
DET = f"video_id long, frame_index long, det_id long, x1 double, y1 double, x2 double, y2 double, det_score double, kps {KPS}, similarity double"


def points(x1, y1, w, h):
    return [(x1 + fx * w, y1 + fy * h) for fx, fy in ((0.3, 0.38), (0.7, 0.38), (0.5, 0.54), (0.38, 0.72), (0.62, 0.72))]


def face(frame, det_id, x1, similarity=1.0, y1=12.0, w=30.0, h=40.0, video=1, score=0.99):
    return (video, frame, det_id, float(x1), float(y1), float(x1 + w), float(y1 + h), score, points(x1, y1, w, h), similarity)


def frames_of(spark, n, hists=None, video=1):
    hists = hists or {}
    return spark.createDataFrame(
        [(video, i, hists.get(i, [1.0, 2.0, 3.0])) for i in range(n)], "video_id long, frame_index long, hist array<double>"
    )


def run(spark, n, faces, config, **options):
    tracked = tracking.track(frames_of(spark, n), spark.createDataFrame(faces, DET), None, config, **options)
    return sorted(tracked.collect(), key=lambda r: r.frame_index)


def test_two_tracks_do_not_swap(spark):
    config = TrackConfig(min_similarity=0.5, smoothing=0.5, max_missing=3, max_faces=2, width=140, height=80)
    rows = run(spark, 2, [face(0, 0, 10), face(0, 1, 92), face(1, 2, 89), face(1, 3, 13)], config)
    centres = sorted((i.x1 + i.x2) / 2 for i in rows[1].instances)
    assert len(rows[0].instances) == len(centres) == 2
    assert centres[0] < 35 and centres[1] > 100
    assert sorted(i.x1 for i in rows[1].instances) == [11.5, 90.5]


def ambiguous_case(spark, max_faces):
    config = TrackConfig(min_similarity=0.3, smoothing=0.0, max_missing=2, max_faces=max_faces, ambiguity_margin=0.05, width=96, height=72, full_scan_interval=1)
    faces = [face(0, 0, 10, 1.0), face(0, 1, 55, 0.0), face(1, 2, 10, 1.0), face(1, 3, 55, 0.9994), face(2, 4, 10, 1.0), face(2, 5, 55, 0.0)]
    frames, detections = frames_of(spark, 3), spark.createDataFrame(faces, DET)
    tracked = tracking.to_track_frames(tracking.track(frames, detections, None, config))
    summary = sequence.track_summary(tracked).collect()[0]
    return sorted(tracked.collect(), key=lambda r: r.frame_index), summary


def test_ambiguous_frame_holds_no_target(spark):
    rows, summary = ambiguous_case(spark, 1)
    assert summary.coverage == pytest.approx(2 / 3) and summary.ambiguous_ratio == pytest.approx(1 / 3)
    assert rows[1].ambiguous and rows[1].x1 is None and rows[2].x1 is not None


def test_two_targets_are_never_ambiguous(spark):
    rows, summary = ambiguous_case(spark, 2)
    assert summary.coverage == 1.0 and summary.ambiguous_ratio == 0.0 and summary.max_instances == 2
    assert [r.n_instances for r in rows] == [1, 2, 1]


def test_track_gate(spark):
    config = TrackConfig(max_missing=0, width=140, height=80)
    frames, detections = frames_of(spark, 10), spark.createDataFrame([face(0, 0, 10)], DET)
    gate = lambda **o: tracking.track_quality_gate(frames, detections, None, config, **o)
    assert gate(min_coverage=0.5).collect()[0].violation == "low_coverage"
    assert gate(min_coverage=0.05).collect()[0].violation is None
    with pytest.raises(Exception, match="low_coverage"):
        gate(min_coverage=0.5, strict=True).collect()


def random_video(seed, n=120):
    rng = random.Random(seed)
    faces, det_id, motion, hists = [], 0, [], {}
    for f in range(n):
        if f % 40 == 17:
            hists.update({g: [float(1 + f), 1.0, 50.0 - f % 40] for g in range(f, n)})
        if not 60 <= f < 75:
            for slot in range(rng.choice((0, 1, 2, 3))):
                faces.append(face(f, det_id, slot * 45 + rng.uniform(-4, 4) + f * 0.2, rng.uniform(0.2, 1.0), y1=rng.uniform(10, 14)))
                det_id += 1
            if rng.random() < 0.7:
                motion.append((1, f, 1.0, 0.0, rng.uniform(-3, 3), 0.0, 1.0, rng.uniform(-2, 2)))
    return faces, motion, hists


@pytest.mark.parametrize("profile", ["temporal", "frame"])
@pytest.mark.parametrize("max_faces", [1, 2])
def test_split_tracking_equals_whole_tracking(spark, profile, max_faces):
    faces, motion, hists = random_video(11)
    config = TrackConfig(
        min_similarity=0.3, max_missing=2, max_faces=max_faces, detection_interval=4, cut_threshold=0.2, width=240, height=80, profile=profile
    )
    frames = frames_of(spark, 120, hists)
    detections = spark.createDataFrame(faces, DET)
    moves = spark.createDataFrame(motion, "video_id long, frame_index long, m00 double, m01 double, m02 double, m10 double, m11 double, m12 double")

    def result(split, **options):
        rows = tracking.track(frames, detections, moves, config, split=split, **options).collect()
        plain = {
            r.frame_index: (r.scene_cut, r.detection_due, r.full_scan, r.ambiguous, round(r.similarity, 9), [(i.det_id, i.track_id, round(i.x1, 6), round(i.y2, 6)) for i in r.instances])
            for r in rows
        }
        return plain, len({(r.segment, r.chunk) for r in rows})

    (whole, one), (parts, several) = result(False), result(True)
    assert one == 1 and several > 3 and whole == parts
    pieces, most = result(True, chunk_frames=5)
    assert most > several and pieces == whole
    assert all(len({i[0] for i in row[5]}) == len(row[5]) for row in parts.values())
    assert any(row[5] for row in parts.values())


def test_ids_pass_through_pieces(spark):
    config = TrackConfig(min_similarity=0.3, max_faces=2, detection_interval=100, max_missing=50, width=400, height=80)
    faces = [face(0, 0, 10), face(0, 1, 90)] + [face(20, 2, 10), face(20, 3, 90)]
    moves = spark.createDataFrame([(1, f, 1.0, 0.0, 0.5, 0.0, 1.0, 0.0) for f in range(1, 30)], "video_id long, frame_index long, m00 double, m01 double, m02 double, m10 double, m11 double, m12 double")
    detections = spark.createDataFrame(faces, DET)
    ids = lambda chunk: sorted((r.frame_index, [(i.track_id, round(i.x1, 6)) for i in r.instances]) for r in tracking.track(frames_of(spark, 30), detections, moves, config, chunk_frames=chunk).collect())
    assert ids(4) == ids(7) == ids(1000) and {len(x[1]) for x in ids(4)} == {2}


def test_state_survives_a_snapshot():
    config = TrackConfig(min_similarity=0.3, max_faces=2, width=240, height=80)
    frames = [[{"similarity": 0.9, "det_id": i, "x1": 10.0 + i, "y1": 10.0, "x2": 40.0 + i, "y2": 50.0, "kps": []}] for i in range(6)]
    whole, halves = TrackFold(config), TrackFold(config)
    for i, found in enumerate(frames):
        a = whole.step(i, False, False, 0.9, found, None)
        halves = TrackFold(config, halves.snapshot())
        assert halves.step(i, False, False, 0.9, found, None) == a


def test_crowded_frames_take_the_other_route(spark):
    rng = random.Random(2)
    faces = [face(f, f * 100 + i, rng.uniform(0, 100), rng.choice((0.4, 0.6, 0.8)), y1=rng.uniform(0, 30)) for f in range(3) for i in range(60)]
    config = TrackConfig(min_similarity=0.3, max_faces=2, width=240, height=80)
    show = lambda rows: [(r.frame_index, [(i.det_id, round(i.x1, 6)) for i in r.instances]) for r in rows]
    assert show(run(spark, 3, faces, config)) == show(run(spark, 3, faces, config, crowded=20))


def test_motion_moves_a_track(spark):
    config = TrackConfig(min_similarity=0.3, detection_interval=100, width=240, height=80)
    moves = spark.createDataFrame([(1, 1, 1.0, 0.0, 4.0, 0.0, 1.0, 2.0)], "video_id long, frame_index long, m00 double, m01 double, m02 double, m10 double, m11 double, m12 double")
    tracked = tracking.track(frames_of(spark, 2), spark.createDataFrame([face(0, 0, 10)], DET), moves, config)
    second = tracked.filter(F.col("frame_index") == 1).collect()[0]
    assert second.used_motion and (second.instances[0].x1, second.instances[0].y1) == (14.0, 14.0)


def test_association_of_single_frames(spark):
    config = TrackConfig(min_similarity=0.5, max_faces=2, width=140, height=80)
    candidates = tracking.frame_candidates(spark.createDataFrame([face(1, 2, 89), face(1, 3, 13), face(1, 4, 50, 0.6)], DET), config)
    box = "struct<track_id:bigint,x1:double,y1:double,x2:double,y2:double>"
    running = spark.createDataFrame(
        [(1, 1, [(0, 10.0, 12.0, 40.0, 52.0), (7, 92.0, 12.0, 122.0, 52.0)])], f"video_id long, frame_index long, tracks array<{box}>"
    )
    pairs = lambda limit: {(r.track_id, r.det_id, r.opened) for r in tracking.associate(running, candidates, max_faces=limit, smoothing=0.5).collect()}
    assert pairs(2) == {(0, 3, False), (7, 2, False)}
    assert pairs(3) == {(0, 3, False), (7, 2, False), (8, 4, True)}


MOTION = "video_id long, frame_index long, m00 double, m01 double, m02 double, m10 double, m11 double, m12 double"


def test_motion_rides_through_six_pieces_in_two_folds(spark, monkeypatch):
    config = TrackConfig(min_similarity=0.3, max_faces=2, detection_interval=100, width=400, height=300)
    turn = lambda f: (0.999, -0.03, 1.4, 0.03, 0.999, -1.1) if f % 2 else (0.998, 0.02, -0.8, -0.02, 1.001, 1.2)
    moves = spark.createDataFrame([(1, f, *turn(f)) for f in range(1, 60)], MOTION)
    detections = spark.createDataFrame([face(0, 0, 100, y1=100.0), face(0, 1, 200, y1=120.0)], DET)
    folds, whole = [], tracking._fold_pieces
    monkeypatch.setattr(tracking, "_fold_pieces", lambda *a, **o: (folds.append(o["states"]), whole(*a, **o))[1])
    result = lambda chunk: {r.frame_index: [(i.track_id, *(round(v, 6) for v in (i.x1, i.y1, i.x2, i.y2, i.kps[2].x))) for i in r.instances] for r in tracking.track(frames_of(spark, 60), detections, moves, config, chunk_frames=chunk).collect()}
    pieces = result(10)
    assert sum(folds) == 2  # rounds that look for the states
    assert pieces == result(1000) and all(len(v) == 2 for v in pieces.values())
    # a track that leaves the picture within a piece is found out
    away = spark.createDataFrame([(1, f, 1.0, 0.0, 9.0, 0.0, 1.0, 0.0) for f in range(1, 60)], MOTION)
    left = lambda chunk: [(r.frame_index, r.detection_due, [(i.track_id, round(i.x1, 6)) for i in r.instances]) for r in sorted(tracking.track(frames_of(spark, 60), detections, away, config, chunk_frames=chunk).collect())]
    assert left(7) == left(1000) and not left(7)[-1][2]


def plain_target(frames, faces, motion, config):
    """Frame after frame, by the words of the rule."""
    held, out = None, {}
    for f, cut in frames:
        held = None if cut else held
        due = held is None or held["missing"] > 0 or cut or f % config.detection_interval == 0
        own = [d for d in faces if d[1] == f and d[9] is not None]
        chosen = None
        if due:
            def score(d):
                if held is None:
                    return 0.78 * d[9]
                a, b = held["box"], d[3:7]
                shared = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
                union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
                return 0.78 * d[9] + 0.22 * (shared / union if union > 0 else 0)
            best = max(own, key=lambda d: (score(d), -d[2]), default=None)
            if best is not None and best[9] >= config.min_similarity:
                s = config.smoothing
                box = list(best[3:7]) if held is None else [s * o + (1 - s) * n for o, n in zip(held["box"], best[3:7])]
                held = chosen = {"box": box, "missing": 0, "det": best[2]}
        elif f in motion:
            a, b, tx, c, d, ty = motion[f]
            x1, y1, x2, y2 = held["box"]
            xs, ys = zip(*((a * x + b * y + tx, c * x + d * y + ty) for x in (x1, x2) for y in (y1, y2)))
            if max(xs) > 0 and max(ys) > 0 and min(xs) < config.width and min(ys) < config.height:
                held = chosen = {"box": [min(xs), min(ys), max(xs), max(ys)], "missing": 0, "det": held["det"]}
        if chosen is None and held is not None:
            held["missing"] += 1
            held = held if held["missing"] <= config.max_missing else None
        out[f] = (due, chosen and chosen["det"], chosen and [round(v, 6) for v in chosen["box"]])
    return out


@pytest.mark.parametrize("interval", [1, 4])
def test_follow_target_equals_the_plain_rule(spark, interval):
    faces, motion, hists = random_video(5)
    faces += [face(f, 1000 + f, 20 + f * 0.2, 0.05) for f in range(0, 120, 3)]  # weak, but where the box is
    config = TrackConfig(min_similarity=0.45, smoothing=0.6, max_missing=2, detection_interval=interval, cut_threshold=0.2, width=240, height=80)
    frames = frames_of(spark, 120, hists)
    cuts = {r.frame_index: r.scene_cut for r in sequence.scene_cuts(frames, 0.2).collect()}
    want = plain_target(sorted(cuts.items()), faces, {m[1]: m[2:] for m in motion}, config)
    moves = spark.createDataFrame(motion, MOTION)
    detections = spark.createDataFrame(faces + [(1, 3, 999, 0.0, 0.0, 9.0, 9.0, 0.9, [], None)], DET)
    for options in ({}, {"chunk_frames": 6}, {"split": False}):
        rows = tracking.follow_target(frames, detections, moves, config, **options).collect()
        assert {r.frame_index: (r.detection_due, r.det_id, r.x1 if r.x1 is None else [round(v, 6) for v in (r.x1, r.y1, r.x2, r.y2)]) for r in rows} == want
    assert any(v[1] is None for v in want.values()) and any(cuts.values()) and sum(v[1] is not None for v in want.values()) > 30
