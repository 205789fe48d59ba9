"""Queries over sequences, windows and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.functions import masked_mae, mean_abs_difference
from framelens.operators import filters, grid, runs, sequence, tracking, windows
from framelens.plans.catalog import q6, query, r6
from framelens.plans.identity_queries import nms_sql
from framelens.plans.scalar_queries import DISTANCE, HIST_PAIRS, LAPLACE, VALID_MOTION, diagonal_sql, ellipse_sql, gap_sql, iou_sql, moved_box_sql
from framelens.plans.tracking_sql import target_steps, track_steps
from framelens.plans.views import FRAME_HEIGHT, FRAME_WIDTH, table, view

W, H = FRAME_WIDTH, FRAME_HEIGHT
CUT = 0.185
CUTS_SQL = f"SELECT video_id, frame_index, coalesce({DISTANCE} >= {CUT}, false) AS scene_cut FROM ({HIST_PAIRS}) h"


@query("win1_scene_cuts", CUTS_SQL)
def win1(spark, sf_dir):
    return sequence.scene_cuts(view(spark, sf_dir, "v_hist"), CUT).select("video_id", "frame_index", "scene_cut")


@query("win2_scene_id", f"""
SELECT video_id, frame_index, CAST(sum(CAST(scene_cut AS INT)) OVER (PARTITION BY video_id ORDER BY frame_index) AS BIGINT) AS scene_id FROM ({CUTS_SQL}) c
""")
def win2(spark, sf_dir):
    cut = sequence.scene_cuts(view(spark, sf_dir, "v_hist"), CUT)
    return sequence.scene_id(cut).select("video_id", "frame_index", "scene_id")


RUNS = """
SELECT *, idx - coalesce(max(CASE WHEN hit THEN idx END) OVER (PARTITION BY key ORDER BY idx), -1) AS run,
       max(CASE WHEN hit THEN idx END) OVER (PARTITION BY key ORDER BY idx) AS last_hit,
       max(CASE WHEN hit THEN idx END) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
FROM v_seq"""


@query("win3_missing_run", f"SELECT event_id, run AS missing_run, run > 1 AS expired, last_hit IS NOT NULL AND run <= 1 AS held FROM ({RUNS}) r")
def win3(spark, sf_dir):
    return sequence.missing_run(view(spark, sf_dir, "v_seq"), 1).select("event_id", "missing_run", "expired", "held")


@query("win4_ema", f"""
SELECT key, idx, {q6("list_reduce(list_prepend(NULL, xs), lambda a, b: CASE WHEN a IS NULL THEN b ELSE 0.6180339887 * a + (1 - 0.6180339887) * b END)")} AS smoothed
FROM (SELECT key, idx, list(x) OVER (PARTITION BY key, island ORDER BY idx) AS xs FROM (
  SELECT *, sum(CASE WHEN before IS NULL OR idx - before - 1 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY idx) AS island
  FROM ({RUNS}) r WHERE hit) h) l
""")
def win4(spark, sf_dir):
    hits = sequence.restart_after_gap(view(spark, sf_dir, "v_seq"), 0).select("key", "idx", "x", "restart")
    return sequence.ema(hits, 0.6180339887).select("key", "idx", r6("smoothed").alias("smoothed"))


@query("win5_temporal_delta", f"""
SELECT vec_id, {q6("CASE WHEN vec_id % 6 <> 5 AND before_id % 6 <> 5 THEN list_avg(list_transform(list_zip(before, output), lambda p: abs(p[1] - p[2]))) END")} AS delta
FROM (SELECT vec_id, output, lag(output) OVER w AS before, lag(vec_id) OVER w AS before_id FROM v_pairs WINDOW w AS (PARTITION BY video_id ORDER BY frame_index)) t
""")
def win5(spark, sf_dir):
    frames = view(spark, sf_dir, "v_pairs")
    moved = sequence.temporal_delta(frames, values="output", present=F.col("vec_id") % 6 != 5)
    return moved.select("vec_id", r6("delta").alias("delta"))


@query("win6_boundary_jump", f"""
SELECT event_id, {q6("x / greatest(1.0, coalesce(base, greatest(x, 1.0)))")} AS jump
FROM (SELECT *, median(x) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS base FROM v_seq WHERE hit) t WHERE boundary
""")
def win6(spark, sf_dir):
    seq = view(spark, sf_dir, "v_seq").withColumn("delta", F.when(F.col("hit"), F.col("x")))
    return sequence.boundary_jump(seq).select("event_id", r6("jump").alias("jump"))


@query("win7_overlap_before", """
SELECT video_id, clip_index, coalesce(greatest(0, lag(start_frame + valid_frames) OVER (PARTITION BY video_id ORDER BY clip_index) - start_frame), 0) AS overlap_before FROM v_clips
""")
def win7(spark, sf_dir):
    clips = view(spark, sf_dir, "v_clips").drop("overlap_before")
    return windows.overlap_before(clips).select("video_id", "clip_index", "overlap_before")


@query("win10_timeline_sample", """
SELECT f.video_id, f.frame_index, CAST(s.k AS BIGINT) AS sample
FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM v_frames) f JOIN (SELECT unnest(range(6)) AS k) s
ON f.frame_index = CAST(round_even((0.05 + CAST(0.90 AS DOUBLE) * s.k / 5) * (f.n - 1), 0) AS BIGINT)
""")
def win10(spark, sf_dir):
    return sequence.timeline_sample(view(spark, sf_dir, "v_frames"), 6).select(
        "video_id", "frame_index", F.col("sample").cast("long").alias("sample")
    )


@query("agg4_metric_summary", f"""
SELECT event_type, count(value) AS value_count, {q6("avg(value)")} AS value_mean, {q6("stddev_pop(value)")} AS value_std, {q6("quantile_cont(value, 0.95)")} AS value_p95
FROM events GROUP BY event_type
""")
def agg4(spark, sf_dir):
    summary = sequence.metric_summary(table(spark, sf_dir, "events"), ["value"], keys=["event_type"])
    return summary.select("event_type", "value_count", *(r6(f"value_{p}").alias(f"value_{p}") for p in ("mean", "std", "p95")))


@query("agg4_metric_summary_all", f"""
SELECT count(l_extendedprice) AS l_extendedprice_count, {q6("quantile_cont(l_extendedprice, 0.95)")} AS l_extendedprice_p95,
       {q6("stddev_pop(l_quantity)")} AS l_quantity_std, {q6("quantile_cont(l_quantity, 0.95)")} AS l_quantity_p95 FROM lineitem
""")
def agg4_all(spark, sf_dir):
    summary = sequence.metric_summary(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"])
    return summary.select(
        "l_extendedprice_count", r6("l_extendedprice_p95").alias("l_extendedprice_p95"), r6("l_quantity_std").alias("l_quantity_std"),
        r6("l_quantity_p95").alias("l_quantity_p95"),
    )


def _quality_frames(spark, sf_dir):
    pairs = view(spark, sf_dir, "v_pairs")
    moved = sequence.temporal_delta(pairs, values="output").withColumn(
        "outside_mask_mae", masked_mae("original", "output", "alpha")
    )
    jumps = sequence.boundary_jump(
        moved.select("video_id", "frame_index", "delta", (F.col("frame_index") % 32 == 0).alias("boundary")),
        keys=["video_id"], index="frame_index",
    ).select("video_id", "frame_index", F.col("jump").alias("chunk_boundary_jump_ratio"))
    sampled = F.col("frame_index") % 8 == 0
    return moved.join(jumps, ["video_id", "frame_index"], "left").select(
        "video_id", "frame_index", F.when(sampled, F.col("original")[0] / 255).alias("identity_similarity"),
        F.when(sampled, F.col("alpha")[0]).alias("normalized_landmark_error"), "outside_mask_mae",
        F.col("delta").alias("temporal_frame_delta"), "chunk_boundary_jump_ratio",
    )


def _summary_sql(alias: str, value: str) -> str:
    return (
        f"count({value}) AS {alias}_count, {q6(f'avg({value})')} AS {alias}_mean, {q6(f'stddev_pop({value})')} AS {alias}_std, "
        f"{q6(f'quantile_cont({value}, 0.95)')} AS {alias}_p95"
    )


@query("agg5_quality_report", f"""
WITH d AS (SELECT video_id, frame_index, original, alpha,
    list_avg(list_transform(list_filter(list_zip(original, output, alpha), lambda c: c[3] < 0.01), lambda c: abs(c[1] - c[2]))) AS mae,
    list_avg(list_transform(list_zip(lag(output) OVER w, output), lambda p: abs(p[1] - p[2]))) AS delta
  FROM v_pairs WINDOW w AS (PARTITION BY video_id ORDER BY frame_index)),
e AS (SELECT *, CASE WHEN frame_index % 8 = 0 THEN original[1] / 255 END AS ident, CASE WHEN frame_index % 8 = 0 THEN alpha[1] END AS marks,
    CASE WHEN frame_index % 32 = 0 AND delta IS NOT NULL THEN delta / greatest(1.0, coalesce(median(delta) OVER (PARTITION BY video_id ORDER BY frame_index ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), greatest(delta, 1.0))) END AS jump FROM d)
SELECT video_id, {_summary_sql("ident", "ident")}, {_summary_sql("marks", "marks")}, {_summary_sql("mae", "mae")}, {_summary_sql("delta", "delta")}, {_summary_sql("jump", "jump")}
FROM e GROUP BY video_id
""")
def agg5(spark, sf_dir):
    report = sequence.quality_report(_quality_frames(spark, sf_dir))
    short = dict(zip(sequence.QUALITY_METRICS, ("ident", "marks", "mae", "delta", "jump")))
    return report.select(
        "video_id", *(F.col(f"{m}.count").alias(f"{s}_count") for m, s in short.items()),
        *(r6(f"{m}.{p}").alias(f"{s}_{p}") for m, s in short.items() for p in ("mean", "std", "p95")),
    )


TRACK_SUMMARY = """
SELECT video_id, count(*) AS frames, avg(CAST(located AS INT)) AS coverage, avg(CAST(ambiguous AS INT)) AS ambiguous_ratio, avg(n_instances) AS average_instances,
       max(n_instances) AS max_instances, count(CASE WHEN n_instances > 1 THEN 1 END) AS multi_instance_frames, count(CASE WHEN scene_cut THEN 1 END) AS scene_cuts
FROM v_track GROUP BY video_id"""
RATIOS = ("coverage", "ambiguous_ratio", "average_instances")


@query("agg7_track_summary", f"""
SELECT video_id, frames, {", ".join(f"{q6(c)} AS {c}" for c in RATIOS)}, max_instances, multi_instance_frames, scene_cuts FROM ({TRACK_SUMMARY}) s
""")
def agg7(spark, sf_dir):
    summary = sequence.track_summary(view(spark, sf_dir, "v_track"))
    return summary.select(
        "video_id", "frames", *(r6(c).alias(c) for c in RATIOS), "max_instances", F.col("multi_instance_frames").cast("long").alias("multi_instance_frames"), "scene_cuts"
    )


@query("flt8_track_gate", f"""
SELECT video_id, CASE WHEN coverage < 0.5 THEN 'low_coverage' WHEN ambiguous_ratio > 0.1 THEN 'too_ambiguous' END AS violation FROM ({TRACK_SUMMARY}) s
""")
def flt8(spark, sf_dir):
    summary = sequence.track_summary(view(spark, sf_dir, "v_track"))
    return filters.track_gate(summary, min_coverage=0.5, max_ambiguous=0.1).select("video_id", "violation")


@query("flagship_track_quality", f"""
SELECT video_id, frames, {q6("coverage")} AS coverage, {q6("ambiguous_ratio")} AS ambiguous_ratio, max_instances,
       CASE WHEN coverage < 0.05 THEN 'low_coverage' WHEN ambiguous_ratio > 0.15 THEN 'too_ambiguous' END AS violation FROM ({TRACK_SUMMARY}) s
""")
def flagship(spark, sf_dir):
    """Detections to similarity, frames, coverage and ambiguity, and the gate."""
    gated = filters.track_gate(sequence.track_summary(view(spark, sf_dir, "v_track")))
    return gated.select(
        "video_id", "frames", r6("coverage").alias("coverage"), r6("ambiguous_ratio").alias("ambiguous_ratio"), "max_instances", "violation"
    )


@query("trk5_to_track_frames", f"""
SELECT video_id, frame_index, located, n_instances, {q6("similarity")} AS similarity, det_id, {q6("yaw")} AS yaw, {q6("pitch")} AS pitch FROM v_track
""")
def trk5(spark, sf_dir):
    return view(spark, sf_dir, "v_track").select(
        "video_id", "frame_index", "located", "n_instances", r6("similarity").alias("similarity"), "det_id", r6("yaw").alias("yaw"), r6("pitch").alias("pitch")
    )


@query("set2_clean_cuts", """
SELECT video_id, array_to_string(list_sort(list_distinct(list_filter([n % 7, -3, 5, n, n - 1, 5, (n * 3) % 50], lambda c: c > 0 AND c < n))), ',') AS cuts
FROM (SELECT video_id, requested_frames AS n FROM v_videos) v
""")
def set2(spark, sf_dir):
    n = F.col("requested_frames")
    lit = lambda x: F.lit(x).cast("long")
    raw = F.array(n % 7, lit(-3), lit(5), n, n - 1, lit(5), (n * 3) % 50)
    return view(spark, sf_dir, "v_videos").select(
        "video_id", F.array_join(windows.clean_cuts(raw, n).cast("array<string>"), ",").alias("cuts")
    )


CLIP_COLUMNS = ("video_id", "clip_index", "start_frame", "valid_frames", "overlap_before", "hard_cut_before", "seed")


@query("set5_plan_windows", f"SELECT {', '.join(CLIP_COLUMNS)} FROM v_clips")
def set5(spark, sf_dir):
    return view(spark, sf_dir, "v_clips").select(*CLIP_COLUMNS)


@query("set5_plan_windows_regular", """
SELECT video_id, k AS clip_index, k * 32 AS start_frame, least(49, n - k * 32) AS valid_frames, CASE WHEN k = 0 THEN 0 ELSE 17 END AS overlap_before, 100 + k * 32 AS seed
FROM (SELECT video_id, requested_frames AS n, unnest(range(1 + CAST(ceil(greatest(0, requested_frames - 49) / 32.0) AS BIGINT))) AS k FROM v_videos) v
""")
def set5_regular(spark, sf_dir):
    return windows.plan_windows(view(spark, sf_dir, "v_videos")).select(*(c for c in CLIP_COLUMNS if c != "hard_cut_before"))


@query("agg9_clip_plan_stats", """
SELECT video_id, clip_count, clip_count * 49 AS generated_frames, valid AS valid_window_frames, greatest(0, valid - n) AS duplicated_overlap_frames, greatest(0, clip_count * 49 - valid) AS padded_window_frames
FROM (SELECT video_id, count(*) AS clip_count, CAST(sum(valid_frames) AS BIGINT) AS valid, any_value(requested_frames) AS n FROM v_clips JOIN v_videos USING (video_id) GROUP BY video_id) s
""")
def agg9(spark, sf_dir):
    return windows.clip_plan_stats(view(spark, sf_dir, "v_clips"), view(spark, sf_dir, "v_videos"))


@query("jn4_clip_frames", """
SELECT c.video_id, c.clip_index, f.frame_index FROM v_clips c JOIN v_frames f ON f.video_id = c.video_id AND f.frame_index >= c.start_frame AND f.frame_index < c.start_frame + c.valid_frames
""")
def jn4(spark, sf_dir):
    return windows.clip_frames(view(spark, sf_dir, "v_clips"), view(spark, sf_dir, "v_frames")).select("video_id", "clip_index", "frame_index")


@query("jn5_pad_to_length", """
SELECT video_id, clip_index, k AS "offset", CAST((video_id * 31 + clip_index * 17 + least(k, valid_frames - 1) * 7) % 256 AS DOUBLE) AS value
FROM (SELECT *, unnest(range(49)) AS k FROM v_clips) c
""")
def jn5(spark, sf_dir):
    return windows.pad_to_length(view(spark, sf_dir, "v_clip_values"), 49)


@query("jn6_nearest_cut", """
SELECT c.video_id, c.clip_index, arg_min(k.cut, {'d': abs(k.cut - c.start_frame), 'c': k.cut}) AS nearest_cut
FROM v_clips c LEFT JOIN v_cuts k ON k.video_id = c.video_id AND abs(k.cut - c.start_frame) <= 12 GROUP BY c.video_id, c.clip_index
""")
def jn6(spark, sf_dir):
    return windows.nearest_cut(view(spark, sf_dir, "v_clips"), view(spark, sf_dir, "v_cuts"), 12).select("video_id", "clip_index", "nearest_cut")


@query("set6_stitch", f"""
WITH l AS (SELECT v.video_id, c.start_frame + v."offset" AS frame_index, v.clip_index, v."offset" AS o, v.value, c.overlap_before AS ov, c.hard_cut_before AS hard
  FROM v_clip_values v JOIN v_clips c USING (video_id, clip_index)),
s AS (SELECT video_id, frame_index, list({{'v': value, 'w': CASE WHEN hard OR o >= ov THEN 1.0 ELSE 0.5 - 0.5 * cos(pi() * (o + 1) / (ov + 1)) END}} ORDER BY clip_index) AS items,
      count(*) AS layers, arg_max(clip_index > 0 AND o = 0 AND (hard OR ov > 0), clip_index) AS boundary FROM l GROUP BY video_id, frame_index)
SELECT video_id, frame_index, layers, boundary, {q6("list_reduce(items, lambda a, b: {'v': a.v * (1.0 - b.w) + b.v * b.w, 'w': 1.0}).v")} AS value FROM s
""")
def set6(spark, sf_dir):
    stitched = windows.stitch(view(spark, sf_dir, "v_clip_values"), view(spark, sf_dir, "v_clips"))
    return stitched.select("video_id", "frame_index", F.col("layers").cast("long").alias("layers"), "boundary", r6("value").alias("value"))


@query("jn3_frame_pair_join", f"""
SELECT a.vec_id, {q6("list_avg(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))")} AS change
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def jn3(spark, sf_dir):
    frames = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    shifted = frames.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("output"))
    pairs = sequence.frame_pair_join(frames, shifted, keys=["vec_id"])
    return pairs.select("vec_id", r6(mean_abs_difference("embedding", "output")).alias("change"))


@query("jn13_motion_propagate", f"""
WITH o AS (SELECT video_id, frame_index, arg_max({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}, {{'a': w * h, 'd': -det_id}}) AS box FROM v_det WHERE det_score >= 0.9 AND embedding IS NOT NULL GROUP BY video_id, frame_index),
j AS (SELECT m.*, last_value(o.box IGNORE NULLS) OVER (PARTITION BY m.video_id ORDER BY m.frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v_motion m LEFT JOIN o USING (video_id, frame_index)),
k AS (SELECT *, {", ".join(f"{side} AS m{name}" for name, side in zip(("x1", "y1", "x2", "y2"), moved_box_sql("b")))} FROM j WHERE b IS NOT NULL)
SELECT video_id, frame_index, {q6("mx1")} AS moved_x1, {q6("my1")} AS moved_y1, {q6("mx2")} AS moved_x2, {q6("my2")} AS moved_y2,
       {VALID_MOTION} AND mx2 > 0 AND my2 > 0 AND mx1 < 240 AND my1 < 180 AS accepted FROM k
""")
def jn13(spark, sf_dir):
    det = view(spark, sf_dir, "v_det").filter((F.col("det_score") >= 0.9) & F.col("embedding").isNotNull())
    largest = det.groupBy("video_id", "frame_index").agg(
        F.max_by(F.struct("x1", "y1", "x2", "y2"), F.struct(F.col("w") * F.col("h"), -F.col("det_id"))).alias("_box")
    ).select("video_id", "frame_index", "_box.*")
    moved = tracking.motion_step(largest, view(spark, sf_dir, "v_motion"), tracking.TrackConfig(width=W, height=H))
    return moved.select(
        "video_id", "frame_index", *(r6(f"moved_{c}").alias(f"moved_{c}") for c in ("x1", "y1", "x2", "y2")), "accepted"
    )


# Grids.

REGION = 140


def _instances_of_cells(spark, sf_dir):
    """Two instances per frame: the left and the upper half-plane of its grid."""
    cells = view(spark, sf_dir, "v_cells")
    left = cells.filter(F.col("cx") < 3).select("frame_id", F.lit(0).cast("long").alias("instance"), "cx", "cy", "v")
    upper = cells.filter(F.col("cy") < 2).select("frame_id", F.lit(1).cast("long").alias("instance"), "cx", "cy", (F.col("v") / 2).cast("int").alias("v"))
    return left.unionByName(upper)


INSTANCE_CELLS = """
SELECT frame_id, CAST(0 AS BIGINT) AS instance, cx, cy, v FROM v_cells WHERE cx < 3
UNION ALL SELECT frame_id, 1, cx, cy, CAST(floor(v / 2) AS INT) FROM v_cells WHERE cy < 2"""

COMPONENTS = f"""RECURSIVE front AS MATERIALIZED (SELECT frame_id, cx, cy, cy * 2147483648 + cx AS id FROM v_cells WHERE v >= {REGION}),
reach AS (
  SELECT frame_id, id, id AS other FROM front
  UNION
  SELECT r.frame_id, r.id, b.id FROM reach r JOIN front a ON a.frame_id = r.frame_id AND a.id = r.other
  JOIN front b ON b.frame_id = a.frame_id AND abs(b.cx - a.cx) <= 1 AND abs(b.cy - a.cy) <= 1),
labelled AS MATERIALIZED (SELECT frame_id, id, min(other) AS component, count(*) AS area FROM reach GROUP BY frame_id, id),
parts AS MATERIALIZED (SELECT f.frame_id, f.cx, f.cy, l.component, l.area FROM front f JOIN labelled l USING (frame_id, id) WHERE area >= 4)"""


@query("agg12_union_masks", f"""
SELECT frame_id, cx, cy, max(v) AS v FROM ({INSTANCE_CELLS}) c GROUP BY frame_id, cx, cy
""")
def agg12(spark, sf_dir):
    return grid.union_masks(_instances_of_cells(spark, sf_dir))


@query("agg15_pixel_stats", f"""
SELECT frame_id, {q6("mean")} AS mean, {q6("sqrt(sharpness_var)")} AS sharpness_std, {q6("clipped")} AS clipped_fraction FROM ({LAPLACE}) s
""")
def agg15(spark, sf_dir):
    stats = grid.pixel_stats(view(spark, sf_dir, "v_cells"))
    return stats.select(
        "frame_id", r6("mean").alias("mean"), r6(F.sqrt("sharpness_var")).alias("sharpness_std"), r6("clipped_fraction").alias("clipped_fraction")
    )


@query("agg16_histogram32", f"""
SELECT frame_id, array_to_string([{", ".join(f"count(CASE WHEN floor(v / 8) = {i} THEN 1 END)" for i in range(32))}], ',') AS hist FROM v_cells GROUP BY frame_id
""")
def agg16(spark, sf_dir):
    return grid.histogram32(view(spark, sf_dir, "v_cells")).select(
        "frame_id", F.array_join(F.col("hist").cast("array<string>"), ",").alias("hist")
    )


@query("agg17_component_label", f"WITH {COMPONENTS} SELECT frame_id, cx, cy, component, area FROM parts")
def agg17(spark, sf_dir):
    found = runs.component_runs(view(spark, sf_dir, "v_cells"), 4, threshold=REGION, height=8)
    return runs.open_runs(found).select("frame_id", "cx", "cy", "component", "area")


@query("agg17_component_runs", f"""
WITH {COMPONENTS}, islands AS (SELECT *, cx - row_number() OVER (PARTITION BY frame_id, cy ORDER BY cx) AS run FROM parts)
SELECT frame_id, cy, min(cx) AS x0, max(cx) AS x1, component, area FROM islands GROUP BY frame_id, cy, run, component, area
""")
def agg17_runs(spark, sf_dir):
    """Strips of two lines, so components go on from strip to strip."""
    return runs.component_runs(view(spark, sf_dir, "v_cells"), 4, threshold=REGION, strip=2)


MATCHES = f"""
matches AS MATERIALIZED (SELECT frame_id, component, instance, overlap, overlap / CAST(instance_area AS DOUBLE) AS coverage FROM (
  SELECT p.frame_id, p.component, i.instance, count(*) AS overlap, any_value(p.area) AS area FROM parts p JOIN ({INSTANCE_CELLS}) i USING (frame_id, cx, cy) GROUP BY p.frame_id, p.component, i.instance) o
  JOIN (SELECT frame_id, instance, count(*) AS instance_area FROM ({INSTANCE_CELLS}) i GROUP BY frame_id, instance) a USING (frame_id, instance)
  WHERE overlap / CAST(area AS DOUBLE) >= 0.05 OR overlap / CAST(instance_area AS DOUBLE) >= 0.08)"""


def _matches(spark, sf_dir):
    parts = grid.component_label(view(spark, sf_dir, "v_cells"), 4, threshold=REGION, max_cells=64)
    return grid.box_instance_overlap(parts, _instances_of_cells(spark, sf_dir))


@query("jn7_box_instance_overlap", f"WITH {COMPONENTS}, {MATCHES} SELECT frame_id, component, instance, overlap, {q6('coverage')} AS coverage FROM matches")
def jn7(spark, sf_dir):
    return _matches(spark, sf_dir).select("frame_id", "component", "instance", "overlap", r6("coverage").alias("coverage"))


@query("jn8_uncovered_instances", f"""
WITH {COMPONENTS}, {MATCHES}
SELECT i.frame_id, i.instance, {q6("coalesce(c.coverage, 0)")} AS coverage FROM (SELECT DISTINCT frame_id, instance FROM ({INSTANCE_CELLS}) x) i
LEFT JOIN (SELECT frame_id, instance, max(coverage) AS coverage FROM matches GROUP BY frame_id, instance) c USING (frame_id, instance) WHERE coalesce(c.coverage, 0) < 0.3
""")
def jn8(spark, sf_dir):
    instances = _instances_of_cells(spark, sf_dir).select("frame_id", "instance").distinct()
    coverage = grid.instance_coverage(_matches(spark, sf_dir))
    return grid.uncovered_instances(instances, coverage, 0.3).select("frame_id", "instance", r6("coverage").alias("coverage"))


@query("agg10_mask_stats", f"""
WITH {COMPONENTS}, {MATCHES},
f AS (SELECT frame_id, CASE frame_id % 4 WHEN 0 THEN 0 ELSE frame_id % 4 - 1 END AS n, coalesce(r, 0) AS r, coalesce(k, 0) AS k FROM (SELECT DISTINCT frame_id FROM v_cells) x
  LEFT JOIN (SELECT frame_id, count(DISTINCT component) AS r FROM parts GROUP BY frame_id) a USING (frame_id)
  LEFT JOIN (SELECT frame_id, count(DISTINCT component) AS k FROM matches GROUP BY frame_id) b USING (frame_id))
SELECT count(*) AS frames_total, count(CASE WHEN n > 0 THEN 1 END) AS frames_with_target, count(CASE WHEN n > 1 THEN 1 END) AS frames_with_multiple_targets,
       count(CASE WHEN n <= 0 THEN 1 END) AS frames_without_target, CAST(sum(n) AS BIGINT) AS target_instances, CAST(max(n) AS BIGINT) AS max_target_instances,
       {q6("sum(n) / CAST(count(CASE WHEN n > 0 THEN 1 END) AS DOUBLE)")} AS average_target_instances, CAST(sum(r) AS BIGINT) AS raw_components, CAST(sum(k) AS BIGINT) AS kept_raw_components,
       CAST(sum(r) - sum(k) AS BIGINT) AS dropped_raw_components FROM f
""")
def agg10(spark, sf_dir):
    cells = view(spark, sf_dir, "v_cells")
    parts = grid.component_label(cells, 4, threshold=REGION, max_cells=64)
    matches = grid.box_instance_overlap(parts, _instances_of_cells(spark, sf_dir))
    count = lambda df, name: df.groupBy("frame_id").agg(F.countDistinct("component").alias(name))
    n = F.greatest(F.lit(0).cast("long"), F.col("frame_id") % 4 - 1)
    counters = cells.select("frame_id").distinct().withColumn("target_instances", n).join(
        count(parts, "raw_components"), "frame_id", "left").join(count(matches, "kept_raw_components"), "frame_id", "left"
    ).na.fill(0).withColumn("synthetic_instances_added", F.lit(0).cast("long"))
    stats = grid.mask_stats(counters)
    return stats.withColumn("average_target_instances", r6("average_target_instances")).drop("synthetic_instances_added")


# Ellipses of the two boxes below on the 8 x 8 grid; without eyes they are not turned.
ELLIPSE_CELLS = f"""
SELECT frame_id, CAST(instance AS BIGINT) AS instance, px AS cx, py AS cy FROM (SELECT DISTINCT frame_id FROM v_cells) f
CROSS JOIN (SELECT 0 AS instance, 0.0 AS x1 UNION ALL SELECT 1, 4.0) b0 CROSS JOIN (SELECT unnest(range(8)) AS px) gx CROSS JOIN (SELECT unnest(range(8)) AS py) gy
CROSS JOIN (SELECT 0.5 AS y1, 6.5 AS y2, 3.0 AS w, 6.0 AS h) b1
WHERE {ellipse_sql(0.51, 0.58, 0.52, False).replace("x2", "(x1 + w)")}"""


@query("set7_refine_regions", f"""
WITH {COMPONENTS}, cells AS MATERIALIZED ({ELLIPSE_CELLS}), {MATCHES.replace(INSTANCE_CELLS, "SELECT * FROM cells")},
best AS (SELECT i.frame_id, i.instance, coalesce(max(m.coverage), 0) AS coverage FROM (SELECT DISTINCT frame_id, instance FROM cells) i LEFT JOIN matches m USING (frame_id, instance) GROUP BY i.frame_id, i.instance),
refined AS (
  SELECT frame_id, cx, cy FROM parts JOIN (SELECT DISTINCT frame_id, component FROM matches) k USING (frame_id, component)
  UNION SELECT frame_id, cx, cy FROM cells JOIN best USING (frame_id, instance) WHERE coverage < 0.18)
SELECT frame_id, CAST(2 AS BIGINT) AS target_instances, coalesce(raw_components, 0) AS raw_components, coalesce(kept_raw_components, 0) AS kept_raw_components,
       synthetic_instances_added, area
FROM (SELECT frame_id, count(CASE WHEN coverage < 0.18 THEN 1 END) AS synthetic_instances_added FROM best GROUP BY frame_id) s
LEFT JOIN (SELECT frame_id, count(DISTINCT component) AS raw_components FROM parts GROUP BY frame_id) r USING (frame_id)
LEFT JOIN (SELECT frame_id, count(DISTINCT component) AS kept_raw_components FROM matches GROUP BY frame_id) k USING (frame_id)
LEFT JOIN (SELECT frame_id, count(*) AS area FROM refined GROUP BY frame_id) a USING (frame_id)
""")
def set7(spark, sf_dir):
    """Whole grids against two instances per frame, given by boxes on the 8 x 8 grid."""
    cells = view(spark, sf_dir, "v_cells").withColumn("v", F.when(F.col("v") >= REGION, F.col("v")).otherwise(F.lit(0)))
    frames = cells.select("frame_id").distinct()
    box = lambda i, x: F.struct(
        F.lit(i).cast("long").alias("instance"), F.lit(x).alias("x1"), F.lit(0.5).alias("y1"), F.lit(x + 3.0).alias("x2"), F.lit(6.5).alias("y2")
    )
    instances = frames.select("frame_id", F.explode(F.array(box(0, 0.0), box(1, 4.0))).alias("_i")).select(
        "frame_id", "_i.*", F.lit(None).cast("array<struct<x:double,y:double>>").alias("kps")
    )
    kept, added, counters = runs.refine(cells, instances, width=8, height=8, min_area=4)
    area = runs.union(kept.unionByName(added)).groupBy("frame_id").agg(F.sum(runs.run_length()).alias("area"))
    return counters.join(area, "frame_id", "left")


TARGET_MOMENTS = """
SELECT l_returnflag, count(*) AS n, avg(l_quantity * 5) AS m, stddev_pop(l_quantity * 5) AS s FROM lineitem GROUP BY l_returnflag"""


def _moment_input(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", (F.col("l_quantity") * 5).alias("x")
    )


@query("agg13_moment_match", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {q6("CASE WHEN g.n < 128 THEN l_quantity * 5 ELSE least(255.0, greatest(0.0, (l_quantity * 5 - g.m) * least(1.38, greatest(0.72, greatest(t.s, 3.0) / greatest(g.s, 3.0))) + t.m)) END")} AS matched
FROM lineitem l JOIN ({TARGET_MOMENTS}) g USING (l_returnflag), (SELECT * FROM ({TARGET_MOMENTS}) z WHERE l_returnflag = 'N') t
""")
def agg13(spark, sf_dir):
    matched = grid.moment_match(_moment_input(spark, sf_dir), "x", "l_returnflag", "N")
    return matched.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6("matched").alias("matched"))


@query("agg14_moment_match_strength", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {q6("0.6 * least(255.0, greatest(0.0, (l_quantity * 5 - g.m) * ((t.s + 1e-6) / (g.s + 1e-6)) + t.m)) + 0.4 * l_quantity * 5")} AS matched
FROM lineitem l JOIN ({TARGET_MOMENTS}) g USING (l_returnflag), (SELECT * FROM ({TARGET_MOMENTS}) z WHERE l_returnflag = 'N') t
""")
def agg14(spark, sf_dir):
    matched = grid.moment_match_strength(_moment_input(spark, sf_dir), "x", "l_returnflag", "N", 0.6)
    return matched.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6("matched").alias("matched"))


# Tracking.

def track_config(**changes) -> tracking.TrackConfig:
    base = dict(
        min_similarity=0.05, smoothing=0.5, max_missing=2, max_faces=2, cut_threshold=CUT, detection_interval=3,
        full_scan_interval=9, width=W, height=H,
    )
    return tracking.TrackConfig(**{**base, **changes})


def track_inputs(spark, sf_dir):
    return view(spark, sf_dir, "v_hist"), view(spark, sf_dir, "v_sim"), view(spark, sf_dir, "v_motion")


def _flat(tracked):
    item = F.posexplode_outer("instances").alias("place", "i")
    opened = tracked.select("video_id", "frame_index", "scene_id", "detection_due", "full_scan", "redetected", "ambiguous", r6("similarity").alias("similarity"), item)
    return opened.select(
        *(c for c in opened.columns if c != "i"), F.col("i.det_id").alias("det_id"), *(r6(f"i.{c}").alias(c) for c in ("x1", "y1", "x2", "y2"))
    )


def flat_sql(**options) -> str:
    """The tracker's frames, opened by instance; a frame without one has a row with nulls."""
    return f"""
WITH {track_steps(CUT, **options)},
f AS (SELECT *, CAST(sum(CAST(cut AS INT)) OVER (PARTITION BY video_id ORDER BY frame_index) AS BIGINT) AS scene_id FROM step WHERE k > 0)
SELECT video_id, frame_index, scene_id, due AS detection_due, full_scan, redetected, ambiguous, {q6("similarity")} AS similarity, CAST(place AS INT) AS place,
       chosen[place + 1].det AS det_id, {", ".join(f"{q6(f'chosen[place + 1].{c}')} AS {c}" for c in ("x1", "y1", "x2", "y2"))}
FROM (SELECT *, unnest(CASE WHEN len(chosen) = 0 THEN [NULL] ELSE range(len(chosen)) END) AS place FROM f) o
"""


@query("trk1_track", flat_sql())
def trk1(spark, sf_dir):
    return _flat(tracking.track(*track_inputs(spark, sf_dir), track_config()))


@query("trk4_track_frame_profile", flat_sql(profile="frame"))
def trk4(spark, sf_dir):
    return _flat(tracking.track(*track_inputs(spark, sf_dir), track_config(profile="frame")))


@query("trk6_track_quality_gate", f"""
WITH {track_steps(CUT, max_faces=1)},
tracked AS (SELECT video_id, frame_index, cut AS scene_cut, ambiguous, len(chosen) > 0 AS located, CAST(len(chosen) AS INT) AS n_instances FROM step WHERE k > 0)
SELECT video_id, frames, {", ".join(f"{q6(c)} AS {c}" for c in RATIOS)}, max_instances, multi_instance_frames, scene_cuts,
       CASE WHEN coverage < 0.05 THEN 'low_coverage' WHEN ambiguous_ratio > 0.15 THEN 'too_ambiguous' END AS violation FROM ({TRACK_SUMMARY.replace("v_track", "tracked")}) s
""")
def trk6(spark, sf_dir):
    gated = tracking.track_quality_gate(*track_inputs(spark, sf_dir), track_config(max_faces=1))
    return gated.withColumns({c: r6(c) for c in RATIOS})


@query("trk3_select_target", f"""
SELECT video_id, frame_index, det_id, {q6("similarity")} AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY 0.78 * similarity DESC, det_id) AS r FROM v_sim WHERE similarity IS NOT NULL) t WHERE r = 1 AND similarity >= 0.05
""")
def trk3(spark, sf_dir):
    return tracking.select_target(view(spark, sf_dir, "v_sim"), min_similarity=0.05).select("video_id", "frame_index", "det_id", r6("similarity").alias("similarity"))


@query("trk3_follow_target", f"""
WITH {target_steps(CUT)}
SELECT video_id, frame_index, cut AS scene_cut, due AS detection_due, chosen IS NOT NULL AS located, chosen.det AS det_id, {q6("similarity")} AS similarity,
       {", ".join(f"{q6(f'chosen.{c}')} AS {c}" for c in ("x1", "y1", "x2", "y2"))}
FROM step WHERE k > 0
""")
def trk3_follow(spark, sf_dir):
    followed = tracking.follow_target(*track_inputs(spark, sf_dir), track_config(min_similarity=0.15))
    return followed.select(
        "video_id", "frame_index", "scene_cut", "detection_due", "located", "det_id", r6("similarity").alias("similarity"), *(r6(c).alias(c) for c in ("x1", "y1", "x2", "y2"))
    )


PAIR_SCORE = f"""CASE WHEN {iou_sql("t", "c")} <= 0 AND {gap_sql("t", "c")} / greatest({diagonal_sql("t")}, {diagonal_sql("c")}) > 2.4 THEN NULL
  ELSE 0.55 * c.similarity + 0.45 * (0.72 * {iou_sql("t", "c")} + 0.28 * greatest(0.0, 1 - {gap_sql("t", "c")} / greatest({diagonal_sql("t")}, {diagonal_sql("c")}) / 2.4)) END"""
BEST_PAIR = "row_number() OVER (PARTITION BY video_id, frame_index ORDER BY score DESC, track_id DESC, i DESC)"


# At most two boxes run, so the greedy choice is the best pair, and then the best of what shares nothing with it.
@query("trk2_associate", f"""
WITH RECURSIVE survivors AS ({nms_sql("SELECT * FROM v_sim WHERE similarity >= 0.05")}),
c AS (SELECT v.*, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY similarity DESC, coalesce(det_score, 0) DESC, w * h DESC, det_id) - 1 AS i FROM v_sim v JOIN survivors USING (video_id, frame_index, det_id)),
t AS (SELECT video_id, frame_index + 1 AS frame_index, det_id % 5 AS track_id, x1, y1, x2, y2 FROM v_det WHERE det_id % 5 < 2),
p AS (SELECT c.video_id, c.frame_index, t.track_id, c.i, {PAIR_SCORE} AS score FROM t JOIN c USING (video_id, frame_index)),
p1 AS (SELECT * FROM (SELECT *, {BEST_PAIR} AS r FROM p WHERE score IS NOT NULL) x WHERE r = 1),
p2 AS (SELECT * FROM (SELECT p.*, {BEST_PAIR.replace("video_id", "p.video_id").replace("frame_index", "p.frame_index").replace("score", "p.score").replace("track_id", "p.track_id").replace(" i ", " p.i ")} AS r
  FROM p JOIN p1 ON p1.video_id = p.video_id AND p1.frame_index = p.frame_index AND p1.track_id <> p.track_id AND p1.i <> p.i WHERE p.score IS NOT NULL) x WHERE r = 1),
chosen AS (SELECT video_id, frame_index, track_id, i FROM p1 UNION ALL SELECT video_id, frame_index, track_id, i FROM p2),
n AS (SELECT video_id, frame_index, count(*) AS n, max(track_id) + 1 AS following FROM t GROUP BY video_id, frame_index),
opened AS (SELECT c.*, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY i) - 1 AS k FROM c ANTI JOIN chosen USING (video_id, frame_index, i))
SELECT video_id, frame_index, track_id, c.det_id, false AS opened, 0.5 * t.x1 + 0.5 * c.x1 AS x1, 0.5 * t.y1 + 0.5 * c.y1 AS y1, 0.5 * t.x2 + 0.5 * c.x2 AS x2, 0.5 * t.y2 + 0.5 * c.y2 AS y2
FROM chosen JOIN c USING (video_id, frame_index, i) JOIN t USING (video_id, frame_index, track_id)
UNION ALL SELECT o.video_id, o.frame_index, coalesce(following, 0) + k, det_id, true, x1, y1, x2, y2 FROM opened o LEFT JOIN n USING (video_id, frame_index) WHERE coalesce(n.n, 0) + k < 3
""")
def trk2(spark, sf_dir):
    """Each frame's candidates against boxes seen in the frame before."""
    config = track_config()
    candidates = tracking.frame_candidates(view(spark, sf_dir, "v_sim"), config)
    tracks = view(spark, sf_dir, "v_det").select(
        "video_id", (F.col("frame_index") + 1).alias("frame_index"), F.when(F.col("det_id") % 5 < 2, F.struct((F.col("det_id") % 5).alias("track_id"), "x1", "y1", "x2", "y2")).alias("t")
    ).groupBy("video_id", "frame_index").agg(F.array_sort(F.collect_list("t")).alias("tracks"))
    return tracking.associate(tracks, candidates, max_faces=3, smoothing=0.5)

