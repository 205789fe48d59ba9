"""Queries over column functions, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import framelens.functions as fl
from framelens.functions import Box
from framelens.functions.boxes import Affine
from framelens.functions.pose import turn_weight
from framelens.operators import filters, grid
from framelens.plans.catalog import q6, query, r6
from framelens.plans.views import FRAME_HEIGHT, FRAME_WIDTH, kps_array, table, view

W, H = FRAME_WIDTH, FRAME_HEIGHT


def _neighbours(spark, sf_dir) -> DataFrame:
    """Each detection beside the next one."""
    det = view(spark, sf_dir, "v_det")
    nxt = det.select((F.col("det_id") - 1).alias("det_id"), *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")))
    return det.join(nxt, "det_id")


NEIGHBOURS = "v_det a JOIN v_det b ON b.det_id = a.det_id + 1"


def area_sql(a: str) -> str:
    return f"(greatest(0.0, {a}.x2 - {a}.x1) * greatest(0.0, {a}.y2 - {a}.y1))"


def iou_sql(a: str, b: str) -> str:
    shared = (
        f"(greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
        f" * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"
    )
    union = f"({area_sql(a)} + {area_sql(b)} - {shared})"
    return f"(CASE WHEN {union} <= 0 THEN 0.0 ELSE {shared} / {union} END)"


def gap_sql(a: str, b: str) -> str:
    return f"sqrt((({a}.x1 + {a}.x2 - {b}.x1 - {b}.x2) / 2) ** 2 + (({a}.y1 + {a}.y2 - {b}.y1 - {b}.y2) / 2) ** 2)"


def diagonal_sql(a: str) -> str:
    return f"greatest(1.0, sqrt(({a}.x2 - {a}.x1) ** 2 + ({a}.y2 - {a}.y1) ** 2))"


@query("scl1_l2_normalize", f"""
SELECT vec_id, {q6("e[1] / n")} AS first_value, {q6("e[64] / n")} AS last_value, {q6("list_sum(list_transform(e, lambda x: x / n))")} AS total
FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + label)) AS e FROM embeddings) s) t
""")
def scl1(spark, sf_dir):
    scaled = F.transform(fl.as_doubles("embedding"), lambda x: x * (1 + F.col("label")))
    unit = table(spark, sf_dir, "embeddings").select("vec_id", fl.l2_normalize(scaled).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda acc, x: acc + x)
    return unit.select(
        "vec_id", r6(F.col("u")[0]).alias("first_value"), r6(F.col("u")[63]).alias("last_value"), r6(total).alias("total")
    )


@query("scl2_cosine", f"""
SELECT a.vec_id, {q6("list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))")} AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def scl2(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", r6(fl.cosine("embedding", "other")).alias("similarity"))


@query("scl3_bbox_area", f"""
SELECT det_id, {q6(area_sql("b"))} AS area FROM v_box b
""")
def scl3(spark, sf_dir):
    return view(spark, sf_dir, "v_box").select("det_id", r6(fl.bbox_area(Box.of())).alias("area"))


@query("scl4_bbox_iou", f"""
SELECT a.det_id, {q6(iou_sql("a", "b"))} AS iou FROM {NEIGHBOURS}
""")
def scl4(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("det_id", r6(fl.bbox_iou(Box.of(), Box.of("b_"))).alias("iou"))


@query("scl5_center_distance", f"""
SELECT a.det_id, {q6(gap_sql("a", "b"))} AS distance, {q6(diagonal_sql("a"))} AS diagonal FROM {NEIGHBOURS}
""")
def scl5(spark, sf_dir):
    a, b = Box.of(), Box.of("b_")
    return _neighbours(spark, sf_dir).select(
        "det_id", r6(fl.center_distance(a, b)).alias("distance"), r6(fl.bbox_diagonal(a)).alias("diagonal")
    )


@query("scl6_association_score", f"""
SELECT det_id, {q6("CASE WHEN iou <= 0 AND reach > 2.4 THEN NULL ELSE 0.55 * det_score + 0.45 * (0.72 * iou + 0.28 * greatest(0.0, 1 - reach / 2.4)) END")} AS score
FROM (SELECT a.det_id, a.det_score, {iou_sql("a", "b")} AS iou,
             {gap_sql("a", "b")} / greatest({diagonal_sql("a")}, {diagonal_sql("b")}) AS reach FROM {NEIGHBOURS}) t
""")
def scl6(spark, sf_dir):
    score = fl.association_score(Box.of("b_"), Box.of(), F.col("det_score"))
    return _neighbours(spark, sf_dir).select("det_id", r6(score).alias("score"))


@query("scl7_selection_score", f"""
SELECT a.det_id, {q6(f"0.78 * a.det_score + 0.22 * {iou_sql('a', 'b')}")} AS score, {q6("0.78 * a.det_score")} AS first_score FROM {NEIGHBOURS}
""")
def scl7(spark, sf_dir):
    score = F.col("det_score")
    return _neighbours(spark, sf_dir).select(
        "det_id", r6(fl.selection_score(score, Box.of(), Box.of("b_"))).alias("score"),
        r6(fl.selection_score(score, Box.of())).alias("first_score"),
    )


@query("scl8_continuity_score", f"""
SELECT a.det_id, {q6(f"0.78 * {iou_sql('a', 'b')} + 0.22 * (1 - least(1.0, {gap_sql('a', 'b')} / sqrt(240.0 ** 2 + 180.0 ** 2)))")} AS score FROM {NEIGHBOURS}
""")
def scl8(spark, sf_dir):
    return _neighbours(spark, sf_dir).select(
        "det_id", r6(fl.continuity_score(Box.of(), Box.of("b_"), W, H)).alias("score")
    )


@query("scl9_quality_rank", f"""
SELECT det_id, {q6(f"{area_sql('b')} * coalesce(det_score, 0)")} AS quality FROM v_box b
""")
def scl9(spark, sf_dir):
    return view(spark, sf_dir, "v_box").select("det_id", r6(fl.quality_rank(Box.of(), F.col("det_score"))).alias("quality"))


BEST_FACE = (
    f"{area_sql('d')} * coalesce(d.det_score, 0) * (1 - least(0.8, sqrt((((d.x1 + d.x2) / 2 - 120.0) / 240.0) ** 2"
    " + (((d.y1 + d.y2) / 2 - 90.0) / 180.0) ** 2)))"
)


@query("scl10_best_face_score", f"SELECT det_id, {q6(f'sqrt({BEST_FACE})')} AS score_root FROM v_box d")
def scl10(spark, sf_dir):
    score = fl.best_face_score(Box.of(), F.col("det_score"), W, H)
    return view(spark, sf_dir, "v_box").select("det_id", r6(F.sqrt(score)).alias("score_root"))


@query("scl11_pose_from_kps", f"SELECT det_id, {q6('yaw')} AS yaw, {q6('pitch')} AS pitch FROM v_posed")
def scl11(spark, sf_dir):
    yaw, pitch = fl.pose_from_kps(kps_array())
    return view(spark, sf_dir, "v_det").select("det_id", r6(yaw).alias("yaw"), r6(pitch).alias("pitch"))


@query("scl12_pose_weight", f"""
SELECT det_id, {q6("greatest(0.20, exp(-(abs(pitch) + abs(yaw)) / 70.0))")} AS weight,
       {q6("greatest(0.20, exp(-(det_id % 90 + det_id % 70) / 70.0))")} AS given_weight FROM v_posed
""")
def scl12(spark, sf_dir):
    pose = F.array((F.col("det_id") % 90).cast("double"), (F.col("det_id") % 70).cast("double"))
    return view(spark, sf_dir, "v_det").select(
        "det_id", r6(fl.pose_weight(kps_array())).alias("weight"), r6(fl.pose_weight(kps_array(), pose)).alias("given_weight")
    )


@query("scl13_reference_weight", f"SELECT ref_id, {q6('weight')} AS weight FROM v_bank")
def scl13(spark, sf_dir):
    weight = fl.reference_weight(
        F.col("det_score"), F.col("area_ratio"), turn_weight(F.col("yaw"), F.col("pitch")), F.col("quality")
    )
    return view(spark, sf_dir, "v_refs").select("ref_id", r6(weight).alias("weight"))


LAPLACE = """
SELECT frame_id, avg(v) AS mean, var_pop(lap) AS sharpness_var, avg(CASE WHEN v <= 5 OR v >= 250 THEN 1.0 ELSE 0.0 END) AS clipped
FROM (SELECT frame_id, CAST(v AS DOUBLE) AS v,
             coalesce(lag(v) OVER r, lead(v) OVER r) + coalesce(lead(v) OVER r, lag(v) OVER r)
             + coalesce(lag(v) OVER c, lead(v) OVER c) + coalesce(lead(v) OVER c, lag(v) OVER c) - 4 * v AS lap
      FROM v_cells WINDOW r AS (PARTITION BY frame_id, cy ORDER BY cx), c AS (PARTITION BY frame_id, cx ORDER BY cy)) t
GROUP BY frame_id"""


@query("scl14_image_quality", f"""
SELECT frame_id, {q6("least(1.0, greatest(0.0, 0.55 * least(1.0, greatest(0.0, ln(1 + sharpness_var) / ln(1001.0))) + 0.30 * exp(-(((mean - 128.0) / 95.0) ** 2)) + 0.15 * (1 - least(1.0, 4 * clipped))))")} AS quality
FROM ({LAPLACE}) s
""")
def scl14(spark, sf_dir):
    stats = grid.pixel_stats(view(spark, sf_dir, "v_cells"))
    quality = fl.image_quality(F.col("sharpness_var"), F.col("mean"), F.col("clipped_fraction"))
    return stats.select("frame_id", r6(quality).alias("quality"))


@query("scl15_euler_from_matrix", f"""
SELECT vec_id, {q6("degrees(CASE WHEN sy < 1e-6 THEN atan2(-m[6], m[5]) ELSE atan2(m[8], m[9]) END)")} AS pitch,
       {q6("degrees(atan2(-m[7], sy))")} AS yaw, {q6("degrees(CASE WHEN sy < 1e-6 THEN 0.0 ELSE atan2(m[4], m[1]) END)")} AS roll
FROM (SELECT vec_id, m, sqrt(m[1] * m[1] + m[4] * m[4]) AS sy FROM (
  SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN [0.0, m[2], m[3], 0.0, m[5], m[6], 1.0, 0.0, 0.0] ELSE m END AS m
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS m FROM embeddings) a) b) c
""")
def scl15(spark, sf_dir):
    e = F.col("e")
    general = F.array(*(F.array(*(e[3 * i + j] for j in range(3))) for i in range(3)))
    zero, one = F.lit(0.0), F.lit(1.0)
    locked = F.array(F.array(zero, e[1], e[2]), F.array(zero, e[4], e[5]), F.array(one, zero, zero))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", fl.as_doubles("embedding").alias("e"))
    angles = rows.select(
        "vec_id", fl.euler_from_matrix(F.when(F.col("vec_id") % 10 == 0, locked).otherwise(general)).alias("a")
    )
    return angles.select("vec_id", *(r6(f"a.{c}").alias(c) for c in ("pitch", "yaw", "roll")))


def _axis_sql(angle: str, start: float, limit: float) -> str:
    return f"(CASE WHEN abs({angle}) <= {start} THEN 1.0 WHEN abs({angle}) >= {limit} THEN 0.0 ELSE 1.0 - (abs({angle}) - {start}) / {limit - start} END)"


@query("scl16_pose_opacity", f"""
SELECT det_id, {q6(_axis_sql("yaw", 50.0, 78.0))} AS yaw_confidence, {q6("CASE WHEN c <= 0 THEN 0.0 ELSE greatest(0.28, c) END")} AS opacity
FROM (SELECT det_id, yaw, (CASE WHEN det_id % 13 = 0 THEN 0.0 ELSE det_score END) * {_axis_sql("pitch", 28.0, 58.0)} * {_axis_sql("yaw", 50.0, 78.0)} AS c
      FROM (SELECT det_id, det_score, pitch * 2.0 AS pitch, yaw * 1.5 AS yaw FROM v_posed) p) t
""")
def scl16(spark, sf_dir):
    yaw, pitch = fl.pose_from_kps(kps_array())
    confidence = F.when(F.col("det_id") % 13 == 0, F.lit(0.0)).otherwise(F.col("det_score"))
    return view(spark, sf_dir, "v_det").select(
        "det_id", r6(fl.axis_confidence(yaw * 1.5, 50.0, 78.0)).alias("yaw_confidence"),
        r6(fl.pose_opacity(confidence, pitch * 2.0, yaw * 1.5)).alias("opacity"),
    )


@query("scl17_landmark_confidence", f"""
SELECT vec_id, {q6("CASE WHEN len(p) = 0 THEN 1.0 ELSE least(1.0, list_avg(p) * 8) END")} AS confidence
FROM (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN [] ELSE list_filter(CAST(embedding AS DOUBLE[]), lambda x: x > 0) END AS p FROM embeddings) t
""")
def scl17(spark, sf_dir):
    values = F.transform(fl.as_doubles("embedding"), lambda x: x * 8)
    values = F.when(F.col("vec_id") % 11 == 0, F.array().cast("array<double>")).otherwise(values)
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(fl.landmark_confidence(values)).alias("confidence"))


def moved_box_sql(box: str = "", motion: str = "") -> tuple[str, str, str, str]:
    """The sides of the box around the four moved corners."""
    b, m = f"{box}." if box else "", f"{motion}." if motion else ""

    def side(pick: str, row: int) -> str:
        return f"{pick}({b}x1 * {m}m{row}0, {b}x2 * {m}m{row}0) + {pick}({b}y1 * {m}m{row}1, {b}y2 * {m}m{row}1) + {m}m{row}2"

    return side("least", 0), side("least", 1), side("greatest", 0), side("greatest", 1)


@query("scl18_affine_bbox", f"""
SELECT det_id, {", ".join(f"{q6(side)} AS {name}" for name, side in zip(("x1", "y1", "x2", "y2"), moved_box_sql()))},
       {q6("kx2 * m00 + ky2 * m01 + m02")} AS nose_x, {q6("kx2 * m10 + ky2 * m11 + m12")} AS nose_y
FROM v_det JOIN v_motion USING (video_id, frame_index)
""")
def scl18(spark, sf_dir):
    m = Affine.of()
    joined = view(spark, sf_dir, "v_det").join(view(spark, sf_dir, "v_motion"), ["video_id", "frame_index"])
    moved, points = fl.affine_bbox(Box.of(), m), fl.affine_points(kps_array(), m)
    return joined.select(
        "det_id", *(r6(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), moved)),
        r6(points[2]["x"]).alias("nose_x"), r6(points[2]["y"]).alias("nose_y"),
    )


def _pad_sql(prefix: str, mx: str, my: str) -> str:
    edges = {
        "x1": f"greatest(0, floor(x1 - {mx}))", "y1": f"greatest(0, floor(y1 - {my}))",
        "x2": f"least(240, ceil(x2 + {mx}))", "y2": f"least(180, ceil(y2 + {my}))",
    }
    filled = f"{edges['x2']} > {edges['x1']} AND {edges['y2']} > {edges['y1']}"
    return ", ".join(f"CASE WHEN {filled} THEN CAST({e} AS BIGINT) END AS {prefix}_{n}" for n, e in edges.items())


@query("scl19_pad_bbox", f"""
SELECT det_id, {_pad_sql("sq", "greatest(x2 - x1, y2 - y1, 1.0) * 0.25", "greatest(x2 - x1, y2 - y1, 1.0) * 0.25")},
       {_pad_sql("ax", "greatest(x2 - x1, 1.0) * 0.08", "greatest(y2 - y1, 1.0) * 0.08")} FROM v_box
""")
def scl19(spark, sf_dir):
    square, axis = fl.pad_bbox(Box.of(), 0.25, W, H), fl.pad_bbox(Box.of(), 0.08, W, H, mode="per_axis")
    names = ("x1", "y1", "x2", "y2")
    return view(spark, sf_dir, "v_box").select(
        "det_id", *(v.alias(f"sq_{n}") for n, v in zip(names, square)), *(v.alias(f"ax_{n}") for n, v in zip(names, axis))
    )


@query("scl20_scale_instances", f"""
SELECT det_id, {q6("x1 * 2.5")} AS x1, {q6("y2 * 0.5")} AS y2, {q6("kx2 * 2.5")} AS nose_x, {q6("ky2 * 0.5")} AS nose_y FROM v_det
""")
def scl20(spark, sf_dir):
    item = F.struct("x1", "y1", "x2", "y2", kps_array().alias("kps"), "det_score")
    scaled = view(spark, sf_dir, "v_det").select("det_id", fl.scale_instances(F.array(item), 2.5, 0.5)[0].alias("i"))
    return scaled.select(
        "det_id", r6("i.x1").alias("x1"), r6("i.y2").alias("y2"), r6(F.col("i.kps")[2]["x"]).alias("nose_x"),
        r6(F.col("i.kps")[2]["y"]).alias("nose_y"),
    )


@query("scl21_crossfade_weight", f"""
SELECT video_id, clip_index, k AS "offset", {q6("0.5 - 0.5 * cos(pi() * (k + 1) / (overlap_before + 1))")} AS weight
FROM (SELECT video_id, clip_index, overlap_before, unnest(range(overlap_before)) AS k FROM v_clips) c
""")
def scl21(spark, sf_dir):
    clips = view(spark, sf_dir, "v_clips").filter(F.col("overlap_before") > 0)
    opened = clips.select(
        "video_id", "clip_index", "overlap_before",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("overlap_before") - 1)).alias("offset"),
    )
    return opened.select(
        "video_id", "clip_index", "offset", r6(fl.crossfade_weight(F.col("offset"), F.col("overlap_before"))).alias("weight")
    )


@query("scl22_window_seed", """
SELECT video_id, clip_index, (2147483600 + start_frame) % 2147483647 AS seed, CAST(7 AS BIGINT) AS fixed_seed FROM v_clips
""")
def scl22(spark, sf_dir):
    start = F.col("start_frame")
    return view(spark, sf_dir, "v_clips").select(
        "video_id", "clip_index", fl.window_seed(start, 2147483600).alias("seed"), fl.window_seed(start, 7, "fixed").alias("fixed_seed")
    )


HIST_PAIRS = """
SELECT video_id, frame_index, hist, lag(hist) OVER (PARTITION BY video_id ORDER BY frame_index) AS before FROM v_hist"""
DISTANCE = (
    "sqrt(greatest(0.0, 1 - list_sum(list_transform(list_zip(before, hist), lambda p: sqrt(p[1] * p[2])))"
    " / (sqrt(list_sum(before)) * sqrt(list_sum(hist)))))"
)


@query("scl23_bhattacharyya", f"""
SELECT a.video_id, a.frame_index, {q6(DISTANCE)} AS distance FROM (
  SELECT a.video_id, a.frame_index, a.hist, b.hist AS before FROM v_hist a JOIN v_hist b
  ON b.video_id = a.video_id AND b.frame_index = a.frame_index - 1) a
""")
def scl23(spark, sf_dir):
    hist = view(spark, sf_dir, "v_hist")
    before = hist.select("video_id", (F.col("frame_index") + 1).alias("frame_index"), F.col("hist").alias("before"))
    return hist.join(before, ["video_id", "frame_index"]).select(
        "video_id", "frame_index", r6(fl.bhattacharyya("before", "hist")).alias("distance")
    )


def ellipse_sql(ax: float, ay: float, drop: float, turned: bool) -> str:
    dx, dy = "(px - round_even((x1 + x2) / 2, 0))", f"(py - round_even(y1 + {drop} * greatest(2.0, h), 0))"
    if turned:
        angle = "atan2(ky1 - ky0, kx1 - kx0)"
        dx, dy = f"({dx} * cos({angle}) + {dy} * sin({angle}))", f"({dy} * cos({angle}) - {dx} * sin({angle}))"
    rx = f"greatest(2.0, round_even({ax} * greatest(2.0, w) * 1.08, 0))"
    ry = f"greatest(2.0, round_even({ay} * greatest(2.0, h) * 1.08, 0))"
    return f"(({dx} / {rx}) ** 2 + ({dy} / {ry}) ** 2 <= 1.0)"


@query("scl24_ellipse_contains", f"""
SELECT point_id, det_id, {ellipse_sql(0.50, 0.56, 0.53, False)} AS plain, {ellipse_sql(0.51, 0.58, 0.52, True)} AS oriented
FROM v_points JOIN (
  SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY w * h DESC, det_id) AS r FROM v_det) d
USING (video_id, frame_index) WHERE r = 1
""")
def scl24(spark, sf_dir):
    det = view(spark, sf_dir, "v_det")
    rest = [c for c in det.columns if c not in ("video_id", "frame_index", "embedding")]
    largest = det.groupBy("video_id", "frame_index").agg(
        F.max_by(F.struct(*rest), F.struct(fl.bbox_area(Box.of()), -F.col("det_id"))).alias("_largest")
    ).select("video_id", "frame_index", "_largest.*")
    inside = lambda variant: fl.ellipse_contains(
        F.col("px"), F.col("py"), Box.of(), variant=variant, left_eye=(F.col("kx0"), F.col("ky0")),
        right_eye=(F.col("kx1"), F.col("ky1")),
    )
    return view(spark, sf_dir, "v_points").join(largest, ["video_id", "frame_index"]).select(
        "point_id", "det_id", inside("plain").alias("plain"), inside("oriented").alias("oriented")
    )


def _kps_error_sql() -> str:
    parts = " + ".join(
        f"sqrt((a.kx{i} - b.kx{i}) ** 2 + (a.ky{i} - b.ky{i}) ** 2)" for i in range(5)
    )
    return f"({parts}) / 5 / greatest(1.0, sqrt((b.kx1 - b.kx0) ** 2 + (b.ky1 - b.ky0) ** 2))"


@query("scl25_landmark_error", f"SELECT a.det_id, {q6(_kps_error_sql())} AS error FROM {NEIGHBOURS}")
def scl25(spark, sf_dir):
    det = view(spark, sf_dir, "v_det").select("det_id", kps_array().alias("kps"))
    nxt = det.select((F.col("det_id") - 1).alias("det_id"), F.col("kps").alias("expected"))
    return det.join(nxt, "det_id").select("det_id", r6(fl.landmark_error(F.col("kps"), F.col("expected"))).alias("error"))


MODES_SQL = "CASE doc_id % 5 WHEN 0 THEN '3dmm_internal' WHEN 1 THEN 'flame_internal' WHEN 2 THEN 'gaussian_3d_internal' WHEN 3 THEN 'none' ELSE lang END"


@query("scl26_truly_conditioned", f"""
SELECT doc_id, mode IN ('3dmm_internal', 'flame_internal', 'gaussian_3d_internal') AS conditioned
FROM (SELECT doc_id, {MODES_SQL} AS mode FROM documents) t
""")
def scl26(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(MODES_SQL).alias("mode"))
    return docs.select("doc_id", fl.truly_conditioned(F.col("mode")).alias("conditioned"))


@query("scl27_masked_mae", f"""
SELECT vec_id, {q6("list_avg(list_transform(list_filter(list_zip(original, output, alpha), lambda c: c[3] < 0.01), lambda c: abs(c[1] - c[2])))")} AS outside_mae
FROM v_pairs
""")
def scl27(spark, sf_dir):
    return view(spark, sf_dir, "v_pairs").select("vec_id", r6(fl.masked_mae("original", "output", "alpha")).alias("outside_mae"))


@query("flt1_min_score", "SELECT det_id FROM v_box WHERE coalesce(det_score, 0) >= 0.55")
def flt1(spark, sf_dir):
    return filters.min_score(view(spark, sf_dir, "v_box"), 0.55).select("det_id")


@query("flt2_min_similarity", f"SELECT det_id, {q6('similarity')} AS similarity FROM v_sim WHERE similarity >= 0.10")
def flt2(spark, sf_dir):
    det = view(spark, sf_dir, "v_det").join(view(spark, sf_dir, "v_target"), "video_id")
    return filters.min_similarity(det, F.col("target"), 0.10).select("det_id", r6("similarity").alias("similarity"))


@query("flt3_detection_due", """
SELECT video_id, frame_index, cut OR frame_index % 3 = 0 AS due, cut OR frame_index % 9 = 0 AS full_scan
FROM (SELECT video_id, frame_index, frame_seq % 7 = 3 AS cut FROM v_frames) f
""")
def flt3(spark, sf_dir):
    cut = F.col("frame_seq") % 7 == 3
    return view(spark, sf_dir, "v_frames").select(
        "video_id", "frame_index", fl.detection_due(F.col("frame_index"), cut, 3).alias("due"),
        fl.full_scan_due(F.col("frame_index"), cut, 9).alias("full_scan"),
    )


@query("flt4_sample_every", "SELECT video_id, frame_index FROM v_frames WHERE frame_index % 8 = 0")
def flt4(spark, sf_dir):
    return filters.sample_every(view(spark, sf_dir, "v_frames"), 8).select("video_id", "frame_index")


@query("flt5_bbox_visible", """
SELECT det_id, x2 - 60 > 0 AND y2 - 60 > 0 AND x1 - 60 < 80 AND y1 - 60 < 20 AS visible FROM v_box
""")
def flt5(spark, sf_dir):
    b = Box.of()
    shifted = Box(b.x1 - 60, b.y1 - 60, b.x2 - 60, b.y2 - 60)
    return view(spark, sf_dir, "v_box").select("det_id", fl.bbox_visible(shifted, 80.0, 20.0).alias("visible"))


def _length_sql(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN abs({a}) ELSE sqrt({a} ** 2 + {b} ** 2) END"


VALID_MOTION = (
    f"({_length_sql('m00', 'm10')}) BETWEEN 0.70 AND 1.40 AND ({_length_sql('m11', 'm01')}) BETWEEN 0.70 AND 1.40 AND sqrt(m02 ** 2 + m12 ** 2) <= 0.35 * 240"
)


@query("flt6_valid_affine", f"SELECT video_id, frame_index, {VALID_MOTION} AS valid FROM v_motion")
def flt6(spark, sf_dir):
    return view(spark, sf_dir, "v_motion").select(
        "video_id", "frame_index", fl.valid_affine(Affine.of(), W, H).alias("valid")
    )


HDR = "coalesce(color_transfer IN ('smpte2084', 'arib-std-b67'), false)"


@query("flt7_hdr_policy", f"""
SELECT video_id, {HDR} AS hdr, CASE WHEN {HDR} THEN 'bt709' ELSE color_transfer END AS tonemap_transfer,
       CASE WHEN {HDR} THEN 'tv' ELSE 'pc' END AS tonemap_range, CASE WHEN {HDR} THEN 'hdr_rejected' END AS violation
FROM v_videos
""")
def flt7(spark, sf_dir):
    videos = view(spark, sf_dir, "v_videos")
    mapped = filters.hdr_policy(videos, "tonemap", {"range": "pc"}).select(
        "video_id", "color_transfer", "hdr", F.col("out_transfer").alias("tonemap_transfer"), F.col("out_range").alias("tonemap_range")
    )
    return filters.hdr_policy(mapped.drop("hdr"), "reject").select(
        "video_id", "hdr", "tonemap_transfer", "tonemap_range", "violation"
    )


@query("flt9_parse_size", """
SELECT doc_id, CAST(100 + doc_id % 900 AS INT) AS width, CASE WHEN doc_id % 6 <> 0 THEN CAST(n_chars % 700 AS INT) END AS height FROM documents
""")
def flt9(spark, sf_dir):
    text = F.concat(
        (100 + F.col("doc_id") % 900).cast("string"), F.lit("*"),
        F.when(F.col("doc_id") % 6 == 0, F.lit("tall")).otherwise((F.col("n_chars") % 700).cast("string")),
    )
    size = table(spark, sf_dir, "documents").select("doc_id", fl.parse_size(text).alias("s"))
    return size.select("doc_id", "s.width", "s.height")


# Aliases and allowed names of attention back ends.
TOKEN_ALIASES = {
    "flash_attention": "flash", "cudnn_attention": "cudnn", "memory_efficient": "efficient", "efficient_attention": "efficient",
}
TOKENS = ("cudnn", "flash", "efficient", "math")
TOKEN_LIST = "CASE doc_id % 4 WHEN 0 THEN ' Flash_Attention , math' WHEN 1 THEN 'math,MATH, cudnn_attention' WHEN 2 THEN concat('flash,', lang) ELSE 'memory_efficient,efficient' END"


@query("flt10_normalize_tokens", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'flash|math' WHEN 1 THEN 'math|cudnn' WHEN 2 THEN NULL ELSE 'efficient' END AS tokens, doc_id % 4 <> 2 AS valid FROM documents
""")
def flt10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", fl.normalize_tokens(F.expr(TOKEN_LIST), TOKEN_ALIASES, TOKENS).alias("t")
    )
    return docs.select("doc_id", F.array_join("t.tokens", "|").alias("tokens"), F.col("t.valid").alias("valid"))


PROFILE = """doc_id, 5 + doc_id % 48 AS frame_num, doc_id % 40 AS overlap, doc_id % 25 AS sample_fps, doc_id % 30 / CAST(20 AS DOUBLE) AS min_coverage,
 CASE WHEN doc_id % 8 = 0 THEN 'linear' WHEN doc_id % 8 = 1 THEN ' CUBIC ' ELSE 'lanczos' END AS interpolation,
 CASE doc_id % 3 WHEN 0 THEN 'tonemap' WHEN 1 THEN 'reject' ELSE lang END AS hdr_policy, doc_id % 12 AS max_target_faces, doc_id % 11 + 1 AS max_faces,
 CASE doc_id % 4 WHEN 0 THEN ' 832*480' WHEN 1 THEN '480*832' ELSE '1280*720' END AS size, CASE doc_id % 5 WHEN 0 THEN 'Float16 ' WHEN 1 THEN 'int8' ELSE 'auto' END AS vae_dtype"""


@query("flt11_check_rules", f"""
WITH p AS (SELECT {PROFILE} FROM documents)
SELECT doc_id, 'frame_num' AS rule FROM p WHERE NOT (frame_num >= 5 AND frame_num % 4 = 1)
UNION ALL SELECT doc_id, 'sample_fps' FROM p WHERE NOT sample_fps > 0
UNION ALL SELECT doc_id, 'overlap' FROM p WHERE NOT (overlap >= 0 AND overlap < frame_num)
UNION ALL SELECT doc_id, 'min_coverage' FROM p WHERE NOT min_coverage BETWEEN 0 AND 1
UNION ALL SELECT doc_id, 'interpolation' FROM p WHERE lower(trim(interpolation)) NOT IN ('linear', 'cubic', 'lanczos')
UNION ALL SELECT doc_id, 'hdr_policy' FROM p WHERE hdr_policy NOT IN ('tonemap', 'reject', 'passthrough')
UNION ALL SELECT doc_id, 'max_target_faces' FROM p WHERE max_target_faces > max_faces
UNION ALL SELECT doc_id, 'size' FROM p WHERE trim(size) NOT IN ('832*480', '1280*720')
UNION ALL SELECT doc_id, 'vae_dtype' FROM p WHERE lower(trim(vae_dtype)) NOT IN ('auto', 'bfloat16', 'float16', 'float32')
""")
def flt11(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    profiles = spark.sql(f"SELECT {PROFILE} FROM documents")
    return filters.check_rules(profiles, ["doc_id"], filters.profile_rules(profiles.columns))


@query("flt12_skip_zero_opacity", """
SELECT video_id, count(CASE WHEN o > 0 THEN 1 END) AS kept, count(CASE WHEN o <= 0 THEN 1 END) AS skipped
FROM (SELECT video_id, det_score - 0.55 AS o FROM v_box) t GROUP BY video_id
""")
def flt12(spark, sf_dir):
    faces = view(spark, sf_dir, "v_box").withColumn("opacity", F.col("det_score") - 0.55)
    return filters.opacity_counts(faces, ["video_id"])
