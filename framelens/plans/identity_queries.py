"""Queries over identity matching, reference banks and per-frame detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.operators import detections as det
from framelens.operators import identity, sequence
from framelens.plans.catalog import q6, query, r6
from framelens.plans.scalar_queries import BEST_FACE, area_sql, gap_sql, iou_sql
from framelens.plans.views import table, FRAME_HEIGHT, FRAME_WIDTH, view

W, H = FRAME_WIDTH, FRAME_HEIGHT

CENTROIDS = """
SELECT identity_id, list(x ORDER BY pos) AS mean FROM (
  SELECT identity_id, pos, sum(weight * x) / sum(weight) AS x FROM (
    SELECT identity_id, weight, unnest(e) AS x, unnest(range(1, 65)) AS pos FROM (
      SELECT identity_id, weight, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS e
      FROM v_bank) a) b
  GROUP BY identity_id, pos) c GROUP BY identity_id"""


def centroids(spark, sf_dir):
    """Identity centroids as a bank: one row per identity."""
    made = identity.identity_centroid(view(spark, sf_dir, "v_bank"), with_best=False)
    return made.select(F.col("identity_id").alias("ref_id"), F.col("centroid").alias("embedding"))


@query("agg6_identity_centroid", f"""
SELECT identity_id, best_ref, n_refs, {q6("mean[1] / norm")} AS first_value, {q6("mean[64] / norm")} AS last_value
FROM (SELECT *, sqrt(list_sum(list_transform(mean, lambda x: x * x))) AS norm FROM ({CENTROIDS}) m) m2
JOIN (SELECT identity_id, arg_max(ref_id, {{'w': weight, 'r': -ref_id}}) AS best_ref, count(*) AS n_refs FROM v_bank GROUP BY identity_id) b USING (identity_id)
""")
def agg6(spark, sf_dir):
    made = identity.identity_centroid(view(spark, sf_dir, "v_bank"))
    return made.select(
        "identity_id", "best_ref", "n_refs", r6(F.col("centroid")[0]).alias("first_value"), r6(F.col("centroid")[63]).alias("last_value")
    )


@query("jn1_match_large_bank", f"""
SELECT det_id, ref_id, {q6("similarity")} AS similarity, rank FROM (
  SELECT d.vec_id AS det_id, r.vec_id AS ref_id, list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS similarity,
         CAST(row_number() OVER (PARTITION BY d.vec_id ORDER BY round(list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 12) DESC, r.vec_id) AS INT) AS rank
  FROM embeddings d CROSS JOIN embeddings r) t WHERE rank <= 3 AND similarity >= 0.2
""")
def jn1_large(spark, sf_dir):
    """All vectors against all as references: a bank that does not fit a row goes to the tasks as a matrix."""
    vectors = table(spark, sf_dir, "embeddings")
    bank = vectors.select(F.col("vec_id").alias("ref_id"), "embedding")
    matched = identity.match_identity(vectors.select(F.col("vec_id").alias("det_id"), "embedding"), bank, min_sim=0.2, k=3, bank_rows=64)
    return matched.select("det_id", "ref_id", r6("similarity").alias("similarity"), "rank")


# The codes miss none of these matches, so the exact statement checks them.
@query("jn1_match_approximate", f"""
SELECT det_id, ref_id, {q6("similarity")} AS similarity, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY det_id ORDER BY round(similarity, 12) DESC, ref_id) AS INT) AS rank FROM (
    SELECT d.vec_id AS det_id, r.vec_id AS ref_id, list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS similarity
    FROM embeddings d CROSS JOIN embeddings r) t WHERE similarity >= 0.9) s WHERE rank <= 3
""")
def jn1_approximate(spark, sf_dir):
    """All vectors against all as references, met by codes of signs; similarities of 0.9 or more, recall planned at 0.999."""
    vectors = table(spark, sf_dir, "embeddings")
    bank = vectors.select(F.col("vec_id").alias("ref_id"), "embedding")
    matched = identity.match_identity(vectors.select(F.col("vec_id").alias("det_id"), "embedding"), bank, min_sim=0.9, k=3, recall=0.999)
    return matched.select("det_id", "ref_id", r6("similarity").alias("similarity"), "rank")


@query("jn1_match_identity", f"""
WITH c AS MATERIALIZED ({CENTROIDS}), s AS (
  SELECT det_id, identity_id AS ref_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), mean) AS similarity FROM v_det, c)
SELECT det_id, ref_id, {q6("similarity")} AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY similarity DESC, ref_id) AS rank FROM s WHERE similarity >= 0.05) t
WHERE rank <= 3
""")
def jn1(spark, sf_dir):
    matched = identity.match_identity(view(spark, sf_dir, "v_det"), centroids(spark, sf_dir), min_sim=0.05, k=3)
    return matched.select("det_id", "ref_id", r6("similarity").alias("similarity"), F.col("rank").cast("long").alias("rank"))


BANK = """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY identity_id ORDER BY lead_order, place, quality DESC, weight DESC, ref_id) AS bank_order FROM (
    SELECT *, CASE WHEN bin IS NOT NULL AND in_bin = 1 THEN 0 ELSE 1 END AS lead_order, CASE WHEN bin IS NOT NULL AND in_bin = 1 THEN bin END AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY identity_id, bin ORDER BY quality DESC, weight DESC, ref_id) AS in_bin FROM (
        SELECT *, CASE WHEN yaw >= -90 AND yaw < -18 THEN 0 WHEN yaw >= -18 AND yaw < 18 THEN 1 WHEN yaw >= 18 AND yaw < 90 THEN 2 END AS bin FROM v_bank) a) b) c) d
WHERE bank_order <= 6"""


@query("win9_diverse_references", f"SELECT identity_id, ref_id, CAST(bank_order AS BIGINT) AS bank_order FROM ({BANK}) b")
def win9(spark, sf_dir):
    return identity.diverse_references(view(spark, sf_dir, "v_bank"), 6).select(
        "identity_id", "ref_id", F.col("bank_order").cast("long").alias("bank_order")
    )


@query("jn14_remaining_references", f"SELECT ref_id FROM v_bank WHERE path NOT IN (SELECT path FROM ({BANK}) b)")
def jn14(spark, sf_dir):
    bank = view(spark, sf_dir, "v_bank")
    return identity.remaining_references(bank, identity.diverse_references(bank, 6)).select("ref_id")


CLIP_POSE = """
SELECT c.video_id, c.clip_index, coalesce(median(t.yaw), 0) AS yaw, coalesce(median(t.pitch), 0) AS pitch
FROM v_clips c LEFT JOIN v_track t ON t.video_id = c.video_id AND t.frame_index >= c.start_frame
  AND t.frame_index < c.start_frame + c.valid_frames AND t.located AND NOT t.ambiguous
GROUP BY c.video_id, c.clip_index"""


def _posed_clips(spark, sf_dir):
    return sequence.pose_for_range(view(spark, sf_dir, "v_track"), view(spark, sf_dir, "v_clips"))


@query("agg8_pose_for_range", f"SELECT video_id, clip_index, {q6('yaw')} AS yaw, {q6('pitch')} AS pitch FROM ({CLIP_POSE}) p")
def agg8(spark, sf_dir):
    return _posed_clips(spark, sf_dir).select("video_id", "clip_index", r6("yaw").alias("yaw"), r6("pitch").alias("pitch"))


@query("jn2_pick_reference", f"""
SELECT video_id, clip_index, arg_min(ref_id, {{'c': ((r.yaw - p.yaw) / 35.0) ** 2 + ((r.pitch - p.pitch) / 25.0) ** 2 - 0.18 * r.quality, 'o': bank_order}}) AS picked_ref
FROM ({CLIP_POSE}) p JOIN ({BANK}) r ON r.identity_id = p.video_id % 10 GROUP BY video_id, clip_index
""")
def jn2(spark, sf_dir):
    clips = _posed_clips(spark, sf_dir).withColumn("identity_id", F.col("video_id") % 10)
    bank = identity.diverse_references(view(spark, sf_dir, "v_bank"), 6)
    return identity.pick_reference(clips, bank).select("video_id", "clip_index", "picked_ref")


@query("top1_primary_detection", f"""
SELECT video_id, frame_index, arg_max(det_id, {{'s': {BEST_FACE}, 'd': -det_id}}) AS best_det, arg_max(det_id, {{'s': {area_sql("d")}, 'd': -det_id}}) AS largest_det
FROM v_box d GROUP BY video_id, frame_index
""")
def top1(spark, sf_dir):
    return det.primary_detection(view(spark, sf_dir, "v_box"), W, H)


@query("top2_composition_order", f"""
SELECT det_id, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY {area_sql("d")}, det_id) - 1 AS layer FROM v_box d
""")
def top2(spark, sf_dir):
    return det.composition_order(view(spark, sf_dir, "v_box")).select("det_id", "layer")


@query("top4_ambiguity", f"""
SELECT video_id, frame_index, {q6("top_similarity")} AS top_similarity, {q6("second_similarity")} AS second_similarity, ambiguous FROM v_ambiguous
""")
def top4(spark, sf_dir):
    return view(spark, sf_dir, "v_ambiguous").select(
        "video_id", "frame_index", r6("top_similarity").alias("top_similarity"), r6("second_similarity").alias("second_similarity"), "ambiguous"
    )


def nms_sql(source: str) -> str:
    return f"""
WITH RECURSIVE ranked AS MATERIALIZED (
  SELECT video_id, frame_index, {{'det_id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} AS b,
         row_number() OVER (PARTITION BY video_id, frame_index ORDER BY similarity DESC, coalesce(det_score, 0) DESC, {area_sql("s")} DESC, det_id) AS k FROM ({source}) s),
folded AS (
  SELECT video_id, frame_index, k, [b] AS kept, true AS added, b.det_id AS det_id FROM ranked WHERE k = 1
  UNION ALL
  SELECT f.video_id, f.frame_index, r.k,
         CASE WHEN len(list_filter(f.kept, lambda o: {iou_sql("o", "r.b")} >= 0.72)) = 0 THEN list_append(f.kept, r.b) ELSE f.kept END,
         len(list_filter(f.kept, lambda o: {iou_sql("o", "r.b")} >= 0.72)) = 0, r.b.det_id
  FROM folded f JOIN ranked r ON r.video_id = f.video_id AND r.frame_index = f.frame_index AND r.k = f.k + 1)
SELECT video_id, frame_index, det_id FROM folded WHERE added"""


@query("set4_nms", nms_sql("SELECT *, det_score AS similarity FROM v_box"))
def set4(spark, sf_dir):
    boxes = view(spark, sf_dir, "v_box").withColumn("similarity", F.col("det_score"))
    return det.nms(boxes).select("video_id", "frame_index", "det_id")


@query("set4_nms_similar", nms_sql("SELECT * FROM v_sim WHERE similarity >= 0.02"))
def set4_similar(spark, sf_dir):
    near = view(spark, sf_dir, "v_sim").filter(F.col("similarity") >= 0.02)
    return det.nms(near).select("video_id", "frame_index", "det_id")


def _active_tracks(spark, sf_dir):
    """Running tracks of a frame: its two detections of smallest id moved by a few pixels; no track in full scans.

    A frame without one of those detections has one track less.
    """
    boxes = view(spark, sf_dir, "v_det")
    firsts = boxes.groupBy("video_id", "frame_index").agg(
        *(
            F.min_by(F.struct((F.col("x1") + 2).alias("x1"), (F.col("y1") + 1).alias("y1"), (F.col("x2") + 2).alias("x2"), (F.col("y2") + 1).alias("y2")),
                     F.when(F.col("det_id") % 5 == i, F.col("det_id"))).alias(f"t{i}")
            for i in (3, 1)
        )
    )
    return firsts.select(
        "video_id", "frame_index", (F.col("frame_index") % 9 == 0).alias("full_scan"), F.array("t3", "t1").alias("tracks")
    )


WIN8_SQL = f"""
WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY {area_sql("d")} * coalesce(det_score, 0) DESC, det_id) AS q FROM v_det d) r WHERE q <= 4),
t AS (SELECT video_id, frame_index, det_id % 5 AS slot, x1 + 2 AS x1, y1 + 1 AS y1, x2 + 2 AS x2, y2 + 1 AS y2 FROM v_det WHERE det_id % 5 IN (1, 3)),
c AS (SELECT f.video_id, f.frame_index, f.det_id, f.q, t.slot, 0.78 * {iou_sql("f", "t")} + 0.22 * (1 - least(1.0, {gap_sql("f", "t")} / sqrt(240.0 ** 2 + 180.0 ** 2))) AS score
      FROM f JOIN t USING (video_id, frame_index)),
a AS (SELECT video_id, frame_index, arg_max(q, {{'s': score, 'q': -q}}) AS q FROM c WHERE slot = 3 GROUP BY video_id, frame_index),
b AS (SELECT c.video_id, c.frame_index, arg_max(c.q, {{'s': c.score, 'q': -c.q}}) AS q FROM c LEFT JOIN a USING (video_id, frame_index)
      WHERE c.slot = 1 AND c.q IS DISTINCT FROM a.q GROUP BY c.video_id, c.frame_index),
p AS (SELECT f.*, frame_index % 9 = 0 OR (a.q IS NULL AND b.q IS NULL) AS plain,
             CASE WHEN frame_index % 9 = 0 THEN f.q WHEN f.q = a.q THEN -2 WHEN f.q = b.q THEN -1 ELSE f.q END AS o
      FROM f LEFT JOIN a USING (video_id, frame_index) LEFT JOIN b USING (video_id, frame_index))
SELECT det_id, pick FROM (SELECT det_id, plain, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY o) AS pick FROM p) z
WHERE pick <= CASE WHEN plain THEN 4 ELSE 3 END
"""


@query("win8_recognition_candidates", WIN8_SQL)
def win8(spark, sf_dir):
    chosen = det.recognition_candidates(
        view(spark, sf_dir, "v_det"), _active_tracks(spark, sf_dir), max_faces=4, max_candidates=3, width=W, height=H
    )
    return chosen.select("det_id", F.col("pick").cast("long").alias("pick"))

