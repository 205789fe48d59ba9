"""Fixture views: the shapes the operators expect, derived from the given tables.

The SQL text is shared with the check queries. Every view reads its whole table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.functions import as_doubles
from framelens.operators import ordered
from framelens.operators.windows import WindowPlan, plan_windows

FRAME_WIDTH, FRAME_HEIGHT = 240.0, 180.0

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

VIEW_SQL = {
    "v_frames": """
SELECT DISTINCT CAST(floor(vec_id / 100) AS BIGINT) AS video_id, CAST(floor(vec_id / 5) AS BIGINT) % 20 AS frame_index,
       CAST(floor(vec_id / 5) AS BIGINT) AS frame_seq
FROM embeddings""",
    "v_det": """
SELECT *, x1 + 0.32 * w AS kx0, y1 + 0.38 * h AS ky0, x1 + 0.68 * w AS kx1, y1 + 0.38 * h AS ky1,
       x1 + (0.42 + 0.01 * (det_id % 17)) * w AS kx2, y1 + (0.50 + 0.01 * (det_id % 9)) * h AS ky2,
       x1 + 0.38 * w AS kx3, y1 + 0.72 * h AS ky3, x1 + 0.62 * w AS kx4, y1 + 0.72 * h AS ky4,
       x1 + w AS x2, y1 + h AS y2
FROM (
  SELECT CAST(floor(vec_id / 100) AS BIGINT) AS video_id, CAST(floor(vec_id / 5) AS BIGINT) % 20 AS frame_index,
         vec_id AS det_id,
         CAST((CAST(floor(vec_id / 2) AS BIGINT) * 37) % 160 + (vec_id % 2) * 3 AS DOUBLE) AS x1,
         CAST((CAST(floor(vec_id / 2) AS BIGINT) * 53) % 90 AS DOUBLE) AS y1,
         CAST(24 + (CAST(floor(vec_id / 2) AS BIGINT) * 7) % 40 AS DOUBLE) AS w,
         CAST(30 + (CAST(floor(vec_id / 2) AS BIGINT) * 11) % 48 AS DOUBLE) AS h,
         CAST(50 + (vec_id * 13) % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS det_score,
         CASE WHEN CAST(floor(vec_id / 5) AS BIGINT) % 7 <> 6 THEN embedding END AS embedding
  FROM embeddings) d""",
    "v_box": """
SELECT l_suppkey AS video_id, l_orderkey % 1000 AS frame_index, l_orderkey * 16 + l_linenumber AS det_id,
       CAST(l_partkey % 160 AS DOUBLE) AS x1, CAST(l_orderkey % 90 AS DOUBLE) AS y1,
       CAST(l_partkey % 160 AS DOUBLE) + 20 + l_quantity AS x2,
       CAST(l_orderkey % 90 AS DOUBLE) + 30 + l_quantity AS y2, 0.5 + l_discount AS det_score
FROM lineitem""",
    "v_refs": """
SELECT vec_id AS ref_id, vec_id % 10 AS identity_id, concat('bank/', CAST(vec_id AS STRING), '.png') AS path,
       embedding, CAST((vec_id * 29) % 120 - 60 AS DOUBLE) AS yaw, CAST((vec_id * 17) % 80 - 40 AS DOUBLE) AS pitch,
       CAST((vec_id * 19) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS quality,
       CAST(50 + (vec_id * 13) % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS det_score,
       CAST(5 + (vec_id * 7) % 90 AS DOUBLE) / CAST(100 AS DOUBLE) AS area_ratio
FROM embeddings""",
    "v_motion": """
SELECT CAST(floor(vec_id / 100) AS BIGINT) AS video_id, CAST(floor(vec_id / 5) AS BIGINT) % 20 AS frame_index,
       CAST(10 + (vec_id * 3) % 11 - 5 AS DOUBLE) / CAST(10 AS DOUBLE) AS m00, CAST((vec_id * 3) % 7 - 3 AS DOUBLE) / CAST(20 AS DOUBLE) AS m01,
       CAST((vec_id * 13) % 200 - 100 AS DOUBLE) AS m02, CAST((vec_id * 2) % 9 - 4 AS DOUBLE) / CAST(20 AS DOUBLE) AS m10,
       CAST(10 + (vec_id * 7) % 9 - 4 AS DOUBLE) / CAST(10 AS DOUBLE) AS m11,
       CAST((vec_id * 11) % 120 - 60 AS DOUBLE) AS m12
FROM (SELECT min(vec_id) AS vec_id FROM embeddings GROUP BY CAST(floor(vec_id / 5) AS BIGINT)) f""",
    "v_videos": """
SELECT doc_id AS video_id, 1 + n_chars % 600 AS requested_frames, CAST(16 AS DOUBLE) AS fps,
       CAST(CASE WHEN doc_id % 40 = 0 THEN 0 ELSE 832 END AS INT) AS width, CAST(480 AS INT) AS height,
       CASE WHEN doc_id % 9 = 0 THEN 'smpte2084' WHEN doc_id % 9 = 1 THEN 'arib-std-b67'
            WHEN doc_id % 9 = 2 THEN NULL ELSE 'bt709' END AS color_transfer
FROM documents""",
    "v_spans": """
SELECT CAST(floor(event_id / 1000) AS BIGINT) AS run_id, event_id AS span_id,
       CASE WHEN event_id % 1000 = 0 THEN NULL
            ELSE CAST(floor(event_id / 1000) AS BIGINT) * 1000 + CAST(floor((event_id % 1000 - 1) / 4) AS BIGINT) END AS parent_span_id,
       event_type AS name, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, ts,
       CAST(round(value * 100) AS BIGINT) * 10000 AS duration_ns,
       CAST(round(value * 100) AS BIGINT) * 4000 AS thread_cpu_ns, user_id AS worker_request_id
FROM events""",
    "v_worker_lines": """
SELECT event_id, concat(CASE event_id % 4 WHEN 0 THEN 'RESULT ' WHEN 1 THEN 'PROFILE ' WHEN 2 THEN 'LOG ' ELSE '' END,
       CASE WHEN event_id % 17 = 0 THEN '{broken' ELSE concat('{"event":"', event_type, '","level":"',
       CASE WHEN event_id % 5 = 0 THEN 'error' ELSE 'odd' END, '","process_id":', CAST(user_id AS STRING), '}') END) AS line
FROM events""",
    "v_frame_events": """
SELECT user_id AS run_id, event_id AS frame_index, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS full_scan,
       CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS written, CAST(event_id % 4 AS INT) AS detected,
       CAST(event_id % 3 AS INT) AS recognized, value AS seconds
FROM events""",
    "v_mem": """
SELECT event_id, CAST(round(value * 100) AS BIGINT) * 262144 AS allocated_bytes,
       CAST(round(value * 100) AS BIGINT) * 262144 + (event_id % 9) * 134217728 AS reserved_bytes,
       CAST(17179869184 AS BIGINT) AS total_bytes, event_id % 2 = 0 AS offload
FROM events""",
    "v_artifacts": """
SELECT source AS root, concat(lang, '/', CAST(doc_id AS STRING), '.txt') AS path, text AS content,
       n_chars AS n_chars, doc_id * 1000003 AS mtime_ns
FROM documents""",
    "v_points": """
SELECT l_orderkey * 16 + l_linenumber AS point_id, CAST(floor(l_suppkey / 2) AS BIGINT) % 5 AS video_id,
       l_orderkey % 20 AS frame_index, CAST(l_partkey % 240 AS DOUBLE) AS px, CAST(l_suppkey * 7 % 180 AS DOUBLE) AS py
FROM lineitem""",
}

# Views whose Spark form differs from the check form only in how a sequence is opened or numbered.
DUCK_ONLY_SQL = {
    "v_cuts": """
SELECT d.doc_id AS video_id, n.k * (37 + d.doc_id % 50) AS cut
FROM documents d, (SELECT unnest(range(20)) AS k) n""",
    "v_seq": """
SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
       value AS x, event_type <> 'error' AS hit, event_type = 'signup' AS boundary, ts, event_id
FROM events""",
    "v_cells": """
SELECT v.vec_id AS frame_id, n.k % 8 AS cx, CAST(floor(n.k / 8) AS BIGINT) AS cy,
       CAST(least(255, greatest(0, floor((CAST(v.embedding[n.k + 1] AS DOUBLE) + 0.35) * 360))) AS INT) AS v
FROM embeddings v, (SELECT unnest(range(64)) AS k) n""",
    "v_hist": """
SELECT video_id, frame_index, list(bin ORDER BY k) AS hist
FROM (SELECT CAST(floor(vec_id / 100) AS BIGINT) AS video_id, CAST(floor(vec_id / 5) AS BIGINT) % 20 AS frame_index, k, sum(abs(CAST(embedding[k] AS DOUBLE))) / count(*) AS bin
      FROM embeddings, (SELECT unnest(range(1, 65)) AS k) n GROUP BY ALL) b GROUP BY video_id, frame_index""",
    "v_pairs": """
SELECT a.vec_id, CAST(floor(a.vec_id / 100) AS BIGINT) AS video_id, a.vec_id % 100 AS frame_index,
       list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) + 1) * 127.5) AS original,
       list_transform(range(1, 65), lambda i: (CAST(b.embedding[i] AS DOUBLE) + 1) * 127.5) AS output,
       list_transform(range(1, 65), lambda i: CASE WHEN i % 4 = 0 THEN 0.0 ELSE abs(CAST(a.embedding[i] AS DOUBLE)) END) AS alpha
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "v_target": """
SELECT video_id, CAST(min_by(embedding, CASE WHEN embedding IS NOT NULL THEN det_id END) AS DOUBLE[]) AS target
FROM v_det GROUP BY video_id""",
    "v_sim": """
SELECT d.*, list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), t.target) AS similarity
FROM v_det d JOIN v_target t USING (video_id)""",
    # The reference bank with its weights.
    "v_bank": """
SELECT *, greatest(1e-4, det_score * sqrt(area_ratio) * greatest(0.20, exp(-(abs(pitch) + abs(yaw)) / 70.0))
       * (0.45 + 0.55 * quality)) AS weight
FROM v_refs""",
    "v_clips": """
SELECT video_id, clip_index, start_frame, least(49, n - start_frame) AS valid_frames,
       CASE WHEN clip_index = 0 THEN 0 ELSE greatest(0, prev_start + least(49, n - prev_start) - start_frame) END AS overlap_before,
       hard AS hard_cut_before, (100 + start_frame) % 2147483647 AS seed
FROM v_starts""",
    "v_starts": """
WITH RECURSIVE steps AS (
  SELECT video_id, requested_frames AS n, CAST(0 AS BIGINT) AS clip_index, CAST(0 AS BIGINT) AS start_frame,
         CAST(0 AS BIGINT) AS prev_start, false AS hard,
         (SELECT list(DISTINCT c.cut) FROM v_cuts c WHERE c.video_id = v.video_id AND c.cut > 0 AND c.cut < v.requested_frames) AS cuts
  FROM v_videos v
  UNION ALL
  SELECT video_id, n, clip_index + 1, coalesce(near, start_frame + 32), start_frame, near IS NOT NULL, cuts
  FROM (
    SELECT s.*, list_sort(list_transform(list_filter(coalesce(cuts, []),
             lambda c: c >= greatest(start_frame + 1, start_frame + 20) AND c <= least(n - 1, start_frame + 48, start_frame + 44)),
             lambda c: abs(c - (start_frame + 32)) * 1000000 + c))[1] % 1000000 AS near
    FROM steps s WHERE start_frame + 49 < n) t
)
SELECT video_id, n, clip_index, start_frame, prev_start, hard FROM steps""",
    "v_clip_values": """
SELECT video_id, clip_index, k AS "offset", CAST((video_id * 31 + clip_index * 17 + k * 7) % 256 AS DOUBLE) AS value
FROM (SELECT *, unnest(range(valid_frames)) AS k FROM v_clips) c""",
    "v_track": """
SELECT f.video_id, f.frame_index, f.frame_index % 7 = 3 AS scene_cut, coalesce(a.ambiguous, false) AS ambiguous,
       i.det_id IS NOT NULL AND NOT coalesce(a.ambiguous, false) AS located,
       CASE WHEN NOT coalesce(a.ambiguous, false) THEN coalesce(i.n, 0) ELSE 0 END AS n_instances,
       CASE WHEN i.det_id IS NOT NULL AND NOT coalesce(a.ambiguous, false) THEN i.similarity ELSE 0.0 END AS similarity,
       CASE WHEN NOT coalesce(a.ambiguous, false) THEN i.det_id END AS det_id,
       CASE WHEN i.det_id IS NOT NULL AND NOT coalesce(a.ambiguous, false) THEN i.yaw ELSE 0.0 END AS yaw,
       CASE WHEN i.det_id IS NOT NULL AND NOT coalesce(a.ambiguous, false) THEN i.pitch ELSE 0.0 END AS pitch
FROM v_frames f
LEFT JOIN v_ambiguous a USING (video_id, frame_index)
LEFT JOIN (
  SELECT video_id, frame_index, count(*) AS n, max(similarity) AS similarity, max_by(det_id, w * h * 1000000 - det_id) AS det_id,
         max_by(yaw, w * h * 1000000 - det_id) AS yaw, max_by(pitch, w * h * 1000000 - det_id) AS pitch
  FROM v_posed WHERE similarity >= 0.10 GROUP BY video_id, frame_index) i USING (video_id, frame_index)""",
    "v_ambiguous": """
SELECT video_id, frame_index, max(similarity) AS top_similarity, max(CASE WHEN r = 2 THEN similarity END) AS second_similarity,
       coalesce(max(similarity) >= 0.05 AND max(CASE WHEN r = 2 THEN similarity END) >= 0.05
       AND max(similarity) - max(CASE WHEN r = 2 THEN similarity END) < 0.05, false) AS ambiguous
FROM (SELECT video_id, frame_index, similarity,
             row_number() OVER (PARTITION BY video_id, frame_index ORDER BY similarity DESC, det_id) AS r
      FROM v_sim WHERE similarity IS NOT NULL) t
WHERE r <= 2 GROUP BY video_id, frame_index""",
    "v_posed": """
SELECT *, least(60.0, greatest(-60.0, (kx2 - (kx0 + kx1) / 2) / greatest(1.0, sqrt((kx1 - kx0) ** 2 + (ky1 - ky0) ** 2)) * 55.0)) AS yaw,
       least(40.0, greatest(-40.0, (ky2 - ((ky0 + ky1) / 2 + 0.52 * fh)) / fh * 55.0)) AS pitch
FROM (SELECT *, greatest(1.0, sqrt(((kx3 + kx4) / 2 - (kx0 + kx1) / 2) ** 2 + ((ky3 + ky4) / 2 - (ky0 + ky1) / 2) ** 2)) AS fh
      FROM v_sim) t""",
}


def with_views(query: str) -> str:
    """Prefix a check query with the views it names, in order of need."""
    every = {**VIEW_SQL, **DUCK_ONLY_SQL}
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", text):
            if name in every and name not in order:
                need(every[name])
                if name not in order:
                    order.append(name)

    need(query)
    if not order:
        return query
    head = ",\n".join(f"{name} AS ({every[name].strip()})" for name in order)
    body = query.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[len('WITH '):]}"
    return f"WITH {head}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame."""
    if name in _SPARK_VIEWS:
        return _SPARK_VIEWS[name](spark, sf_dir)
    sql = VIEW_SQL[name]
    source = next(t for t in TABLES if re.search(rf"FROM {t}\b", sql))
    table(spark, sf_dir, source).createOrReplaceTempView(source)
    return spark.sql(sql)


def kps_array() -> Column:
    return F.array(
        *(F.struct(F.col(f"kx{i}").alias("x"), F.col(f"ky{i}").alias("y")) for i in range(5))
    )


def _v_cuts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    return docs.select(F.col("doc_id").alias("video_id"), (F.col("k") * (37 + F.col("doc_id") % 50)).alias("cut"))


def _v_seq(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("value").alias("x"), (F.col("event_type") != "error").alias("hit"),
        (F.col("event_type") == "signup").alias("boundary"), "ts", "event_id",
    )
    return ordered.ordered_index(events, ["key"], ["ts", "event_id"], ordered.time_bucket("ts"), "idx")


def _v_cells(spark, sf_dir):
    cells = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("frame_id"), F.posexplode("embedding").alias("k", "e")
    )
    value = F.floor((F.col("e").cast("double") + 0.35) * 360)
    return cells.select(
        "frame_id", (F.col("k") % 8).cast("long").alias("cx"), F.floor(F.col("k") / 8).cast("long").alias("cy"),
        F.least(F.lit(255), F.greatest(F.lit(0), value)).cast("int").alias("v"),
    )


def _v_hist(spark, sf_dir):
    """A frame's histogram: the mean absolute component of all its rows, one bin per component."""
    e = as_doubles("embedding")
    bins = F.array(*(F.sum(F.abs(F.get(e, F.lit(i)))) / F.count(F.lit(1)) for i in range(64)))
    return table(spark, sf_dir, "embeddings").groupBy(
        F.floor(F.col("vec_id") / 100).cast("long").alias("video_id"), (F.floor(F.col("vec_id") / 5).cast("long") % 20).alias("frame_index")
    ).agg(bins.alias("hist"))


def _v_pairs(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    pixel = lambda e: F.transform(as_doubles(e), lambda x: (x + 1) * 127.5)
    alpha = F.transform(
        as_doubles("embedding"), lambda x, i: F.when((i + 1) % 4 == 0, F.lit(0.0)).otherwise(F.abs(x))
    )
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), pixel("embedding").alias("output"))
    original = vectors.select("vec_id", pixel("embedding").alias("original"), alpha.alias("alpha"))
    return original.join(following, "vec_id").select(
        "vec_id", F.floor(F.col("vec_id") / 100).cast("long").alias("video_id"),
        (F.col("vec_id") % 100).alias("frame_index"), "original", "output", "alpha",
    )


def _v_clips(spark, sf_dir):
    return plan_windows(view(spark, sf_dir, "v_videos"), view(spark, sf_dir, "v_cuts"), WindowPlan())


def _v_clip_values(spark, sf_dir):
    offsets = F.sequence(F.lit(0).cast("long"), F.col("valid_frames") - 1)
    opened = view(spark, sf_dir, "v_clips").select("video_id", "clip_index", F.explode(offsets).alias("offset"))
    value = (F.col("video_id") * 31 + F.col("clip_index") * 17 + F.col("offset") * 7) % 256
    return opened.withColumn("value", value.cast("double"))


def _v_target(spark, sf_dir):
    return view(spark, sf_dir, "v_det").groupBy("video_id").agg(
        as_doubles(F.min_by("embedding", F.when(F.col("embedding").isNotNull(), F.col("det_id")))).alias("target")
    )


def _v_sim(spark, sf_dir):
    from framelens.operators.tracking import similarity_to_target

    return similarity_to_target(view(spark, sf_dir, "v_det"), view(spark, sf_dir, "v_target")).withColumn(
        "kps", kps_array()
    )


def _v_bank(spark, sf_dir):
    from framelens.functions import reference_weight
    from framelens.functions.pose import turn_weight

    return view(spark, sf_dir, "v_refs").withColumn(
        "weight",
        reference_weight(F.col("det_score"), F.col("area_ratio"), turn_weight(F.col("yaw"), F.col("pitch")), F.col("quality")),
    )


def _v_ambiguous(spark, sf_dir):
    from framelens.operators.detections import ambiguity

    return ambiguity(view(spark, sf_dir, "v_sim"), margin=0.05, min_sim=0.05)


def _v_track(spark, sf_dir):
    from framelens.functions import pose_from_kps
    from framelens.operators.tracking import instances_to_frames

    yaw, pitch = pose_from_kps(F.col("kps"))
    instances = view(spark, sf_dir, "v_sim").filter(F.col("similarity") >= 0.10).withColumns({"yaw": yaw, "pitch": pitch})
    verdict = view(spark, sf_dir, "v_ambiguous").select("video_id", "frame_index", "ambiguous")
    frames = view(spark, sf_dir, "v_frames").select(
        "video_id", "frame_index", (F.col("frame_index") % 7 == 3).alias("scene_cut")
    ).join(verdict, ["video_id", "frame_index"], "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))
    return instances_to_frames(instances, frames)


_SPARK_VIEWS = {
    "v_cuts": _v_cuts, "v_seq": _v_seq, "v_cells": _v_cells, "v_hist": _v_hist, "v_pairs": _v_pairs,
    "v_clips": _v_clips, "v_clip_values": _v_clip_values, "v_target": _v_target, "v_sim": _v_sim, "v_bank": _v_bank,
    "v_ambiguous": _v_ambiguous, "v_track": _v_track,
}
