"""Queries over hashes, caches, names and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens import __version__
from framelens.functions import cache_key, manifest_path
from framelens.operators import provenance as prv
from framelens.plans.catalog import query
from framelens.plans.views import table, view
from framelens.session import scratch_path
from framelens.sources import readers, writers

STAMP = "20240101_000000"
CREATED = "2024-01-01T00:00:00+00:00"


def _artifacts(spark, sf_dir):
    return view(spark, sf_dir, "v_artifacts").withColumn("size", F.octet_length("content").cast("long"))


@query("src7_scan_artifacts", """
SELECT 'lang=' || lang || '/source=' || source AS folder, CAST(1 AS BIGINT) AS files, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS size,
       CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS content_size
FROM documents GROUP BY lang, source
""")
def src7(spark, sf_dir):
    """All documents are written as text files, one folder per language and source, and the folders scanned."""
    root = scratch_path(spark, "artifacts")
    texts = table(spark, sf_dir, "documents").select("lang", "source", F.coalesce("text", F.lit("")).alias("value"))
    texts.repartition("lang", "source").write.partitionBy("lang", "source").text(root)
    found = readers.scan_artifacts(spark, root)
    return found.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"), F.sum(F.octet_length("content").cast("long")).alias("content_size")
    )


@query("prv1_content_hash", "SELECT root, path, sha256(content) AS sha256 FROM v_artifacts")
def prv1(spark, sf_dir):
    return prv.content_hash(_artifacts(spark, sf_dir)).select("root", "path", "sha256")


@query("prv2_fingerprint", """
SELECT root, path, sha256('file:' || n_chars || ':' || mtime_ns) AS fingerprint FROM v_artifacts
""")
def prv2(spark, sf_dir):
    return prv.fingerprint(_artifacts(spark, sf_dir), size="n_chars").select("root", "path", "fingerprint")


@query("prv2_tree_fingerprint", """
SELECT root, sha256(string_agg(path || ':' || n_chars || ':' || mtime_ns, '' ORDER BY string_split(path, '/'))) AS fingerprint, count(*) AS files FROM v_artifacts GROUP BY root
""")
def prv2_tree(spark, sf_dir):
    return prv.tree_fingerprint(_artifacts(spark, sf_dir), size="n_chars")


@query("agg18_tree_hash", """
SELECT root, sha256(unhex(string_agg(printf('%016x', octet_length(encode(path))) || hex(encode(path)) || sha256(content), '' ORDER BY string_split(path, '/')))) AS tree_sha256, count(*) AS files FROM v_artifacts GROUP BY root
""")
def agg18(spark, sf_dir):
    return prv.tree_hash(_artifacts(spark, sf_dir))


def _cache(spark, sf_dir):
    """Entries for artifacts of even mtime; every seventh size is out of date."""
    known = prv.content_hash(_artifacts(spark, sf_dir)).filter(F.col("mtime_ns") % 2 == 0)
    size = F.when(F.col("n_chars") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return known.select(
        "root", "path", prv.file_fingerprint(size, F.col("mtime_ns")).alias("fingerprint"), "sha256", F.lit("before").alias("updated")
    )


def _current(spark, sf_dir):
    return prv.fingerprint(_artifacts(spark, sf_dir), size="n_chars")


HIT = "mtime_ns % 2 = 0 AND n_chars % 7 <> 0"


@query("jn9_hash_cache_lookup", f"SELECT root, path, CASE WHEN {HIT} THEN sha256(content) END AS cached_sha256 FROM v_artifacts")
def jn9(spark, sf_dir):
    return prv.hash_cache_lookup(_current(spark, sf_dir), _cache(spark, sf_dir)).select("root", "path", "cached_sha256")


@query("prv3_refresh_hashes", f"""
SELECT root, path, sha256('file:' || n_chars || ':' || mtime_ns) AS fingerprint, sha256(content) AS sha256, CASE WHEN {HIT} THEN 'before' ELSE 'now' END AS updated, {HIT} AS hit FROM v_artifacts
""")
def prv3(spark, sf_dir):
    return prv.refresh_hashes(_current(spark, sf_dir), _cache(spark, sf_dir), F.lit("now"))


@query("prv4_model_records", """
SELECT root, path, CASE WHEN n_chars % 5 = 0 THEN 'directory' ELSE 'file' END AS kind, sha256(content) AS sha256, 'cache.json' AS hash_cache, 'skipped' AS skipped_sha256 FROM v_artifacts
""")
def prv4(spark, sf_dir):
    hashed = prv.content_hash(_artifacts(spark, sf_dir))
    full = prv.model_records(hashed, "cached", cache_path="cache.json", is_directory=F.col("n_chars") % 5 == 0)
    both = prv.model_records(full.withColumnRenamed("record", "full"), "skip")
    return both.select(
        "root", "path", "full.kind", "full.sha256", "full.hash_cache", F.col("record.sha256").alias("skipped_sha256")
    )


ROLES = ("output", "input", "target", "source", "source", "source", "source", "model", "additional", "additional")
ROLE_SQL = "['" + "', '".join(ROLES) + "'][doc_id % 10 + 1]"


def _manifest_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    role = F.element_at(F.array(*(F.lit(r) for r in ROLES)), (F.col("doc_id") % 10 + 1).cast("int"))
    missing = (F.col("doc_id") % 30 == 0) & (role == "output")
    return docs.select(
        F.floor(F.col("doc_id") / 10).cast("long").alias("output_id"), role.alias("role"),
        F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.when(~missing, F.sha2(F.col("text").cast("binary"), 256)).alias("sha256"), F.lit("file").alias("kind"),
    )


def _manifests(spark, sf_dir):
    return prv.build_manifests(_manifest_rows(spark, sf_dir), created=F.lit(CREATED))


MANIFEST_SQL = f"""
SELECT output_id, any_value(CASE WHEN role = 'output' THEN regexp_extract(path, '([^/]*)\\.[^.]*$', 1) || '.manifest.json' END) AS manifest,
  CAST(to_json({{'schema': '{prv.MANIFEST_SCHEMA}', 'project': {{'name': 'framelens', 'version': '{__version__}'}}, 'created_utc': '{CREATED}', 'disclosure': {{'visible': true, 'text': '{prv.DISCLOSURE}'}},
  'credentials': {{'enabled': false, 'status': 'not_requested'}},
  'output_video': any_value(CASE WHEN role = 'output' THEN {{'path': path, 'sha256': sha}} END), 'input_video': any_value(CASE WHEN role = 'input' THEN {{'path': path, 'sha256': sha}} END),
  'target_reference': any_value(CASE WHEN role = 'target' THEN {{'path': path, 'sha256': sha}} END),
  'source_images': coalesce(list({{'path': path, 'sha256': sha}} ORDER BY string_split(path, '/')) FILTER (role = 'source'), []),
  'model': any_value(CASE WHEN role = 'model' THEN {{'path': path, 'kind': 'file', 'sha256': sha}} END),
  'additional_models': coalesce(list({{'path': path, 'kind': 'file', 'sha256': sha}} ORDER BY string_split(path, '/')) FILTER (role = 'additional'), []),
  'runtime': {{'engine': '{__version__}'}}}}) AS VARCHAR) AS document
FROM (SELECT CAST(floor(doc_id / 10) AS BIGINT) AS output_id, {ROLE_SQL} AS role, lang || '/' || doc_id || '.txt' AS path,
             CASE WHEN NOT (doc_id % 30 = 0) THEN sha256(text) END AS sha FROM documents) r GROUP BY output_id"""


@query("prv5_build_manifests", MANIFEST_SQL)
def prv5(spark, sf_dir):
    return _manifests(spark, sf_dir)


MANY_SQL = MANIFEST_SQL.replace("floor(doc_id / 10)", "floor(doc_id / 200)").replace(
    ROLE_SQL, "CASE doc_id % 200 WHEN 0 THEN 'output' WHEN 1 THEN 'input' WHEN 2 THEN 'target' WHEN 3 THEN 'model' ELSE CASE WHEN doc_id % 5 = 0 THEN 'additional' ELSE 'source' END END"
).replace("doc_id % 30 = 0", "doc_id % 600 = 0").replace("ORDER BY string_split(path, '/')", "ORDER BY place").replace("AS role, lang", "AS role, -doc_id AS place, lang")


@query("prv5_build_manifests_many", MANY_SQL)
def prv5_many(spark, sf_dir):
    """Outputs with some 150 sources each, listed in the order given."""
    at = F.col("doc_id") % 200
    role = F.when(at < 4, F.element_at(F.array(*map(F.lit, ("output", "input", "target", "model"))), (at + 1).cast("int"))).when(
        F.col("doc_id") % 5 == 0, "additional"
    ).otherwise("source")
    rows = table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 200).cast("long").alias("output_id"), role.alias("role"), (-F.col("doc_id")).alias("place"),
        F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.when(F.col("doc_id") % 600 != 0, F.sha2(F.col("text").cast("binary"), 256)).alias("sha256"), F.lit("file").alias("kind"),
    )
    return prv.build_manifests(rows, created=F.lit(CREATED), position="place")


@query("snk2_write_manifests", f"SELECT manifest AS name, document FROM ({MANIFEST_SQL}) m")
def snk2(spark, sf_dir):
    path = scratch_path(spark, "manifests")
    for _ in range(2):  # a second write changes nothing
        writers.write_manifests(_manifests(spark, sf_dir), path)
    return writers.read_documents(spark, path).select("name", "document")


@query("snk3_write_quality_reports", f"""
SELECT doc_id || '.quality.json' AS name, CAST(to_json({{'schema': '{prv.QUALITY_SCHEMA}', 'output_video': lang || '/' || doc_id || '.mp4', 'metrics': {{'count': n_chars, 'p95': CAST(NULL AS BIGINT)}}}}) AS VARCHAR) AS document FROM documents
""")
def snk3(spark, sf_dir):
    report = table(spark, sf_dir, "documents").select(
        F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".mp4")).alias("output_video"),
        F.struct(F.col("n_chars").alias("count"), F.lit(None).cast("long").alias("p95")).alias("metrics"),
    )
    path = scratch_path(spark, "quality")
    writers.write_quality_reports(report, path)
    return writers.read_documents(spark, path).select("name", "document")


@query("snk4_assign_output_names", f"""
WITH base AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents WHERE doc_id % 11 <> 0)
SELECT doc_id, lang || '_render_{STAMP}' || CASE WHEN n = 1 THEN '' ELSE '_' || n END || '.mp4' AS output_name FROM base
UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'out/' || doc_id || '.mp4' ELSE 'out/' || doc_id || '.mov' END FROM documents WHERE doc_id % 11 = 0
""")
def snk4(spark, sf_dir):
    number = F.col("doc_id").cast("string")
    given = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("out/"), number)).otherwise(F.concat(F.lit("out/"), number, F.lit(".mov")))
    explicit = F.when(F.col("doc_id") % 11 == 0, given)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return prv.assign_output_names(
        docs, stem=F.col("lang"), tag="render", stamp=F.lit(STAMP), order="doc_id", explicit=explicit
    ).select("doc_id", "output_name")


@query("snk4_assign_output_names_taken", f"""
WITH taken AS (SELECT DISTINCT lang, 1 + doc_id * 2 % 97 AS k FROM documents), n AS (SELECT lang, count(*) AS c FROM documents GROUP BY lang),
free AS (SELECT lang, k, row_number() OVER (PARTITION BY lang ORDER BY k) AS i FROM (SELECT lang, unnest(range(1, c + 120)) AS k FROM n) r ANTI JOIN taken USING (lang, k))
SELECT d.doc_id, d.lang || '_render_{STAMP}' || CASE WHEN k = 1 THEN '' ELSE '_' || k END || '.mp4' AS output_name
FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents) d JOIN free USING (lang, i)
""")
def snk4_taken(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    k = 1 + F.col("doc_id") * 2 % 97
    name = F.concat(F.col("lang"), F.lit(f"_render_{STAMP}"), F.when(k == 1, "").otherwise(F.concat(F.lit("_"), k.cast("string"))), F.lit(".mp4"))
    return prv.assign_output_names(
        docs, stem=F.col("lang"), tag="render", stamp=F.lit(STAMP), order="doc_id", existing=docs.select(name.alias("name"))
    ).select("doc_id", "output_name")


@query("snk5_manifest_path", """
SELECT root, path, 'manifests/' || regexp_extract(path, '([^/]*)\\.[^.]*$', 1) || '.manifest.json' AS manifest FROM v_artifacts
""")
def snk5(spark, sf_dir):
    return view(spark, sf_dir, "v_artifacts").select("root", "path", manifest_path(F.col("path"), "manifests").alias("manifest"))


@query("prv6_provenance_audit", """
SELECT status, count(*) AS outputs, count(CASE WHEN required AND status IN ('skipped', 'error') THEN 1 END) AS failures FROM (
  SELECT doc_id % 3 = 0 AS required, CASE WHEN doc_id % 5 = 0 THEN 'disabled' WHEN doc_id % 4 = 0 THEN 'skipped' WHEN doc_id % 7 = 0 THEN 'error' ELSE 'embedded' END AS status FROM documents) d GROUP BY status
""")
def prv6(spark, sf_dir):
    requests = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 5 != 0).alias("enabled"), (F.col("doc_id") % 3 == 0).alias("required"),
        (F.col("doc_id") % 4 != 0).alias("tool_found"), (F.col("doc_id") % 7 != 0).alias("signed"),
    )
    return prv.audit_counts(prv.provenance_audit(requests))


@query("prv7_content_credentials", f"""
SELECT doc_id, CAST(json_object('alg', 'es256', 'claim_generator', 'framelens/{__version__}', 'title', doc_id || '.mp4', 'ingredient_paths', json_array(lang || '/' || doc_id),
  'assertions', json_array(
    json_object('label', 'c2pa.actions.v2', 'data', json_object('actions', json_array(json_object('action', 'c2pa.created', 'digitalSourceType', '{prv.SOURCE_TYPE}', 'softwareAgent', json_object('name', 'framelens', 'version', '{__version__}'))), 'allActionsIncluded', true)),
    json_object('label', 'org.framelens.provenance', 'data', json_object('synthetic_media', n_chars % 2 = 0, 'operation', 'authorized', 'model_backend', source, 'model_capabilities', json_object('faces', n_chars % 3), 'created_utc', '{CREATED}')),
    json_object('label', 'stds.schema-org.CreativeWork', 'data', json_object('@context', 'https://schema.org', '@type', 'VideoObject', 'name', doc_id || '.mp4', 'description', 'from ' || source)))) AS VARCHAR) AS credentials FROM documents
""")
def prv7(spark, sf_dir):
    outputs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".mp4")).alias("name"),
        F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("input_path"), F.lit("authorized").alias("operation"), F.col("source").alias("backend"),
        (F.col("n_chars") % 2 == 0).alias("synthetic_media"), F.struct((F.col("n_chars") % 3).alias("faces")).alias("model_capabilities"),
        F.concat(F.lit("from "), F.col("source")).alias("description"),
    )
    return prv.content_credentials(outputs, created=F.lit(CREATED)).select("doc_id", "credentials")


@query("prv8_cache_key", """
SELECT root, path, substring(sha256('{"cache_schema":2,"input":{"mtime_ns":' || mtime_ns || ',"path":"' || path || '"},"requested_frames":' || n_chars || ',"size":"832*480","variant":null}'), 1, 32) AS key FROM v_artifacts
""")
def prv8(spark, sf_dir):
    fields = {
        "size": F.lit("832*480"), "requested_frames": F.col("n_chars"), "input": F.struct("mtime_ns", "path"),
        "variant": F.lit(None).cast("string"), "cache_schema": F.lit(2),
    }
    return view(spark, sf_dir, "v_artifacts").select("root", "path", cache_key(fields).alias("key"))


@query("prv9_cache_valid", """
SELECT video_id, requested_frames % 13 > 0 AND requested_frames >= 100 AND width = 832 AND height = 480 AND abs(fps + (video_id % 3) * 0.04 - 16) <= 0.05 AS usable FROM v_videos
""")
def prv9(spark, sf_dir):
    entries = view(spark, sf_dir, "v_videos").select(
        "video_id", F.col("requested_frames").alias("frame_count"), (F.col("requested_frames") % 13).alias("bytes"), "width", "height",
        (F.col("fps") + (F.col("video_id") % 3) * 0.04).alias("fps"),
    )
    return prv.cache_valid(entries, requested=F.lit(100), width=832, height=480, fps=16.0).select("video_id", "usable")


@query("win11_stale_entries", """
SELECT root, path FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY mtime_ns DESC, path) AS r FROM v_artifacts) t WHERE r > 8 AND n_chars % 50 <> 0
""")
def win11(spark, sf_dir):
    return prv.stale_entries(_artifacts(spark, sf_dir), 8, current=F.col("n_chars") % 50 == 0).select("root", "path")


@query("jn12_expected_vs_present", """
SELECT e.root, count(*) AS expected, count(CASE WHEN p.slot IS NULL THEN 1 END) AS missing_count, coalesce(array_to_string(list(e.slot ORDER BY e.slot) FILTER (p.slot IS NULL), ','), '') AS missing, bool_and(p.slot IS NOT NULL) AS ready
FROM (SELECT root, unnest(range(30)) AS slot FROM (SELECT DISTINCT root FROM v_artifacts) r) e LEFT JOIN (SELECT DISTINCT root, n_chars % 30 AS slot FROM v_artifacts) p USING (root, slot) GROUP BY e.root
""")
def jn12(spark, sf_dir):
    artifacts = _artifacts(spark, sf_dir)
    slots = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long")))
    expected = artifacts.select("root").distinct().select("root", slots.alias("slot"))
    present = artifacts.select("root", (F.col("n_chars") % 30).alias("slot"))
    checked = prv.expected_vs_present(expected, present)
    return checked.withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ","))


# Hooks for user models, with a plain stand-in over the given rows.

def _word_detector():
    """A stand-in model: one detection per line of a document, boxes from line number and length."""

    def detect(content: bytes):
        for i, line in enumerate(content.decode("utf-8").split("\n")):
            yield {"x1": float(i), "y1": 0.0, "x2": float(i + len(line)), "y2": 1.0, "det_score": 0.5, "kps": [], "embedding": None}

    return detect


@query("udf2_detect", """
SELECT doc_id, CAST(i AS BIGINT) AS det_id, CAST(i AS DOUBLE) AS x1, CAST(i + length(lines[i + 1]) AS DOUBLE) AS x2
FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) a) b
""")
def udf2(spark, sf_dir):
    from framelens.operators.registry import detect

    images = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return detect(images, _word_detector, keys=["doc_id"]).select("doc_id", "det_id", "x1", "x2")


def _share_estimator():
    def estimate(batch):
        out = batch.rename(columns={"w": "aspect", "h": "confidence"})
        out["aspect"] = batch["w"] / batch["h"]
        out["confidence"] = batch["h"].where(batch["h"] > 40)
        return out[["aspect", "confidence"]]

    return estimate


@query("udf3_enrich", "SELECT det_id, round(w / h, 6) + 0.0 AS aspect, CASE WHEN h > 40 THEN h END AS confidence FROM v_det")
def udf3(spark, sf_dir):
    from framelens.operators.registry import enrich

    made = enrich(view(spark, sf_dir, "v_det"), _share_estimator, ["w", "h"], "aspect double, confidence double")
    return made.select("det_id", (F.round("geometry.aspect", 6) + 0.0).alias("aspect"), "geometry.confidence")


@query("udf4_transform_or_identity", "SELECT det_id, x1 + 1 AS x1 FROM v_box")
def udf4(spark, sf_dir):
    from framelens.operators.registry import transform_or_identity

    boxes = transform_or_identity(view(spark, sf_dir, "v_box").select("det_id", "x1"))
    return transform_or_identity(boxes, lambda df: df.withColumn("x1", F.col("x1") + 1))
