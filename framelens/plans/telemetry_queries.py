"""Queries over telemetry, worker lines and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.operators import telemetry
from framelens.plans.catalog import q6, query, r6
from framelens.plans.sequence_queries import flat_sql, track_config, track_inputs
from framelens.plans.views import VIEW_SQL, table, view
from framelens.session import scratch_path
from framelens.sources import readers, writers
from framelens.streaming import jobs, processors

ENVELOPE = """concat('{"timestamp":"', CAST(ts AS STRING), '","run_id":"', CAST(floor(event_id / 1000) AS BIGINT), '","event":"', event_type,
 '","thread":"main","process_id":', CAST(user_id AS STRING), ',"value":', CAST(event_id % 77 AS STRING), '}')"""


@query("src2_read_events", """
SELECT event_id, CAST(CAST(floor(event_id / 1000) AS BIGINT) AS VARCHAR) AS run_id, CASE WHEN event_id % 23 = 0 THEN NULL ELSE event_type END AS event,
       CASE WHEN event_id % 23 <> 0 THEN user_id END AS process_id, CASE WHEN event_id % 23 <> 0 THEN event_id % 77 END AS value FROM events
""")
def src2(spark, sf_dir):
    """Events rendered as JSON lines; one line in 23 is cut off and must not stop the reader."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    lines = spark.sql(f"SELECT event_id, {ENVELOPE} AS line FROM events").withColumn(
        "line", F.when(F.col("event_id") % 23 == 0, F.expr("substring(line, 1, length(line) - 3)")).otherwise(F.col("line"))
    )
    parsed = readers.parse_events(lines)
    run = F.coalesce("run_id", F.floor(F.col("event_id") / 1000).cast("string"))
    return parsed.select(
        "event_id", run.alias("run_id"), "event", "process_id", F.try_variant_get("extra", "$.value", "bigint").alias("value")
    )


BROKEN = "event_id % 17 = 0"
CLASS_SQL = f"CASE WHEN event_id % 4 = 3 THEN 'passthrough' WHEN event_id % 4 <> 0 AND {BROKEN} THEN 'quarantine' ELSE ['result', 'profile', 'log'][event_id % 4 + 1] END"


@query("src3_read_worker_lines", f"""
SELECT event_id, {CLASS_SQL} AS class, CASE WHEN {CLASS_SQL} IN ('quarantine', 'passthrough') THEN substring(line, 1, 2000) END AS raw,
       CASE WHEN event_id % 4 <> 3 AND NOT {BROKEN} THEN json_extract_string(substring(line, strpos(line, '{{')), '$.event') END AS event FROM v_worker_lines
""")
def src3(spark, sf_dir):
    classed = readers.read_worker_lines(view(spark, sf_dir, "v_worker_lines"))
    return classed.select("event_id", "class", "raw", F.try_variant_get("payload", "$.event", "string").alias("event"))


@query("src4_normalize_worker_event", f"""
SELECT event_id, CASE WHEN {BROKEN} THEN 'worker_event' ELSE json_extract_string(substring(line, strpos(line, '{{')), '$.event') END AS event,
       'worker' AS source, 'Worker message' AS message, CASE WHEN event_id % 5 = 0 AND NOT {BROKEN} THEN 'ERROR' ELSE 'WARNING' END AS level FROM v_worker_lines WHERE event_id % 4 <> 3
""")
def src4(spark, sf_dir):
    classed = readers.read_worker_lines(view(spark, sf_dir, "v_worker_lines")).filter(F.col("class") != "passthrough")
    return readers.normalize_worker_event(classed).select("event_id", "event", "source", "message", "level")


PROBE = """CASE WHEN doc_id % 10 = 0 THEN 'not json' WHEN doc_id % 10 = 1 THEN '{"streams":[]}' ELSE concat('{"streams":[{"pix_fmt":"yuv420p","color_transfer":"',
 CASE WHEN doc_id % 3 = 0 THEN 'smpte2084' ELSE lang END, '","color_range":"tv","bits":8},{"pix_fmt":"other"}]}') END"""


@query("src5_read_probe_json", f"""
SELECT doc_id, CASE WHEN ok THEN 'yuv420p' END AS pixel_format, CASE WHEN ok THEN t END AS color_transfer, CAST(NULL AS VARCHAR) AS color_space,
       CASE WHEN ok THEN 'tv' END AS color_range, ok AND t IN ('smpte2084', 'arib-std-b67') AS hdr
FROM (SELECT doc_id, doc_id % 10 > 1 AS ok, CASE WHEN doc_id % 3 = 0 THEN 'smpte2084' ELSE lang END AS t FROM documents) d
""")
def src5(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    probes = spark.sql(f"SELECT doc_id, {PROBE} AS probe FROM documents")
    return readers.read_probe_json(probes).select("doc_id", "pixel_format", "color_transfer", "color_space", "color_range", "hdr")


@query("src6_validate_videos", "SELECT video_id, fps > 0 AND width > 0 AND height > 0 AS valid FROM v_videos")
def src6(spark, sf_dir):
    from framelens.operators.filters import validate_videos

    return validate_videos(view(spark, sf_dir, "v_videos")).select("video_id", "valid")


@query("snk1_append_jsonl", "SELECT event_id, event_type, user_id FROM events")
def snk1(spark, sf_dir):
    """Written as JSON lines in two appends and read back."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    path = scratch_path(spark, "jsonl")
    writers.append_jsonl(rows.filter(F.col("event_type") != "click"), path)
    writers.append_jsonl(rows.filter(F.col("event_type") == "click"), path)
    return spark.read.schema(rows.schema).json(path)


@query("set1_union_telemetry", """
SELECT span_id AS id, name, duration_ns, CAST(NULL AS VARCHAR) AS level FROM v_spans
UNION ALL SELECT event_id, json_extract_string(substring(line, strpos(line, '{')), '$.event'), NULL, 'WARNING' FROM v_worker_lines WHERE event_id % 4 = 2 AND event_id % 17 <> 0 AND event_id % 5 <> 0
UNION ALL SELECT event_id, json_extract_string(substring(line, strpos(line, '{')), '$.event'), NULL, 'ERROR' FROM v_worker_lines WHERE event_id % 4 = 2 AND event_id % 17 <> 0 AND event_id % 5 = 0
""")
def set1(spark, sf_dir):
    main = view(spark, sf_dir, "v_spans").select(F.col("span_id").alias("id"), "name", "duration_ns")
    worker = readers.normalize_worker_event(
        readers.read_worker_lines(view(spark, sf_dir, "v_worker_lines")).filter(F.col("class") == "log")
    ).select(F.col("event_id").alias("id"), F.col("event").alias("name"), "level")
    return telemetry.union_telemetry(main, worker)


@query("agg1_span_summary", f"""
SELECT run_id, name, count(*) AS count, CAST(sum(duration_ns) AS BIGINT) AS total_duration_ns, {q6("avg(duration_ns)")} AS average_duration_ns,
       min(duration_ns) AS min_duration_ns, max(duration_ns) AS max_duration_ns, CAST(sum(thread_cpu_ns) AS BIGINT) AS total_thread_cpu_ns FROM v_spans GROUP BY run_id, name
""")
def agg1(spark, sf_dir):
    summary = telemetry.span_summary(view(spark, sf_dir, "v_spans"))
    return telemetry.by_total(summary.withColumn("average_duration_ns", r6("average_duration_ns")))


@query("agg2_run_counters", f"""
SELECT run_id, count(*) AS analyzed_frames, CAST(sum(full_scan) AS BIGINT) AS full_scans, CAST(sum(detected) AS BIGINT) AS detected_faces, CAST(sum(recognized) AS BIGINT) AS recognition_inferences,
       CAST(sum(written) AS BIGINT) AS written_frames, CAST(0 AS BIGINT) AS swapped_faces, {q6("sum(seconds)")} AS analysis_seconds, CAST(0 AS DOUBLE) AS decode_seconds FROM v_frame_events GROUP BY run_id
""")
def agg2(spark, sf_dir):
    return _counters(spark, sf_dir).select(
        "run_id", "analyzed_frames", "full_scans", "detected_faces", "recognition_inferences", "written_frames", "swapped_faces",
        r6("analysis_seconds").alias("analysis_seconds"), "decode_seconds",
    )


def _counters(spark, sf_dir):
    return telemetry.run_counters(
        view(spark, sf_dir, "v_frame_events"),
        {
            "analyzed_frames": F.lit(1), "full_scans": F.col("full_scan"), "detected_faces": F.col("detected"),
            "recognition_inferences": F.col("recognized"), "written_frames": F.col("written"), "analysis_seconds": F.col("seconds"),
        },
    )


@query("agg3_throughput", """
SELECT run_id, round(CAST(sum(written) AS DOUBLE) / greatest(sum(seconds), 1e-9), 3) AS effective_fps FROM v_frame_events GROUP BY run_id
""")
def agg3(spark, sf_dir):
    stats = _counters(spark, sf_dir).withColumn("elapsed_seconds", F.col("analysis_seconds"))
    return telemetry.throughput(stats).select("run_id", "effective_fps")


@query("agg11_clip_counters", """
SELECT worker_request_id, calls, hits, misses, array_to_string(list(name || '=' || total ORDER BY name), ',') AS durations FROM (
  SELECT worker_request_id, name, sum(duration_ns)::BIGINT AS total, CAST(sum(sum(CASE WHEN name IN ('view', 'click') THEN 1 ELSE 0 END)) OVER w AS BIGINT) AS calls,
         CAST(sum(sum(CASE WHEN name = 'purchase' THEN 1 ELSE 0 END)) OVER w AS BIGINT) AS hits, CAST(sum(sum(CASE WHEN name = 'error' THEN 1 ELSE 0 END)) OVER w AS BIGINT) AS misses
  FROM v_spans GROUP BY worker_request_id, name WINDOW w AS (PARTITION BY worker_request_id)) t GROUP BY worker_request_id, calls, hits, misses
""")
def agg11(spark, sf_dir):
    counted = telemetry.clip_counters(
        view(spark, sf_dir, "v_spans"), {"calls": ["view", "click"], "hits": ["purchase"], "misses": ["error"]}
    )
    pairs = F.transform(F.map_entries("span_duration_ns"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return counted.select("worker_request_id", "calls", "hits", "misses", F.array_join(pairs, ",").alias("durations"))


@query("agg19_run_sessions", f"""
SELECT run_id, min(ts) AS started, max(ts) AS ended, count(*) AS events, {q6("(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6")} AS elapsed_seconds, max(m.allocated_bytes) AS peak_bytes
FROM v_spans s JOIN v_mem m ON m.event_id = s.span_id GROUP BY run_id
""")
def agg19(spark, sf_dir):
    memory = view(spark, sf_dir, "v_mem").withColumn("run_id", F.floor(F.col("event_id") / 1000).cast("long"))
    sessions = telemetry.run_sessions(view(spark, sf_dir, "v_spans"), memory)
    return sessions.withColumn("elapsed_seconds", r6("elapsed_seconds"))


@query("agg20_occupancy_flag", f"""
SELECT event_id, inactive AS inactive_bytes, {q6("ratio")} AS reserved_ratio, (offload AND inactive > 268435456) OR (ratio >= 0.05 AND inactive > 536870912) AS should_clear
FROM (SELECT *, greatest(0, reserved_bytes - allocated_bytes) AS inactive, CAST(reserved_bytes AS DOUBLE) / greatest(total_bytes, 1) AS ratio FROM v_mem) m
""")
def agg20(spark, sf_dir):
    flagged = telemetry.occupancy_flag(view(spark, sf_dir, "v_mem"), threshold=0.05)
    return flagged.select("event_id", "inactive_bytes", r6("reserved_ratio").alias("reserved_ratio"), "should_clear")


def _by_name(spark, sf_dir, name):
    return view(spark, sf_dir, "v_spans").filter(F.col("name") == name)


@query("jn10_correlate_requests", """
SELECT q.span_id, coalesce(a.n, 0) AS worker_events, a.total AS worker_duration_ns, a.first_event FROM v_spans q LEFT JOIN (
  SELECT run_id, worker_request_id, count(*) AS n, CAST(sum(duration_ns) AS BIGINT) AS total, arg_min(span_id, {'t': ts, 's': span_id}) AS first_event FROM v_spans WHERE name = 'view' GROUP BY run_id, worker_request_id) a
USING (run_id, worker_request_id) WHERE q.name = 'click'
""")
def jn10(spark, sf_dir):
    return telemetry.correlate_requests(_by_name(spark, sf_dir, "click"), _by_name(spark, sf_dir, "view")).select(
        "span_id", "worker_events", "worker_duration_ns", "first_event"
    )


@query("jn11_span_children", """
SELECT s.span_id, coalesce(c.n, 0) AS children, coalesce(c.total, 0) AS child_duration_ns, s.duration_ns - coalesce(c.total, 0) AS self_duration_ns FROM v_spans s LEFT JOIN (
  SELECT run_id, parent_span_id AS span_id, count(*) AS n, CAST(sum(duration_ns) AS BIGINT) AS total FROM v_spans WHERE parent_span_id IS NOT NULL GROUP BY run_id, parent_span_id) c USING (run_id, span_id)
""")
def jn11(spark, sf_dir):
    return telemetry.span_children(view(spark, sf_dir, "v_spans")).select("span_id", "children", "child_duration_ns", "self_duration_ns")


@query("str11_span_tree", """
WITH RECURSIVE tree AS (
  SELECT run_id, span_id, span_id AS root, CAST(0 AS BIGINT) AS depth, CAST(span_id AS VARCHAR) AS path FROM v_spans WHERE parent_span_id IS NULL
  UNION ALL SELECT s.run_id, s.span_id, t.root, t.depth + 1, t.path || '/' || s.span_id FROM tree t JOIN v_spans s ON s.run_id = t.run_id AND s.parent_span_id = t.span_id)
SELECT * FROM tree
""")
def str11(spark, sf_dir):
    return telemetry.span_tree(view(spark, sf_dir, "v_spans")).drop("complete")


@query("top3_top_functions", """
SELECT run_id, span_id, rank FROM (SELECT run_id, span_id, row_number() OVER (PARTITION BY run_id ORDER BY duration_ns DESC, span_id) AS rank FROM v_spans WHERE duration_ns > 0) t WHERE rank <= 20
""")
def top3(spark, sf_dir):
    return telemetry.top_functions(view(spark, sf_dir, "v_spans"), 20).select("run_id", "span_id", F.col("rank").cast("long").alias("rank"))


@query("set3_dedupe_exceptions", """
SELECT run_id, worker_request_id, span_id, duration_ns FROM (SELECT *, row_number() OVER (PARTITION BY run_id, worker_request_id ORDER BY ts, span_id) AS r FROM v_spans WHERE status = 'error') t WHERE r = 1
""")
def set3(spark, sf_dir):
    errors = view(spark, sf_dir, "v_spans").filter(F.col("status") == "error")
    first = telemetry.dedupe_exceptions(errors, keys=["run_id", "worker_request_id"], order=["ts", "span_id"])
    return first.select("run_id", "worker_request_id", "span_id", "duration_ns")


LRU_SQL = """
WITH a AS MATERIALIZED (SELECT event_id, hour(ts) AS key, user_id AS item, ts, row_number() OVER (PARTITION BY hour(ts) ORDER BY ts, event_id) AS n FROM events),
p AS MATERIALIZED (SELECT *, lag(n) OVER (PARTITION BY key, item ORDER BY n) AS before, lead(n) OVER (PARTITION BY key, item ORDER BY n) AS next FROM a)
SELECT p.event_id, p.before IS NOT NULL AND coalesce(d.distinct_items, 0) < 20 AS hit FROM p LEFT JOIN (
  SELECT p.event_id, count(*) AS distinct_items FROM p JOIN p q ON q.key = p.key AND q.n > p.before AND q.n < p.n AND (q.next IS NULL OR q.next >= p.n) GROUP BY p.event_id) d USING (event_id)
"""


@query("win12_lru_hits", LRU_SQL)
def win12(spark, sf_dir):
    accesses = table(spark, sf_dir, "events").select(
        F.hour("ts").cast("long").alias("key"), F.col("user_id").alias("item"), "ts", "event_id"
    )
    return telemetry.lru_hits(accesses, 20).select("event_id", "hit")


@query("str6_stalled_runs", f"""
SELECT event_id, {q6("gap")} AS gap_seconds FROM (SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events) t WHERE gap > 43200 * 2.0
""")
def str6(spark, sf_dir):
    stalled = telemetry.stalled_runs(table(spark, sf_dir, "events"), 43200, key="user_id")
    return stalled.select("event_id", r6("gap_seconds").alias("gap_seconds"))


# Streams over the same tables, run to the end of what is there.

#: Events of a staged file; a batch takes as many files as its events need.
FILE_ROWS = 1 << 17


def _staged_events(spark, sf_dir):
    """The events in five batches by time, and the number of files a batch takes; within a batch they are out of order."""
    events, staged = table(spark, sf_dir, "events"), scratch_path(spark, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    events = events.withColumn("_part", F.least(F.floor((at - low) * 5 / max(1, high - low)), F.lit(4)))
    sizes = {r["_part"]: r["count"] for r in events.groupBy("_part").count().collect()}
    files = max([1, *(-(-n // FILE_ROWS) for part, n in sizes.items() if part is not None)])
    for part in range(5):
        rows = events.where(F.col("_part") == part).drop("_part")
        rows.repartition(files, F.xxhash64("event_id")).write.mode("append").parquet(staged)
        # Tasks without rows write no file; empty ones take their place, so that no batch reaches into the next.
        for _ in range(len(spark.read.parquet(staged).inputFiles()), files * (part + 1)):
            rows.limit(0).coalesce(1).write.mode("append").parquet(staged)
    return staged, files


def _stream(spark, sf_dir, view_name=None):
    staged, files = _staged_events(spark, sf_dir)
    source = jobs.stream_files(spark, staged, max_files=files)
    if view_name is None:
        return source
    source.createOrReplaceTempView("events")
    return spark.sql(VIEW_SQL[view_name])


WATERMARK = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)"


def _plain_times(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("str1_stream_span_summary", f"""
SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, run_id, name, count(*) AS count,
       CAST(sum(duration_ns) AS BIGINT) AS total_duration_ns, min(duration_ns) AS min_duration_ns, max(duration_ns) AS max_duration_ns, CAST(sum(thread_cpu_ns) AS BIGINT) AS total_thread_cpu_ns
FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM v_spans) s WHERE w + INTERVAL 1 HOUR <= {WATERMARK} GROUP BY w, run_id, name
""")
def str1(spark, sf_dir):
    """Closed windows only: those the watermark has passed."""
    summary = jobs.run_available(jobs.stream_span_summary(_stream(spark, sf_dir, "v_spans")), "span-summary")
    return _plain_times(summary, "window_start", "window_end")


@query("str2_stream_sliding", f"""
SELECT w AS window_start, w + INTERVAL 2 HOUR AS window_end, event_type, count(*) AS count, {q6("sum(value)")} AS total
FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 60 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 90 MINUTE]) AS w FROM events) e
WHERE w + INTERVAL 2 HOUR <= {WATERMARK} GROUP BY w, event_type
""")
def str2(spark, sf_dir):
    sliding = jobs.run_available(jobs.stream_sliding(_stream(spark, sf_dir), "2 hours", "30 minutes"), "sliding")
    return _plain_times(sliding.withColumn("total", r6("total")), "window_start", "window_end")


@query("str3_stream_sessions", f"""
SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 3 HOUR AS window_end, count(*) AS events FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM events) a) b
GROUP BY user_id, s HAVING max(ts) + INTERVAL 3 HOUR <= {WATERMARK}
""")
def str3(spark, sf_dir):
    sessions = jobs.run_available(jobs.stream_sessions(_stream(spark, sf_dir), "3 hours"), "sessions")
    return _plain_times(sessions, "window_start", "window_end")


@query("str7_slow_queue_waits", "SELECT span_id, duration_ns FROM v_spans WHERE duration_ns >= 200000000")
def str7(spark, sf_dir):
    slow = jobs.slow_queue_waits(_stream(spark, sf_dir, "v_spans"), 200_000_000, column="duration_ns")
    return jobs.run_available(slow.select("span_id", "duration_ns"), "slow-waits")


@query("str8_stream_correlate", """
SELECT q.span_id AS request_id, a.span_id AS response_id FROM v_spans q JOIN v_spans a ON a.run_id = q.run_id AND a.parent_span_id = q.span_id AND a.span_id <> q.span_id
AND a.ts BETWEEN q.ts - INTERVAL 24 HOUR AND q.ts + INTERVAL 24 HOUR
""")
def str8(spark, sf_dir):
    """Spans as requests, their child spans as responses, at most a day apart."""
    spans = _stream(spark, sf_dir, "v_spans")
    again = _stream(spark, sf_dir, "v_spans")
    requests = spans.select("run_id", F.col("span_id").alias("request_id"), F.col("ts").alias("requested"))
    responses = again.filter(F.col("parent_span_id").isNotNull() & (F.col("parent_span_id") != F.col("span_id"))).select(
        "run_id", F.col("parent_span_id").alias("request_id"), F.col("ts").alias("responded"), F.col("span_id").alias("response_id")
    )
    joined = jobs.stream_correlate(requests, responses, "24 HOURS").select("request_id", "response_id")
    return jobs.run_available(joined, "correlate")


@query("str9_stream_dedupe", f"""
SELECT run_id, worker_request_id, arg_min(span_id, ts) AS span_id FROM v_spans WHERE status = 'error' GROUP BY run_id, worker_request_id
HAVING date_trunc('milliseconds', min(ts)) <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM v_spans WHERE status = 'error')
""")
def str9(spark, sf_dir):
    """The earliest error of each request, once over all batches."""
    errors = _stream(spark, sf_dir, "v_spans").filter(F.col("status") == "error")
    once = jobs.stream_dedupe(errors, ["run_id", "worker_request_id"], delay="10 minutes", keep_days=3650)
    return jobs.run_available(once.select("run_id", "worker_request_id", "span_id"), "dedupe")


@query("str5_ordered_emit", f"SELECT key, idx, {q6('x')} AS value FROM v_seq")
def str5(spark, sf_dir):
    """Numbered events, written out of order, leave the stream in order."""
    staged = scratch_path(spark, "numbered")
    view(spark, sf_dir, "v_seq").select("key", "idx", "x").repartition(F.xxhash64("idx") % 7).write.parquet(staged)
    ordered = processors.ordered_emit(jobs.stream_files(spark, staged))
    return jobs.run_available(ordered, "ordered").withColumn("value", r6("value"))


@query("str10_stream_upsert_cache", """
SELECT root, path, n_chars, mtime_ns FROM v_artifacts
""")
def str10(spark, sf_dir):
    """Two versions of every artifact arrive; the newest remains."""
    staged, target = scratch_path(spark, "artifacts"), scratch_path(spark, "cache")
    rows = view(spark, sf_dir, "v_artifacts").select("root", "path", "n_chars", "mtime_ns")
    older = rows.withColumn("mtime_ns", F.col("mtime_ns") - 1).withColumn("n_chars", F.lit(-1).cast("long"))
    rows.unionByName(older).repartition(3, "path").write.parquet(staged)
    stream = jobs.stream_files(spark, staged, max_files=1)
    jobs.stream_upsert_cache(stream, f"{target}/data", f"{target}/checkpoint", version="mtime_ns").awaitTermination()
    return jobs.current_cache(spark, f"{target}/data", version="mtime_ns")


@query("str6_stream_stalled_runs", """
SELECT user_id AS key, before_ms, at_ms FROM (SELECT user_id, epoch_us(ts) // 1000 AS at_ms, lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_ms FROM events) t
WHERE at_ms - before_ms > 86400000 AND at_ms <= (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM events)
""")
def str6_stream(spark, sf_dir):
    gaps = processors.stream_stalled_runs(_stream(spark, sf_dir), 43200, key="user_id")
    return jobs.run_available(gaps, "stalled")


@query("str4_stream_track", f"SELECT video_id, frame_index, scene_id, ambiguous, similarity, place, det_id, x1, y1, x2, y2 FROM ({flat_sql()}) t")
def str4(spark, sf_dir):
    """Frames with their candidates arrive in several files; tracks are carried from batch to batch."""
    from framelens.operators import tracking

    frames, detections, motion = track_inputs(spark, sf_dir)
    config = track_config()
    rows = tracking.tracking_input(frames, tracking.frame_candidates(detections, config), motion, config).join(frames, ["video_id", "frame_index"])
    staged = scratch_path(spark, "frames")
    rows.repartition(3, "frame_index").write.parquet(staged)
    tracked = jobs.run_available(processors.stream_track(jobs.stream_files(spark, staged, max_files=1), config), "track")
    item = F.posexplode_outer("instances").alias("place", "i")
    return tracked.select("video_id", "frame_index", "scene_id", "ambiguous", r6("similarity").alias("similarity"), item).select(
        "video_id", "frame_index", "scene_id", "ambiguous", "similarity", "place", F.col("i.det_id").alias("det_id"), *(r6(f"i.{c}").alias(c) for c in ("x1", "y1", "x2", "y2"))
    )


LOST = "(video_id * 7 + frame_index) % 11 = 4 AND frame_index BETWEEN 1 AND 12"


@query("str4_stream_track_lost", f"""
SELECT video_id, frame_index, scene_id, ambiguous, similarity, place, det_id, x1, y1, x2, y2,
       (SELECT count(*) FROM v_hist h WHERE h.video_id = t.video_id AND h.frame_index = t.frame_index - 1 AND {LOST.replace("video_id", "h.video_id").replace("frame_index", "h.frame_index")}) AS lost_before
FROM ({flat_sql(lost=LOST)}) t WHERE NOT ({LOST})
""")
def str4_lost(spark, sf_dir):
    """Some frames never arrive; those behind them wait two seconds of event time and go on without."""
    from framelens.operators import tracking

    frames, detections, motion = track_inputs(spark, sf_dir)
    frames, config = frames.filter(f"NOT ({LOST})"), track_config()
    rows = tracking.tracking_input(frames, tracking.frame_candidates(detections, config), motion, config).join(frames, ["video_id", "frame_index"])
    staged = scratch_path(spark, "frames")
    timed = rows.withColumn("ts", F.timestamp_seconds(F.col("frame_index") + 1000))
    for part in (0, 1):  # the first ten frames of every video, then the rest
        timed.filter(F.least(F.lit(1), F.floor(F.col("frame_index") / 10)) == part).coalesce(1).write.mode("append").parquet(staged)
    tracked = jobs.run_available(processors.stream_track(jobs.stream_files(spark, staged, max_files=1), config, ts="ts"), "track")
    item = F.posexplode_outer("instances").alias("place", "i")
    return tracked.select("video_id", "frame_index", "scene_id", "ambiguous", r6("similarity").alias("similarity"), "lost_before", item).select(
        "video_id", "frame_index", "scene_id", "ambiguous", "similarity", "place", F.col("i.det_id").alias("det_id"), *(r6(f"i.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")), "lost_before"
    )
