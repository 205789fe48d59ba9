import hashlib
import json

import pytest
from pyspark.sql import functions as F

from framelens.operators import provenance as prv
from framelens.operators import registry
from framelens.sources import readers, writers


@pytest.fixture()
def tree(tmp_path):
    for name, text in (("b.bin", "bb"), ("a/z.bin", "zz"), ("a.bin", "version-one"), ("a-b/y.bin", "yy")):
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path / "tree"


def tree_digest(root):
    digest = hashlib.sha256()
    for child in sorted(p for p in root.rglob("*") if p.is_file()):
        name = child.relative_to(root).as_posix().encode()
        digest.update(len(name).to_bytes(8, "big") + name + hashlib.sha256(child.read_bytes()).digest())
    return digest.hexdigest()


def test_tree_hash_orders_by_path_parts(spark, tree):
    files = readers.scan_artifacts(spark, str(tree))
    assert {r.path for r in files.collect()} == {"b.bin", "a/z.bin", "a.bin", "a-b/y.bin"}
    row = prv.tree_hash(files).collect()[0]
    assert row.tree_sha256 == tree_digest(tree) and row.files == 4


def test_cache_is_used_until_an_artifact_changes(spark, tree):
    def refresh(cache):
        # Size and time are held in literals, so that the fingerprint does not follow the clock.
        files = prv.fingerprint(readers.scan_artifacts(spark, str(tree)).withColumn("mtime_ns", F.lit(1).cast("long")))
        return prv.refresh_hashes(files, cache, F.lit("t"))

    empty = spark.createDataFrame([], "root string, path string, fingerprint string, sha256 string, updated string")
    first = spark.createDataFrame(refresh(empty).collect())
    assert not any(r.hit for r in first.collect())
    again = refresh(first.drop("hit"))
    assert all(r.hit for r in again.collect())
    (tree / "a.bin").write_text("version-two-is-longer")
    changed = {r.path: r for r in refresh(first.drop("hit")).collect()}
    assert [p for p, r in changed.items() if not r.hit] == ["a.bin"]
    assert changed["a.bin"].sha256 == hashlib.sha256(b"version-two-is-longer").hexdigest()
    (tree / "b.bin").unlink()
    assert "b.bin" in {r.path for r in refresh(first.drop("hit")).collect()}


def test_audit(spark):
    rows = [(False, True, False, False), (True, False, False, False), (True, True, False, False), (True, True, True, False), (True, True, True, True)]
    df = spark.createDataFrame(rows, "enabled boolean, required boolean, tool_found boolean, signed boolean")
    got = [(r.status, r.failed) for r in prv.provenance_audit(df).collect()]
    assert got == [("disabled", False), ("skipped", False), ("skipped", True), ("error", True), ("embedded", False)]


def test_manifest_documents(spark, tmp_path):
    rows = [(1, "output", "out/clip.mp4", None, "file"), (1, "input", "in.mp4", "i" * 64, "file"), (1, "source", "s/b.png", "b" * 64, "file"),
            (1, "source", "s/a.png", "a" * 64, "file"), (1, "model", "m.onnx", None, "file")]
    df = spark.createDataFrame(rows, "output_id long, role string, path string, sha256 string, kind string")
    made = prv.build_manifests(df, created=F.lit("now")).collect()[0]
    document = json.loads(made.document)
    assert made.manifest == "clip.manifest.json"
    assert document["output_video"] == {"path": "out/clip.mp4", "sha256": None}
    assert [s["path"] for s in document["source_images"]] == ["s/a.png", "s/b.png"]
    assert document["model"]["sha256"] == "skipped" and document["additional_models"] == []
    assert document["target_reference"] is None
    target = str(tmp_path / "manifests")
    for _ in range(2):
        writers.write_manifests(prv.build_manifests(df, created=F.lit("now")), target)
    written = writers.read_documents(spark, target).collect()
    assert len(written) == 1 and written[0].name == "clip.manifest.json" and json.loads(written[0].document)["schema"] == prv.MANIFEST_SCHEMA
    more = spark.createDataFrame([("clip.manifest.json", "{}"), ("other.json", "[]")], "name string, document string")
    writers.write_documents(more, target, name="name")
    assert {(r.name, r.document) for r in writers.read_documents(spark, target).collect()} == {("clip.manifest.json", "{}"), ("other.json", "[]")}


def test_manifests_list_every_source_in_the_order_given(spark):
    rows = [(1, "source", f"s/{i}.png", None, "file", -i) for i in range(90)] + [(1, "additional", f"m/{i}", None, "file", i) for i in range(70)] + [(1, "output", "o.mp4", None, "file", 0)]
    df = spark.createDataFrame(rows, "output_id long, role string, path string, sha256 string, kind string, position long")
    document = json.loads(prv.build_manifests(df, created=F.lit("now"), position="position").first().document)
    assert [s["path"] for s in document["source_images"]] == [f"s/{i}.png" for i in range(89, -1, -1)]
    assert [s["path"] for s in document["additional_models"]] == [f"m/{i}" for i in range(70)]


def test_credentials_are_json(spark):
    df = spark.createDataFrame([("clip.mp4", "in.mp4", "authorized", "some-model")], "name string, input_path string, operation string, backend string")
    document = json.loads(prv.content_credentials(df, created=F.lit("now")).collect()[0].credentials)
    assert [a["label"] for a in document["assertions"]] == ["c2pa.actions.v2", "org.framelens.provenance", "stds.schema-org.CreativeWork"]
    assert document["ingredient_paths"] == ["in.mp4"]


def test_output_names_skip_taken_ones(spark):
    df = spark.createDataFrame([(i, "clip") for i in range(5)], "n long, stem string")
    taken = spark.createDataFrame([("clip_x_s.mp4",), ("clip_x_s_3.mp4",), ("clip_x_s_4.mp4",), ("other_x_s.mp4",)], "name string")
    names = lambda **o: [r.output_name for r in prv.assign_output_names(df, stem=F.col("stem"), tag="x", stamp=F.lit("s"), order="n", **o).orderBy("n").collect()]
    assert names() == ["clip_x_s.mp4"] + [f"clip_x_s_{i}.mp4" for i in (2, 3, 4, 5)]
    assert names(existing=taken) == [f"clip_x_s_{i}.mp4" for i in (2, 5, 6, 7, 8)]


def test_list_media(spark, tmp_path):
    for name in ("b/2.JPG", "a/9.png", "a.webp", "note.txt", "b/1.jpeg"):
        path = tmp_path / "media" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    listed = [r.path.split("/media/")[1] for r in readers.list_media(spark, str(tmp_path / "media"), 3).collect()]
    assert listed == ["a/9.png", "a.webp", "b/1.jpeg"]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.txt").write_text("x")
    with pytest.raises(ValueError, match="no images"):
        readers.list_media(spark, str(tmp_path / "empty"), 3)


def test_event_lines(spark, tmp_path):
    path = tmp_path / "profile.jsonl"
    path.write_text('{"timestamp":"t","run_id":"r","event":"span","thread":"m","process_id":7,"name":"x","duration_ns":5}\nbroken\n')
    rows = readers.read_events(spark, str(path)).select("event", "process_id", F.try_variant_get("extra", "$.duration_ns", "long").alias("d")).collect()
    assert sorted((r.event or "", r.process_id, r.d) for r in rows) == [("", None, None), ("span", 7, 5)]


def test_worker_lines(spark):
    lines = ['PROFILE {"event":"span","level":"info"}', "LOG [1]", "LOG {", 'RESULT {"ok":true}', "hello", "PROFILE {}\r\n"]
    df = readers.read_worker_lines(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, line string"))
    rows = {r.i: r for r in df.select("i", "class", "raw").collect()}
    assert [rows[i]["class"] for i in range(6)] == ["profile", "quarantine", "quarantine", "result", "passthrough", "profile"]
    assert rows[2].raw == "LOG {"
    normal = {r.i: r for r in readers.normalize_worker_event(df).collect()}
    assert normal[0].level == "INFO" and normal[5].level == "WARNING" and normal[5].event == "worker_event"


def test_detector_table_function(spark):
    def factory():
        return lambda content: [{"x1": float(len(content)), "det_score": 0.9}]

    spark.udtf.register("detect_test", registry.detector_udtf(factory))
    spark.createDataFrame([(1, bytearray(b"abc"))], "id long, content binary").createOrReplaceTempView("images_test")
    row = spark.sql("SELECT id, d.x1, d.det_score, d.y1 FROM images_test, LATERAL detect_test(content) d").collect()[0]
    assert tuple(row) == (1, 3.0, 0.9, None)


def test_a_failed_write_leaves_the_old_documents(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "docs")
    show = lambda: {(r.name, r.document) for r in writers.read_documents(spark, target).collect()}
    frame = lambda rows: spark.createDataFrame(rows, "name string, document string")
    assert show() == set()
    writers.write_documents(frame([(f"n{i}", "x" * 50) for i in range(40)]), target, name="name", shard_bytes=500)
    first = show()
    assert len(first) == 40 and len(writers._version(spark, target)["shards"]) == 5
    broken = frame([("n1", "new"), ("n2", "new")]).withColumn("document", F.expr("CASE WHEN name = 'n2' THEN raise_error('killed') ELSE document END"))
    with pytest.raises(Exception, match="killed"):
        writers.write_documents(broken, target, name="name", shard_bytes=500)
    assert show() == first
    # killed after the files are written, before the step
    with monkeypatch.context() as patch:
        patch.setattr(writers, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError, match="stopped"):
            writers.write_documents(frame([("n1", "new")]), target, name="name", shard_bytes=500)
    assert show() == first
    seen = writers._version(spark, target)
    writers.write_documents(frame([("n1", "new"), ("m", "{}")]), target, name="name", shard_bytes=500)
    assert show() == (first - {("n1", "x" * 50)}) | {("n1", "new"), ("m", "{}")}
    with pytest.raises(RuntimeError, match="meanwhile"):  # a writer that read the version before
        writers._commit(spark, target, seen, seen)
    writers.write_documents(frame([(f"k{i}", "y" * 50) for i in range(400)]), target, name="name", shard_bytes=500)
    assert len(show()) == 441 and len(writers._version(spark, target)["shards"]) > 20
    writers.write_documents(frame([]), target, name="name", shard_bytes=500)
    assert len(show()) == 441
