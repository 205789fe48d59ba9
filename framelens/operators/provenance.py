"""Content hashes, hash caches, manifests and audits.

Artifact rows are (root, path, content, size, mtime_ns); ``content`` is BINARY or STRING.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens import __version__
from framelens.functions import manifest_path, output_name, path_parts
from framelens.operators import ordered

# Schema names, statuses and vocabulary of the documents written.
MANIFEST_SCHEMA = "framelens-manifest-v2"
QUALITY_SCHEMA = "framelens-quality-v1"
DISCLOSURE = "SYNTHETIC CONTENT - AI"
SOURCE_TYPE = "http://cv.iptc.org/newscodes/digitalsourcetype/compositeWithTrainedAlgorithmicMedia"


def content_hash(artifacts: DataFrame, *, content: str = "content", name: str = "sha256") -> DataFrame:
    return artifacts.withColumn(name, F.sha2(F.col(content).cast("binary"), 256))


def file_fingerprint(size: Column, mtime_ns: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit("file"), size.cast("string"), mtime_ns.cast("string")), 256)


def fingerprint(artifacts: DataFrame, *, size: str = "size", name: str = "fingerprint") -> DataFrame:
    return artifacts.withColumn(name, file_fingerprint(F.col(size), F.col("mtime_ns")))


def _digest_tree(rows: DataFrame, chunk: str, root: str, name: str) -> DataFrame:
    """SHA-256 over the binary chunks of each root in path-part order.

    Hashing the files themselves is spread over the cluster; only one short chunk per file reaches this fold,
    which holds a running digest and one Arrow batch. SHA-256 is a chain, so one root is one chain.
    """
    root_type = rows.schema[root].dataType.simpleString()

    def begin(key):
        return [key[0], hashlib.sha256(), 0]

    def step(state, row):
        state[1].update(row[0])
        state[2] += 1
        return ()

    def finish(state):
        return [(state[0], state[1].hexdigest(), state[2])]

    return ordered.fold_sorted(
        rows.withColumn("_parts", path_parts(F.col("path"))), [root], ["_parts"], [chunk], begin, step,
        f"`{root}` {root_type}, {name} string, files long", finish=finish,
    )


def tree_hash(artifacts: DataFrame, *, root: str = "root", content: str = "content", name: str = "tree_sha256"):
    """Reproducible hash of a file tree: per file an 8-byte path length, the path and the raw content hash."""
    encoded = F.encode(F.col("path"), "UTF-8")
    length = F.unhex(F.lpad(F.hex(F.octet_length("path").cast("long")), 16, "0"))
    chunk = F.concat(length, encoded, F.unhex(F.sha2(F.col(content).cast("binary"), 256)))
    return _digest_tree(artifacts.select(root, "path", chunk.alias("_chunk")), "_chunk", root, name)


def tree_fingerprint(artifacts: DataFrame, *, root: str = "root", size: str = "size", name: str = "fingerprint"):
    text = F.concat(
        F.col("path"), F.lit(":"), F.col(size).cast("string"), F.lit(":"), F.col("mtime_ns").cast("string")
    )
    chunk = F.encode(text, "UTF-8")
    return _digest_tree(artifacts.select(root, "path", chunk.alias("_chunk")), "_chunk", root, name)


def hash_cache_lookup(artifacts: DataFrame, cache: DataFrame, *, keys: Sequence[str] = ("root", "path")) -> DataFrame:
    """Adds ``cached_sha256``: the cached digest of the same key and fingerprint, null on a miss."""
    keys = list(keys)
    usable = cache.filter(F.length("sha256") == 64).select(
        *keys, "fingerprint", F.col("sha256").alias("cached_sha256")
    )
    return artifacts.join(usable, [*keys, "fingerprint"], "left")


def refresh_hashes(
    artifacts: DataFrame, cache: DataFrame, updated: Column, *, keys: Sequence[str] = ("root", "path"),
    content: str = "content",
) -> DataFrame:
    """The cache after a run: hits keep their digest, misses are hashed, entries of absent artifacts stay.

    Content of hits is never hashed.
    """
    keys = list(keys)
    looked = hash_cache_lookup(artifacts, cache, keys=keys)
    digest = F.coalesce("cached_sha256", F.when(F.col("cached_sha256").isNull(), F.sha2(F.col(content).cast("binary"), 256)))
    fresh = looked.select(
        *keys, "fingerprint", digest.alias("sha256"),
        F.when(F.col("cached_sha256").isNull(), updated).alias("_updated"), F.col("cached_sha256").isNotNull().alias("hit"),
    )
    old = cache.select(*keys, F.col("updated").alias("_old_updated"))
    current = fresh.join(old, keys, "left").select(
        *keys, "fingerprint", "sha256", F.coalesce("_updated", "_old_updated").alias("updated"), "hit"
    )
    absent = cache.join(artifacts.select(*keys), keys, "left_anti").select(
        *keys, "fingerprint", "sha256", "updated", F.lit(None).cast("boolean").alias("hit")
    )
    return current.unionByName(absent)


def model_records(
    artifacts: DataFrame, mode: str, *, cache_path: str | None = None, is_directory: Column | None = None
) -> DataFrame:
    """STRUCT ``record`` per model: path, kind, sha256 (or ``skipped``) and the cache used."""
    if mode not in ("hash", "cached", "skip"):
        raise ValueError("mode must be hash, cached or skip")
    digest = F.lit("skipped") if mode == "skip" else F.col("sha256")
    kind = F.lit("file") if is_directory is None else F.when(is_directory, "directory").otherwise("file")
    used = F.lit(cache_path if mode == "cached" else None).cast("string")
    return artifacts.withColumn(
        "record",
        F.struct(F.col("path"), kind.alias("kind"), digest.alias("sha256"), used.alias("hash_cache")),
    )


def build_manifests(
    artifacts: DataFrame, *, key: str = "output_id", created: Column, disclosure: bool = True, position: str | None = None,
    runtime: Column | None = None, status: Column | None = None,
) -> DataFrame:
    """One JSON document per output from artifact rows (output_id, role, path, sha256, kind).

    Roles: output, input, target, source, model, additional. A missing output file has a null hash. Every
    source and model is listed, in the order of the column ``position``, or of the paths where none is given.
    """
    entry = F.struct("path", "sha256")
    record = F.struct("path", F.coalesce("kind", F.lit("file")).alias("kind"), F.coalesce("sha256", F.lit("skipped")).alias("sha256"))
    place = F.struct(*([F.col(position).alias("at")] if position else []), path_parts(F.col("path")).alias("parts"))
    rows = artifacts.withColumn("_at", place)
    one = lambda role, value: F.min_by(F.when(F.col("role") == role, value), F.when(F.col("role") == role, F.col("_at")))
    many = lambda role, value: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct(F.col("_at"), value.alias("e"))))),
        lambda x: x["e"],
    )
    grouped = rows.groupBy(key).agg(
        one("output", entry).alias("output_video"), one("input", entry).alias("input_video"),
        one("target", entry).alias("target_reference"), many("source", entry).alias("source_images"),
        one("model", record).alias("model"), many("additional", record).alias("additional_models"),
    )
    not_requested = F.struct(F.lit(False).alias("enabled"), F.lit("not_requested").alias("status"))
    document = F.struct(
        F.lit(MANIFEST_SCHEMA).alias("schema"),
        F.struct(F.lit("framelens").alias("name"), F.lit(__version__).alias("version")).alias("project"),
        created.alias("created_utc"),
        F.struct(
            F.lit(disclosure).alias("visible"), F.lit(DISCLOSURE if disclosure else None).cast("string").alias("text")
        ).alias("disclosure"),
        (not_requested if status is None else status).alias("credentials"),
        "output_video", "input_video", "target_reference", "source_images", "model", "additional_models",
        (F.struct(F.lit(__version__).alias("engine")) if runtime is None else runtime).alias("runtime"),
    )
    return grouped.select(
        key, manifest_path(F.col("output_video.path")).alias("manifest"),
        F.to_json(document, {"ignoreNullFields": "false"}).alias("document"),
    )


def provenance_audit(requests: DataFrame) -> DataFrame:
    """Adds ``status`` and ``failed`` from enabled, required, tool_found and signed."""
    status = (
        F.when(~F.col("enabled"), F.lit("disabled"))
        .when(~F.col("tool_found"), F.lit("skipped"))
        .when(~F.col("signed"), F.lit("error"))
        .otherwise(F.lit("embedded"))
    )
    failed = F.col("required") & status.isin("skipped", "error")
    return requests.withColumns({"status": status, "failed": failed})


def audit_counts(audited: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    return audited.groupBy(*keys, "status").agg(
        F.count(F.lit(1)).alias("outputs"), F.count(F.when(F.col("failed"), 1)).alias("failures")
    )


def content_credentials(df: DataFrame, *, created: Column, algorithm: str = "es256") -> DataFrame:
    """Adds ``credentials``: the unsigned assertion document of each output (name, input_path, operation, backend).

    ``synthetic_media`` (boolean), ``description`` and ``model_capabilities`` (any type) are stated as far as the
    table has these columns: a document says what its row says, and nothing else.
    """
    stated = lambda name: [F.col(name)] if name in df.columns else []
    agent = F.struct(F.lit("framelens").alias("name"), F.lit(__version__).alias("version"))
    action = F.struct(
        F.lit("c2pa.created").alias("action"), F.lit(SOURCE_TYPE).alias("digitalSourceType"), agent.alias("softwareAgent")
    )
    actions = F.struct(
        F.lit("c2pa.actions.v2").alias("label"),
        F.struct(F.array(action).alias("actions"), F.lit(True).alias("allActionsIncluded")).alias("data"),
    )
    origin = F.struct(
        F.lit("org.framelens.provenance").alias("label"),
        F.struct(
            *stated("synthetic_media"), F.col("operation"), F.col("backend").alias("model_backend"), *stated("model_capabilities"),
            created.alias("created_utc"),
        ).alias("data"),
    )
    work = F.struct(
        F.lit("stds.schema-org.CreativeWork").alias("label"),
        F.struct(
            F.lit("https://schema.org").alias("@context"), F.lit("VideoObject").alias("@type"), F.col("name"),
            *stated("description"),
        ).alias("data"),
    )
    # The three assertions differ in shape, so each is rendered on its own and the list is joined as text.
    listed = F.concat(F.lit("["), F.concat_ws(",", F.to_json(actions), F.to_json(origin), F.to_json(work)), F.lit("]"))
    head = F.to_json(
        F.struct(
            F.lit(algorithm).alias("alg"), F.lit(f"framelens/{__version__}").alias("claim_generator"),
            F.col("name").alias("title"), F.array("input_path").alias("ingredient_paths"),
        )
    )
    document = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"assertions":'), listed, F.lit("}"))
    return df.withColumn("credentials", document)


def cache_valid(
    entries: DataFrame, *, requested: Column, width: int, height: int, fps: float, tolerance: float = 0.05
) -> DataFrame:
    ok = (
        (F.col("bytes") > 0) & (F.col("frame_count") >= requested) & (F.col("width") == width)
        & (F.col("height") == height) & (F.abs(F.col("fps") - fps) <= tolerance)
    )
    return entries.withColumn("usable", F.coalesce(ok, F.lit(False)))


def stale_entries(
    cache: DataFrame, keep: int, *, keys: Sequence[str] = ("root",), entry: str = "path", mtime: str = "mtime_ns",
    current: Column | None = None,
) -> DataFrame:
    """All but the ``keep`` newest entries of each root, never the current one.

    The ranking keeps ``keep`` rows per root before the shuffle; everything else is an anti-join.
    """
    keys = list(keys)
    newest = Window.partitionBy(*keys).orderBy(F.col(mtime).desc(), F.col(entry).asc())
    kept = cache.select(*keys, entry, mtime).withColumn("_rank", F.row_number().over(newest)).filter(
        F.col("_rank") <= max(1, int(keep))
    ).select(*keys, entry)
    stale = cache.join(kept, [*keys, entry], "left_anti")
    return stale if current is None else stale.filter(~current)


def expected_vs_present(expected: DataFrame, present: DataFrame, *, group: str = "root", item: str = "slot"):
    """Per group: how many expected items, which are missing, and whether it is complete.

    ``expected`` is a short list per group, so the list of what is missing is short as well.
    """
    found = present.select(group, item).distinct().withColumn("_found", F.lit(True))
    checked = expected.select(group, item).distinct().join(found, [group, item], "left")
    here = F.coalesce("_found", F.lit(False))
    return checked.groupBy(group).agg(
        F.count(F.lit(1)).alias("expected"), F.count(F.when(~here, 1)).alias("missing_count"),
        F.array_sort(F.collect_list(F.when(~here, F.col(item)))).alias("missing"), F.bool_and(here).alias("ready"),
    )


def assign_output_names(
    requests: DataFrame, *, stem: Column, tag: str, stamp: Column, order: str, existing: DataFrame | None = None,
    explicit: Column | None = None, suffix: str = ".mp4",
) -> DataFrame:
    """Adds ``output_name``: the explicit name, or ``stem_tag_stamp`` with _2, _3, … so that none repeats.

    ``existing`` lists taken names (column ``name``). The n-th request of a base name takes the n-th free
    number; both numberings are two-level, since a few base names may cover all rows. ``order`` is an
    integer column that sorts the requests.
    """
    base = F.concat_ws("_", stem, F.lit(tag), stamp)
    named = requests.withColumn("_base", base)
    given = F.lit(None).cast("string") if explicit is None else output_name(explicit, suffix)
    named = named.withColumn("_given", given)
    fixed = named.filter(F.col("_given").isNotNull()).withColumn("output_name", F.col("_given"))
    free = named.filter(F.col("_given").isNull())
    numbered = ordered.ordered_index(free, ["_base"], order, ordered.frame_bucket(order), "_n")
    if existing is None:
        number = F.col("_n") + 1
    else:
        # Position of a taken number among the free ones: how many free numbers lie below it.
        parsed = existing.select(
            F.regexp_extract("name", r"^(.*?)(?:_(\d+))?" + suffix.replace(".", r"\.") + "$", 1).alias("_base"),
            F.regexp_extract("name", r"^(.*?)(?:_(\d+))?" + suffix.replace(".", r"\.") + "$", 2).alias("_k"),
        )
        whole = existing.select(F.regexp_replace("name", suffix.replace(".", r"\.") + "$", "").alias("_base"))
        taken = parsed.filter(F.col("_k").rlike("^([2-9]|[1-9][0-9]+)$")).select(
            "_base", F.col("_k").cast("long").alias("_k")
        ).unionByName(whole.withColumn("_k", F.lit(1).cast("long"))).distinct()
        taken = ordered.ordered_index(taken, ["_base"], "_k", ordered.frame_bucket("_k"), "_j")
        marks = taken.select("_base", (F.col("_k") - F.col("_j") - 1).alias("_pos"), F.lit(1).alias("_taken"))
        asks = numbered.select("_base", F.col("_n").alias("_pos"), F.lit(0).alias("_taken"))
        # A request for free position n comes after all taken numbers with at most n free ones below.
        both = marks.unionByName(asks).withColumn("_last", 1 - F.col("_taken"))
        counted = ordered.ordered_running_sum(
            both, ["_base"], ["_pos", "_last"], ordered.frame_bucket("_pos"), F.col("_taken").cast("long"), "_skipped"
        ).filter(F.col("_taken") == 0).select("_base", F.col("_pos").alias("_n"), "_skipped")
        numbered = numbered.join(counted, ["_base", "_n"])
        number = F.col("_n") + 1 + F.col("_skipped")
    tail = F.when(number == 1, F.lit("")).otherwise(F.concat(F.lit("_"), number.cast("string")))
    made = numbered.withColumn("output_name", F.concat("_base", tail, F.lit(suffix)))
    return made.select(*requests.columns, "output_name").unionByName(fixed.select(*requests.columns, "output_name"))
