"""Line dedup: lines that many documents share go, but for one document each.

Explode normalised lines, hash, count distinct documents per hash, drop the lines over the threshold and reassemble
the rest by position. A line's key is the line without white space at its ends and with A-Z lower-cased.

Scale: one row per distinct long line and document leaves the scan (two 64-bit hashes and the id, no text); counts are
combined before the shuffle, so a line that a third of all documents hold is one row per task, and the join with the
shared lines is one whose large partitions Spark splits. Texts move once, to meet the lines they lose.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelens.llm.common import SPACES, one_row_per_id, outer_id, save

MIN_CHARS = 40
MIN_DOCUMENTS = 5


def _key(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """Hash of a line's key, if the key is long enough."""
    line = line.strip(SPACES)
    if len(line) < min_chars:
        return None
    line = line.lower()  # of bytes: A-Z only
    if len(line) < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars:
        return None
    whole = xxhash.xxh3_128_intdigest(line)
    return _long(whole >> 64), _long(whole)


def _long(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, high, low = [], [], []
            for doc, text in zip(batch.column("_id").to_pylist(), batch.column("value")):
                text = (text.as_py() or "").encode()
                if len(text) < min_chars:
                    continue
                for a, b in {k for k in (_key(x, min_chars) for x in text.split(b"\n")) if k}:
                    ids.append(doc), high.append(a), low.append(b)
            yield pa.RecordBatch.from_pydict({"_id": ids, "h1": high, "h2": low}, schema=schema)

    schema = pa.schema([("_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
    return docs.mapInArrow(task, "_id long, h1 long, h2 long")


def _rewrite(docs: DataFrame, min_chars: int) -> DataFrame:
    """docs: columns, ``value, drop`` (hashes of the keys to drop, or null); out: those columns, ``text, n_lines, n_dropped``."""
    kept = docs.drop("value", "drop")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, drop in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_pylist()):
                own = (text.as_py() or "").encode().split(b"\n")
                gone = {(x["h1"], x["h2"]) for x in drop or ()}
                left = [x for x in own if not gone or _key(x, min_chars) not in gone]
                texts.append(b"\n".join(left).decode()), lines.append(len(own)), dropped.append(len(own) - len(left))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                names=[*batch.schema.names[:-2], "text", "n_lines", "n_dropped"],
            )

    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL("text string, n_lines long, n_dropped long").fields])
    return docs.select(*kept.columns, "value", "drop").mapInArrow(task, schema)


def dedup_lines(documents: DataFrame, *, keep: tuple[str, ...] = (), min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``_id``, the columns to ``keep``, ``text, n_lines, n_dropped`` of every document; ``text`` without the dropped lines.

    Lines are split at ``\\n``. A null or empty text is one empty line. A key of at least ``min_chars`` code points in
    at least ``min_documents`` documents loses all its lines except in the largest id that holds it (there all its
    lines stay). Rows that share an id count as one document, see ``one_row_per_id``; a null id is the smallest.
    A document whose lines all go has an empty text. Other columns are not read. An empty table gives no rows.
    """
    docs = one_row_per_id(documents, "doc_id", "text", keep)
    keys = save(_line_keys(docs.select("_id", "value"), min_chars), "line-keys")
    counted = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("_id").alias("keep"))
    shared = save(counted.where(F.col("n") >= min_documents).select("h1", "h2", "keep"), "line-shared")
    drops = keys.join(shared, ["h1", "h2"]).where("_id <> keep").groupBy("_id").agg(F.collect_list(F.struct("h1", "h2")).alias("drop"))
    return _rewrite(docs.join(drops.hint("shuffle_hash"), "_id", "left"), min_chars)


def digest(documents: DataFrame) -> DataFrame:
    return dedup_lines(documents).select(outer_id().alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), shared AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, shared.k IS NOT NULL AND doc_id <> keep AS gone FROM keyed LEFT JOIN shared ON keyed.k = shared.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
