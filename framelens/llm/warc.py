"""WARC archives: written record by record, found again by an index.

Index first: while a task writes its archive file it notes file, offset, length, URL and digest of every record. Reading
selects rows of the index, sorts them by place, joins neighbouring byte ranges into one read and cuts the records out
of it. Each record is a gzip member of its own, as the format asks for, so a range can be read alone.

A task writes under a name of its own (a retry writes another file), and only files named by the index of finished
tasks count; the index is written by Spark's commit. Files go through ``pyarrow.fs`` to the folder given, which must
be one that all executors share.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import save
from framelens.session import scratch_path

#: Neighbouring ranges at most so far apart are read at once, up to about so many bytes.
GAP, READ = 1 << 16, 8 << 20
#: Bytes of archives that one task reads.
TASK_BYTES = 8 << 20
_INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string, refers_to long"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _identity(page_id, n: int, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{n}/{digest}')}"


def _record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One record with CRLF header lines. The profile and the referred page are told only on revisits."""
    body = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_identity(page_id, len(payload), digest)}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{_identity(refers_to, len(payload), digest)}>", f"WARC-Refers-To-Page-ID: {refers_to}",
        ]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def _parse(member: bytes) -> tuple[dict[str, str], bytes]:
    whole = zlib.decompress(member, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write one record per row of ``pages (page_id, url, html)`` below ``folder``; the index of the records.

    Payload: the html in UTF-8, a null one is empty. Of rows with equal payloads (SHA-1 and length) those with the
    largest ``page_id`` are responses, the others revisits that name it. A null ``page_id`` is below all others; rows
    that repeat the largest id are responses too. A null ``url`` leaves its header line out. Other columns are not
    read; an empty table gives an empty index. Only digests and ids are grouped, combined before the shuffle; the
    html moves once, in a join whose large partitions Spark splits.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "size": F.octet_length("html")})
    least = F.lit(-(2**63))
    newest = rows.groupBy(F.col("digest").alias("d"), F.col("size").alias("n")).agg(F.max(F.coalesce("page_id", least)).alias("target"))
    typed = rows.join(newest.hint("shuffle_hash"), (rows.digest == newest.d) & (rows["size"] == newest.n)).select("page_id", "url", "html", "digest", "target")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, offset, path = None, 0, f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            found = []
            for page_id, url, html, digest, target in zip(*batch.columns):
                page_id, url, payload, digest, target = page_id.as_py(), url.as_py(), html.as_py().encode(), _base32(digest.as_py()), target.as_py()
                kind = "response" if (page_id if page_id is not None else -(2**63)) == target else "revisit"
                refers_to = target if kind == "revisit" else None
                record = _record(page_id, url, payload, digest, kind, refers_to)
                if out is None:
                    system, at = _open(path)
                    system.create_dir(at.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(at, compression=None)
                out.write(record)
                found.append((page_id, url, path, offset, len(record), digest, kind, refers_to))
                offset += len(record)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*found) if found else [()] * 8, kinds)], names=names)
        if out is not None:
            out.close()

    names = [x.split()[0] for x in _INDEX.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in _INDEX.split(", ")]
    return save(typed.mapInArrow(task, _INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload`` of the records an index selects.

    Rows are sorted by file and offset across tasks; a task joins ranges with gaps of at most ``GAP`` bytes into reads
    of about ``READ`` bytes. A response whose payload does not fit its digest fails the read. Revisits have no payload
    of their own: ``payload`` is null, length and digest are those of the full payload.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            first = 0
            while first < len(files):
                last, end = first, offsets[first] + lengths[first]
                while last + 1 < len(files) and files[last + 1] == files[first] and offsets[last + 1] - end <= GAP and offsets[last + 1] + lengths[last + 1] - offsets[first] <= READ:
                    last += 1
                    end = max(end, offsets[last] + lengths[last])
                if opened != files[first]:
                    if source is not None:
                        source.close()
                    system, at = _open(files[first])
                    opened, source = files[first], system.open_input_file(at)
                block = source.read_at(end - offsets[first], offsets[first])
                found = [_read(block[offsets[i] - offsets[first] :][: lengths[i]]) for i in range(first, last + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*found), kinds)], names=names)
                first = last + 1
        if source is not None:
            source.close()

    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    # the rows of an index are small whatever the records behind them are, so tasks are dealt out by the bytes to read
    size = index.agg(F.sum("length")).first()[0] or 0
    chosen = index.select("file", "offset", "length").repartitionByRange(max(1, -(-size // TASK_BYTES)), "file", "offset")
    placed = chosen.sortWithinPartitions("file", "offset")
    return placed.mapInArrow(task, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def _read(member: bytes) -> tuple:
    fields, payload = _parse(member)
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not fit its digest")
    page_id, refers_to = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID")
    return (
        None if page_id is None else int(page_id), fields.get("WARC-Target-URI"), kind, None if refers_to is None else int(refers_to),
        digest, int(fields["WARC-Payload-Length"]), payload if kind == "response" else None,
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives to the shared folder, read every record back, and tell what was read."""
    index = write_archives(pages, scratch_path(pages.sparkSession, "warc"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
digits AS (
  SELECT page_id, html, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
           (((strpos('0123456789abcdef', substr(h, 1 + (i * 5) // 4, 1)) - 1) * 16
             + greatest(strpos('0123456789abcdef', substr(h, 2 + (i * 5) // 4, 1)) - 1, 0)) >> (3 - (i * 5) % 4)) & 31)::INT, 1)
           FOR i IN range(32)], '') AS b32
  FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = max(page_id) OVER w THEN NULL ELSE max(page_id) OVER w END AS refers_to
FROM digits WINDOW w AS (PARTITION BY html)
"""
