"""Divergence of sources within a language: how differently they use the language's common terms.

Terms are counted where the text lies. In a task they are packed by length: up to eight bytes become one machine word,
up to sixteen two; they are sorted by radix and counted by runs. Longer terms go to one bucket per length, sorted by their
bytes. A task deals its documents out by group first and the sort is stable, so a run holds its documents side by side
and one pass gives both the number of occurrences and that of documents. Only counts are shuffled, first by (lang, term,
source), then by (lang, term).

The summed differences of all pairs of sources are an output of squared size by contract. They are found bucket of terms by
bucket: a bucket holds the shares of some hundred terms, sent sparsely, and large sets of sources are cut into blocks, so
a task holds two blocks of one bucket. Numbers are whole numbers throughout.

Nulls count as empty texts; every row counts as a document of its own, also where ids repeat or are null. An empty table
gives no row; a language with one source gives no pairs; one without common terms gives pairs of value 0 and no terms.
Terms of any length count whole. Other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import flat_text, forget, join_by_size, lean, runs_of_documents, save
from framelens.llm.terms import LETTERS, eights, lowered, packed, radix_order, spans

MIN_DOCUMENTS, TOP, SMOOTHING, UNIT = 30, 50, 5, 1_000_000_000
#: Bytes of text counted at once, terms in a bucket, sources in a block.
BLOCK, BUCKET, SOURCES = 8 << 20, 128, 256


# --- counting -------------------------------------------------------------------------------------------------------


def count_runs(changes: list[np.ndarray], group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, occurrences and documents of every run of equal terms and groups, in sorted order."""
    new = np.zeros(len(group), bool)
    new[:1] = True
    for words in [*changes, group]:
        new[1:] |= words[1:] != words[:-1]
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(group))), np.add.reduceat(other, first, dtype=np.int64) if len(first) else first


def count_terms(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, length, group, occurrences and documents of every (term, group); documents lie in order of groups."""
    starts, lengths, doc = spans(data, offsets, LETTERS)
    of, view, found = group[doc], eights(data), []

    def add(held: np.ndarray, words: list[np.ndarray], order: np.ndarray) -> None:
        at = held[order]
        first, n, docs = count_runs([w[order] for w in words], of[at], doc[at])
        found.append((starts[at[first]], lengths[at[first]], of[at[first]], n, docs))

    for count, held in ((1, np.flatnonzero(lengths <= 8)), (2, np.flatnonzero((lengths > 8) & (lengths <= 16)))):
        words = [packed(view, starts[held], lengths[held], i) for i in range(count)]
        add(held, words, radix_order(*words))
    long = np.flatnonzero(lengths > 16)
    by_length = long[np.argsort(lengths[long], kind="stable")]
    for held in np.split(by_length, np.flatnonzero(np.diff(lengths[by_length])) + 1) if len(by_length) else ():
        size = int(lengths[held[0]])
        whole = np.array([data[s : s + size].tobytes() for s in starts[held]], f"S{size}")
        add(held, [whole], np.argsort(whole, kind="stable"))
    return tuple(np.concatenate(columns) for columns in zip(*found))


def _strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.cumsum(lengths)
    content = data[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(content))


def _texts(*columns: str) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term in every group."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = pa.table({"lang": batch.column("lang"), "source": batch.column("source"), "at": np.arange(batch.num_rows)})
            rows = batch.take(keys.sort_by([("lang", "ascending"), ("source", "ascending")]).column("at").combine_chunks())
            langs, sources = rows.column("lang"), rows.column("source")
            codes = [c.dictionary_encode().indices.to_numpy() for c in (langs, sources)]
            group = np.append(0, np.cumsum((np.diff(codes[0]) != 0) | (np.diff(codes[1]) != 0)))
            data, offsets = flat_text(rows.column("text"))
            for a, b in runs_of_documents(offsets, BLOCK):
                block = lowered(data[offsets[a] : offsets[b]])
                starts, lengths, of, n, seen = count_terms(block, offsets[a : b + 1] - offsets[a], group[a:b])
                if len(starts):
                    row = pa.array(np.searchsorted(group, of))
                    yield pa.RecordBatch.from_arrays(
                        [langs.take(row), sources.take(row), _strings(block, starts, lengths).cast(pa.string()), pa.array(n.astype(np.int64)), pa.array(seen)],
                        names=["lang", "source", "term", "n", "docs"],
                    )

    counted = docs.select(*_texts("text", "lang", "source")).mapInArrow(lean(task), "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# --- shares ---------------------------------------------------------------------------------------------------------


def _share(count: str, total: str) -> Column:
    """``1 + floor(UNIT * (count + 5) / (total + 5 * terms))`` in whole numbers, given common ``terms``."""
    above = f"CAST({count} + {SMOOTHING} AS DECIMAL(20, 0)) * {UNIT}"
    return F.expr(f"1 + ({above}) div (CAST({total} AS DECIMAL(20, 0)) + CAST({SMOOTHING} * terms AS DECIMAL(20, 0)))")


class Audit:
    """Counts of the common terms of every language and totals of every group, kept below the shared folder.

    ``kept``: lang, term, source, n, lang_n, bucket, place. ``groups``: lang, source, total, lang_total, terms (the number
    of common terms of the language), peers (the number of its sources).
    """

    def __init__(self, docs: DataFrame, min_documents: int = MIN_DOCUMENTS):
        counted = save(term_counts(docs), "divergence-counts")
        common = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_documents)
        common = save(common.drop("docs"), "divergence-common")
        self.buckets = max(1, -(-common.count() // BUCKET))
        within = Window.partitionBy("lang", "bucket").orderBy("term")
        placed = common.withColumn("bucket", F.pmod(F.xxhash64("lang", "term"), F.lit(self.buckets)).cast("int")).withColumn("place", F.row_number().over(within) - 1)
        self.kept = save(counted.select("lang", "term", "source", "n").join(placed, ["lang", "term"]), "divergence-kept")
        langs = common.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
        totals = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = docs.select(*_texts("lang", "source")).distinct()
        peers = groups.groupBy("lang").agg(F.count("*").alias("peers"))
        groups = groups.join(totals, ["lang", "source"], "left").join(peers, "lang").join(langs, "lang", "left")
        self.groups = save(groups.na.fill(0, ["total", "terms", "lang_total"]), "divergence-groups")
        forget(counted, common)

    def shares(self) -> DataFrame:
        """``kept`` with those shares of a group (``p``) and of its language (``q``) in units of a billionth."""
        rows = join_by_size(self.kept, self.groups.select("lang", "source", "total", "lang_total", "terms"), ["lang", "source"])
        return rows.withColumn("p", _share("n", "total")).withColumn("q", _share("lang_n", "lang_total"))

    def typical_terms(self, top: int = TOP) -> DataFrame:
        """``lang, source, item, value, rank``: terms that a group uses more than its language does, by the excess."""
        best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        rows = self.shares().where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), F.expr("p - q").alias("value"))
        return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    def distances(self) -> DataFrame:
        """``lang, source, item, value, rank``: every other source of the language by the summed difference of shares."""
        blocks = F.expr(f"CAST(ceil(peers / {SOURCES}) AS INT)")
        groups = self.groups.withColumn("base", _guarded_share()).withColumn("blocks", blocks)
        absent = groups.select("lang", "source", "base", "blocks", F.explode(F.when(F.col("terms") > 0, F.sequence(F.lit(0), F.lit(self.buckets - 1))).otherwise(F.array(F.lit(0)))).alias("bucket"), F.lit(-1).alias("place"), F.col("base").alias("p"))
        wide = join_by_size(self.kept, groups.select("lang", "source", "total", "terms", "base", "blocks"), ["lang", "source"])
        present = wide.select("lang", "source", "base", "blocks", "bucket", "place", _share("n", "total").alias("p"))
        rows = absent.unionByName(present).withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
        met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
        rows = rows.withColumn("met", F.explode(met)).select("lang", "bucket", "met.i", "met.j", "source", "block", "base", "place", "p")
        parts = rows.groupBy("lang", "bucket", "i", "j").applyInArrow(_differences, "lang string, source string, item string, value long")
        both = parts.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).select(
            "lang", F.when(F.col("side") == 0, F.col("source")).otherwise(F.col("item")).alias("source"),
            F.when(F.col("side") == 0, F.col("item")).otherwise(F.col("source")).alias("item"), "value",
        )
        summed = both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        return summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    def close(self) -> None:
        forget(self.kept, self.groups)


def _guarded_share() -> Column:
    """The share of a common term that a group does not use; 0 where the language has no common term."""
    return F.when(F.col("terms") > 0, _share("0", "total")).otherwise(F.lit(0).cast("long"))


def _differences(rows: pa.Table) -> pa.Table:
    """Summed differences over one bucket of terms, of all pairs within a block of sources or between two."""
    key = {name: rows.column(name)[0].as_py() for name in ("lang", "bucket", "i", "j")}
    names = rows.column("source").combine_chunks().dictionary_encode()
    source, place, p, base, block = (names.indices.to_numpy(), *(rows.column(c).to_numpy() for c in ("place", "p", "base", "block")))
    here = place >= 0
    places, at = np.unique(place[here], return_inverse=True)
    count = len(names.dictionary)
    start, side = np.zeros(count, np.int64), np.zeros(count, np.int64)
    start[source], side[source] = base, block
    shares = np.repeat(start[:, None], len(places), 1)
    shares[source[here], at] = p[here]
    a, b, value = [], [], []
    if len(places) or key["bucket"] == 0:
        second = np.flatnonzero(side == key["j"])
        for one in np.flatnonzero(side == key["i"]):
            others = second[second > one] if key["i"] == key["j"] else second
            a.append(np.full(len(others), one)), b.append(others)
            value.append(np.abs(shares[others] - shares[one]).sum(1))
    pick = lambda found: names.dictionary.take(pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
    left = pick(a)
    return pa.table({
        "lang": pa.array([key["lang"]] * len(left), pa.string()), "source": left.cast(pa.string()), "item": pick(b).cast(pa.string()),
        "value": pa.array(np.concatenate(value) if value else np.zeros(0, np.int64)),
    })


def report(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: pairs of sources and typical terms of every group."""
    audit = Audit(docs)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = audit.distances().withColumn("part", F.lit("pair")).select(*columns)
    return pairs.unionByName(audit.typical_terms().withColumn("part", F.lit("term")).select(*columns))


SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), used AS (
  SELECT lang, source, unnest(list_distinct(terms)) AS term, 0 AS n, 1 AS docs FROM docs
  UNION ALL SELECT lang, source, unnest(terms), 1, 0 FROM docs
), counted AS (SELECT lang, source, term, sum(n) AS n, sum(docs) AS docs FROM used GROUP BY ALL),
common AS MATERIALIZED (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM counted GROUP BY ALL HAVING sum(docs) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM common GROUP BY lang),
groups AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(l.total, 0) AS lang_total, coalesce(t.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs l USING (lang)
  LEFT JOIN (SELECT c.lang, c.source, CAST(sum(c.n) AS HUGEINT) AS total FROM counted c JOIN common k USING (lang, term) GROUP BY ALL) t ON t.lang = g.lang AND t.source = g.source
), shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS BIGINT) AS p, CAST(1 + (1000000000 * (k.n + 5)) // (g.lang_total + 5 * g.v) AS BIGINT) AS q
  FROM groups g JOIN common k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(max(d.value), 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  GROUP BY ALL
), rows AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM rows QUALIFY part = 'pair' OR rank <= 50
"""
