"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Every stage takes and returns the five columns of ``documents`` (columns beside them are left behind); the last one
returns packed pieces. Null and empty texts, null ids and sources, repeated rows and empty tables pass as the operators
say: line dedup and the near-copy stage take rows that share an id as one document, the others each row by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.llm import language_id, line_dedup, mixing, ngram_join, packing
from framelens.llm.common import IdFilter, one_row_per_id, outer_id, read, save

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, which have no language (``und``), go. A missing ``lang`` is filled in."""
    docs = docs.select(*COLUMNS)
    named = language_id.identify(docs, language_id.fit(docs)).where("lang_pred <> 'und'")
    return named.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that many documents share; ``n_chars`` follows."""
    left = line_dedup.dedup_lines(docs, keep=("lang", "source"))
    return left.select(outer_id().alias("doc_id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest id stays. Only texts that may go are shuffled, to be looked up exactly."""
    go = ngram_join.near_copies(docs).where("_id <> component_id").select("_id")
    rows = one_row_per_id(docs, "doc_id", "text", ("lang", "source", "n_chars"))
    asked = IdFilter(go, "_id")
    unsure = asked.keep(rows, "_id").join(go.hint("shuffle_hash"), "_id", "left_anti")
    stay = asked.keep(rows, "_id", may=False).unionByName(unsure)
    return stay.select(outer_id().alias("doc_id"), F.col("value").alias("text"), "lang", "source", "n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the sources ask for, 0 to 3 times."""
    return mixing.repeat(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a document copied by the mix is packed once for each copy."""
    return packing.sequences(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]
#: Word models, tilted rates and packing plans have no plain SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
