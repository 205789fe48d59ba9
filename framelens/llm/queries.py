"""The registered queries ``opN_<name>`` and their check SQL, and those of the pipeline."""

from __future__ import annotations

from framelens.llm import decontamination, divergence, embedding_dedup, language_id, line_dedup, mixing, ngram_join, packing, pii, suffix_dedup, topk_search, vector_codes, warc
from framelens.llm.catalog import ORACLES, QUERIES, query
from framelens.llm.common import read


@query("op9_line_dedup", line_dedup.SQL)
def op9(spark, sf_dir):
    return line_dedup.digest(read(spark, sf_dir, "documents"))


@query("op3_warc", warc.SQL)
def op3(spark, sf_dir):
    return warc.round_trip(read(spark, sf_dir, "pages"))


@query("op8_source_mix")
def op8(spark, sf_dir):
    return mixing.report(read(spark, sf_dir, "documents"))


@query("op10_language_id")
def op10(spark, sf_dir):
    return language_id.report(read(spark, sf_dir, "documents"))


@query("op1_ngram_join", ngram_join.SQL)
def op1(spark, sf_dir):
    return ngram_join.report(read(spark, sf_dir, "documents"))


@query("op4_suffix_dedup", suffix_dedup.SQL)
def op4(spark, sf_dir):
    return suffix_dedup.report(read(spark, sf_dir, "documents"))


@query("op6_packing")
def op6(spark, sf_dir):
    return packing.sequences(read(spark, sf_dir, "documents"))


@query("op2_embedding_dedup", embedding_dedup.SQL)
def op2(spark, sf_dir):
    return embedding_dedup.report(read(spark, sf_dir, "embeddings"))


@query("op5_topk_search", topk_search.SQL)
def op5(spark, sf_dir):
    return topk_search.search(read(spark, sf_dir, "embeddings"))


@query("op7_pii")
def op7(spark, sf_dir):
    return pii.report(read(spark, sf_dir, "documents"))


@query("op12_source_divergence", divergence.SQL)
def op12(spark, sf_dir):
    return divergence.report(read(spark, sf_dir, "documents"))


@query("op11_vector_codes", vector_codes.SQL)
def op11(spark, sf_dir):
    return vector_codes.report(read(spark, sf_dir, "embeddings"))


@query("op13_decontamination", decontamination.SQL)
def op13(spark, sf_dir):
    return decontamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
