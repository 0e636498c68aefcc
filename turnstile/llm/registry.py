"""The operators' queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import addressable_codes, curve_packing, katz_lm, mix_sources, near_dedup, order_minhash, periodic_runs, phrase_stripes, pieces, quality_mcd, sentence_spans, transcripts, url_filter
from .common import table
from .vocabulary import byte_model, piece_model, word_model


def op1_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_lm.score_documents(table(spark, sf_dir, "documents"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_table(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_mcd.judge_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_table(table(spark, sf_dir, "documents"), shingle=3, threshold=85)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.encode_documents(table(spark, sf_dir, "documents"), piece_model()))


def op7_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addressable_codes.round_trip(table(spark, sf_dir, "documents"), word_model())


def op8_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.parse_conversations(table(spark, sf_dir, "conversations"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources.mix_table(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.clean_table(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    varied = docs.withColumn("text", periodic_runs.periodic_text(F.col("doc_id"), F.col("text")))
    return periodic_runs.digest(periodic_runs.scan_documents(varied))


def op12_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.digest(curve_packing.pack_documents(table(spark, sf_dir, "documents"), byte_model()))


def op13_phrase_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_stripes.top_phrases(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_katz_lm": op1_katz_lm,
    "op2_order_minhash": op2_order_minhash,
    "op3_url_filter": op3_url_filter,
    "op4_quality_rules": op4_quality_rules,
    "op5_near_dedup": op5_near_dedup,
    "op6_pieces": op6_pieces,
    "op7_addressable_codes": op7_addressable_codes,
    "op8_transcripts": op8_transcripts,
    "op9_mix_sources": op9_mix_sources,
    "op10_sentence_spans": op10_sentence_spans,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_curve_packing": op12_curve_packing,
    "op13_phrase_stripes": op13_phrase_stripes,
    "pipeline": pipeline,
}
ORACLES = {"op9_mix_sources": mix_sources.ORACLE, "op13_phrase_stripes": phrase_stripes.ORACLE}
