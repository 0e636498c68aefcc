"""From documents to token ids: quality rules, near-dedup, substring dedup, mixing, encoding.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again for the next one, and the table
before that is then deleted.

Cases: rows with a null or empty text, or one of blanks, fail the quality rules; an empty table gives an empty table. Rows with a null id
go through and link with nothing. Equal rows count as copies: one is left before the mix, which may take it more than once. Extra columns
go along, whatever their names, up to the last stage, which returns ids and spans only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnstile.llm import mix_sources, near_dedup, pieces, quality_mcd, sentence_spans
from turnstile.llm.common import removed, stored, table
from turnstile.llm.vocabulary import piece_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_mcd.filter_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.dedup_documents(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_spans.clean_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs, piece_model()).select("doc_id", "ids", "begins", "ends")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near", near),
    ("substrings", substrings),
    ("mix", mix),
    ("encode", encode),
]

#: No stage but the mix has a form in SQL; tests/llm/test_pipeline.py holds run()'s rows against a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            removed(last)
        last = docs
    return docs
