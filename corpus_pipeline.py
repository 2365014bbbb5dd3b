"""A training-data pipeline of five stages over ``documents``.

Each stage works on all that its predecessor kept; ``run`` writes each stage's rows
as Parquet in the shared folder and reads them again for the next. Null and letterless
texts go in the first stage; an empty table stays empty; extra columns stay up to the
last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagegrain.llm import langid, line_dedup, mixing, ngram_join, packing
from pagegrain.llm.scratch import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go."""
    return langid.accepted(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and similar lines of all documents one stays."""
    return line_dedup.deduplicated(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that with the smallest doc_id."""
    return ngram_join.singles(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is repeated or thinned to its target; a document is there as often as it is taken."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_near_copies),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: Models, hashes and tokens have no SQL; tests hold each stage's rows against those it was given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = scratch.keep(f"{i}-{name}", out)
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
