"""The corpus pipeline: language ID, exact dedup, near-duplicate removal, mixing, packing.

Each stage gets the session, its predecessor's rows and the folder of tables. All but the last return the
columns of documents (and whatever other columns there are); every decision takes effect, so a row that a stage drops is not seen again.

Defined results: null and empty texts and texts without a letter go in the first stage, as their language is undetermined; where there is
no language to learn from, all rows go there. Rows without doc_id are kept like others: of equal texts one with an id stays before one
without, they are no near duplicates of anything, and the mix draws for them by their texts. Of rows that repeat text and doc_id one
stays. An empty table stays empty. Staged tables lie in the shared folder until clear_staged (cadenza.llm.common) is called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from cadenza.llm.common import staged


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined or ambiguous go."""
    return language_id.keep_identified(docs, language_id.learn(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more the one with the smallest doc_id stays."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned out to their target weights."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token windows that the mix makes."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages),
    ("exact_dedup", exact),
    ("jaccard_join", near),
    ("mix_sources", mixed),
    ("pack_sequences", packed),
]

#: SQL cannot express the language classifier, so there is no SQL for the whole; tests hold each stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again in between."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        rows = staged(stage(spark, rows, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, rows, sf_dir)
