"""The corpus pipeline: quality rules, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of ``docs``, whatever these are, with
n_chars, if it is one of them, counted again where the text may have changed.

Rows with a null doc_id are judged and packed like any others; line and near
dedup keep them whole, and for substring dedup they come after all others.  A
null text is an empty one, and fails the quality rules; one that becomes empty
later goes on as an empty document.  Rows that repeat come back as often as the
stage keeps them.  Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm import linededup, packing, quality, simhash, substrdedup
from foldspark.llm.scratch import table
from foldspark.sources.shipping import ship
from foldspark.sources.staging import spread


def _as_documents(out: DataFrame, docs: DataFrame) -> DataFrame:
    """``out`` with the columns and types of ``docs``, n_chars, where there is one, being the length of its text."""
    kind = {f.name: f.dataType for f in docs.schema}
    return out.select(*(F.length("text").cast(kind[c]).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents which the rules and their host's verdict accept."""
    ship(spark)
    return quality.keep_good(spread(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that recur in three or more of them."""
    ship(spark)
    return _as_documents(linededup.dedup_lines(spread(docs)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship(spark)
    return simhash.keep_one(spread(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without windows of 20 words that start earlier elsewhere."""
    ship(spark)
    return _as_documents(substrdedup.dedup_substrings(spread(docs), normalise=False), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    ship(spark)
    return packing.pack_documents(spread(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no XXH64 and no tokenizer, so the stages are held against brute force in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what a stage keeps is written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
