"""A training corpus from raw documents: five stages, each over all rows that the one before kept.

An empty table gives empty tables, and extra columns stay. What each stage does with null and empty texts, null ids and repeated
rows its function says.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.llm import linededup, ngramjoin, packing, secrets, toxicity
from facetlake.llm.common import documents
from facetlake.sharing import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text isn't toxic; the classifier learns from the labelled rows that aren't held out.

    Null and empty texts get the score of no features; repeated rows and null ids are judged by their texts as all others.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; copies of a text count once, the next stage drops them.

    Null texts stay null, texts whose lines all go become empty, repeated rows each stay, null sources are one source.
    """
    kept = linededup.drop_boilerplate(docs, ratio=linededup.RATIO, long_ratio=linededup.LONG_RATIO, copies=False)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word n-grams, Jaccard 0.8 or more), that with the least id.

    Of repeated rows one stays. Texts without a word (null, empty) all stay; a null id comes last in its group.
    """
    return ngramjoin.keep_one(docs, n=5, num=80, den=100)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; null texts stay null, repeated rows each stay."""
    kept = secrets.redact(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a null or empty text is the end token alone, repeated rows and null ids are packed as all others."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_join", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: No SQL says what a trained classifier or a tokenizer does; tests compare the stages with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
