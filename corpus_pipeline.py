"""A training-corpus pipeline of five stages; each works on all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the mix: a row for each document
from which words are taken.  Stages have no hidden state: what one decides is in its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.llm import decontam, langid, mixing, pii, simhash
from augury.llm.common import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and those that no learned language fits; learned from ``docs`` itself."""
    return langid.keep_identified(docs, langid.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near copies: five-word shingles, alike in 0.8 or more."""
    return simhash.keep_one_alike(docs, **simhash.SHARED)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, its words in whatever order of passages."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms in place of validated numbers, dates and addresses; n_chars follows the text."""
    changed = pii.pseudonymise(docs, pii.session_key(spark))
    found = changed.columns[-1]  # the number of values replaced, under a name that docs does not have
    return changed.withColumn("n_chars", F.when(F.col(found) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the words of each that it takes."""
    return mixing.mix(docs).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("pseudonyms", replace_personal_data),
    ("mixing", mix_sources),
]

#: The first stage learns a model, which SQL can't express; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written once to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
