"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again for the next one.

Every stage works on all that its predecessor kept. The first four return the columns of `documents`; the last returns
one row per packed piece. n_chars follows the text where a stage changes it. Null ids and texts, empty tables and extra
columns are treated as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanefold.llm.common import scratch, table, written
from vanefold.llm.ngram_join import one_of_each
from vanefold.llm.packing import packed
from vanefold.llm.quality import good_documents
from vanefold.llm.queries import tokenizer_path
from vanefold.llm.secret_scan import redacted
from vanefold.llm.suffix_dedup import deduplicated


def _counted(before: DataFrame, after: DataFrame) -> DataFrame:
    """The columns as they were, with n_chars of the text as it is now."""
    if "n_chars" in before.columns:
        after = after.withColumn("n_chars", F.char_length("text").cast(before.schema["n_chars"].dataType))
    return after.select([F.col(f"`{c}`") for c in before.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start elsewhere too go."""
    return _counted(docs, deduplicated(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mark takes the place of each secret."""
    return _counted(docs, redacted(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 2048 tokens."""
    return packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("secrets", secrets), ("packing", packing)]

#: The stages' models, hashes and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as out:  # what stages leave to the next one is deleted at the end
        for _, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), spark)
        return out(STAGES[-1][1](spark, docs, sf_dir))
