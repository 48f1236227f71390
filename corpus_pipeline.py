"""A training corpus from raw documents: five stages, each over all that its predecessor kept.

Null and empty texts count as empty documents: the classifier scores them like any other, of those it keeps one stays as an
exact copy of the others, without words it is no near copy, and it is packed as its end id.  Of repeated rows one stays.
Extra columns, whatever their names, are carried up to the packing.  An empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import exact_dedup, ngram_join, packing, pii, quality
from quillspark.llm.common import clear_stored, stored, tables_written
from quillspark.llm.queries import tokenizer_file


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, similarity of 0.8 or more."""
    return ngram_join.drop_near_duplicates(docs, k=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens: a row per piece."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Neither the fitted classifier nor the tokenizer can be written in SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  Each stage's table is kept until the next one is written, tables inside a stage until its end."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), tables_written(spark)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        clear_stored(spark, before, keep_last=True)
    return docs
