"""A training-data pipeline over `documents`: each stage takes what the one before kept.

quality classifier -> near-duplicates -> benchmark decontamination -> mixing -> token files
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hushline.llm import decontaminate, mixing, quality, simhash, tokens
from hushline.llm.common import documents, fresh_path
from hushline.session import ship

#: Not expressible in SQL: trained scores, fingerprints and a tokenizer decide the rows.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, accepts."""
    return quality.keep_good(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship(spark)
    return simhash.one_of_each(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents near the sources' target weights; a row for each time one is taken."""
    ship(spark)
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder; the place and checksum of each document, read back."""
    ship(spark)
    return tokens.token_table(docs)


STAGES = [("quality classifier", keep_quality), ("SimHash near-dedup", one_of_each), ("benchmark decontamination", decontaminate_benchmark), ("mixing sources to target weights", mix_sources), ("token-ID / binary output", token_files)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = fresh_path(spark, "stage-" + "".join(c if c.isalnum() else "-" for c in name))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
