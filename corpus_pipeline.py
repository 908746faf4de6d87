"""A training-data pipeline over ``documents``.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame.  Every stage's result is written as Parquet and read
again as the next one's docs, so a lost executor never costs more than a
stage.  All but the last return the columns of documents; the last returns
them in training order with size, target, taken and position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagmeter.llm import decontaminate, jaccard, language, lines, mixing
from tagmeter.llm.common import drop, scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models know; ``und`` and doubtful ones go."""
    return language.keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that nearly repeat an earlier one; what is left
    of a torn copy goes."""
    return lines.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with two benchmark items or more go; single hits are cut."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, by training position."""
    planned = mixing.plan(docs, keep=tuple(docs.columns))
    names = [c for c in docs.columns if c == "doc_id" or c not in mixing.OUTPUT]
    return planned.where("taken > 0").select(*names, "size", "target", "taken", "position").orderBy("position", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  A stage's folder goes once the next one is
    written, the last one's when the interpreter ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch() as s:
            made = s.keep(table(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        drop(docs)
        docs = made
    return docs


#: The language models and the fuzzy line components are beyond SQL.
ORACLE_SQL = None
