"""The text pipeline: stages over ``documents``, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldmark.llm import common, decontaminate, exact_dedup, mixing, ngram_join, quality, registry


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the importance draw selects; their weights come from the labels of this folder."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts the row with the smallest id stays."""
    return ngram_join.keep_first(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap with a benchmark item go."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row left, with the words that the mix takes of it."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", select_quality),
    ("exact dedup", remove_copies),
    ("n-gram Jaccard join", remove_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("mixing sources", mix_sources),
]
#: The first stage fits a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def queries() -> dict:
    return registry.queries() | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return registry.oracle_sql() | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
