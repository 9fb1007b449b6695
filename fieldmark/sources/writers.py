"""Sinks: partitioned tables, JSON documents, split files, result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def locality_bucket(hotspot: Column, buckets: int = 1000) -> Column:
    """Number of the id modulo ``buckets``."""
    return F.pmod(F.substring(hotspot, 2, 30).cast("bigint"), F.lit(buckets))


def by_bucket(log: DataFrame, path: str, buckets: int = 1000, rows_per_file: int = 2_000_000, mode: str = "append") -> None:
    """Route rows to bucket folders, in as many files as the rows of a bucket need.

    Buckets are counted first; a row hash beside the bucket then keeps a hot locality from filling one task.
    """
    routed = log.withColumn("bucket", locality_bucket(F.col("hotspot_id"), buckets))
    files = routed.groupBy(F.col("bucket").alias("_b")).agg(F.ceil(F.count("*") / rows_per_file).alias("_files"))  # one row a bucket
    salted = routed.join(F.broadcast(files), F.col("bucket").eqNullSafe(F.col("_b")))
    salt = F.pmod(F.xxhash64(*log.columns), F.col("_files"))
    dealt = salted.withColumn("_salt", salt).repartition("bucket", "_salt")
    dealt.drop("_b", "_files", "_salt").write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("bucket").parquet(path)


def by_columns(df: DataFrame, path: str, columns: Sequence[str], mode: str = "append") -> None:
    df.write.mode(mode).partitionBy(*columns).parquet(path)


def delimited(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.options(sep=sep, header=True, dateFormat="yyyy-MM-dd").csv(path)


def target_document(hotspot: str = "hotspot_id") -> Column:
    return F.to_json(F.struct(F.col(hotspot).alias("hotspot_id"), "probs", "num_complete_checklists"))


def targets_json(targets: DataFrame, path: str) -> None:
    targets.select("hotspot_id", "probs", "num_complete_checklists").write.json(path)


def append_results(metrics: DataFrame, path: str) -> None:
    """Append metric rows to a results table; the schema is stored with the files, so no header logic is needed."""
    metrics.write.mode("append").parquet(path)


def matrices(features: DataFrame, targets: DataFrame, path: str) -> None:
    """X / y rows per split: (hotspot_id, x, y) partitioned by split."""
    features.join(targets, "hotspot_id").write.partitionBy("split").parquet(path)
