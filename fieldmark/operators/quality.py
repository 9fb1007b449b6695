"""Data-set checks: each returns the offending rows, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def incomplete_modalities(hotspots: DataFrame, modalities: dict[str, DataFrame], key: str = "hotspot_id") -> DataFrame:
    """(key, modality) for every hotspot without data in a modality: one anti join per modality."""
    out = None
    for name, table in modalities.items():
        missing = hotspots.select(key).join(table.select(key), key, "left_anti").withColumn("modality", F.lit(name))
        out = missing if out is None else out.unionByName(missing)
    return out


def wrong_lengths(rows: DataFrame, expected: int, vectors: dict[str, str], key: str = "hotspot_id") -> DataFrame:
    """Rows whose vectors are not ``expected`` long."""
    bad = F.lit(False)
    for column in vectors.values():
        bad = bad | (F.size(column) != expected)
    return rows.filter(bad).select(key, *[F.size(c).alias(n) for n, c in vectors.items()])
