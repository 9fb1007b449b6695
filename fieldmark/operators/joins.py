"""Key joins and set operations between hotspot, species and file tables.

None of them carries a broadcast hint: sides below the session's threshold are broadcast on their known size, larger
ones shuffle, and adaptive execution splits hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rekey_by_coordinates(rows: DataFrame, reference: DataFrame, key: str = "hotspot_id") -> DataFrame:
    """Rows at exactly a reference coordinate take over its key; others are left out."""
    target = reference.select("lat", "lon", F.col(key).alias("_key"))
    return rows.join(target, ["lat", "lon"]).withColumn(key, F.col("_key")).drop("_key")


def reconcile_seasons(rows: DataFrame, reference: DataFrame, key: str = "hotspot_id") -> DataFrame:
    """Rows whose id has a split keep it; the others are re-keyed by coordinate and take that hotspot's split."""
    known = rows.join(reference.select(key, "split"), key, "left")
    kept = known.filter(F.col("split").isNotNull()).drop("split")
    extra = rekey_by_coordinates(known.filter(F.col("split").isNull()).drop("split"), reference, key)
    return kept.unionByName(extra).join(reference.select(key, "split"), key, "left")


def present(rows: DataFrame, files: DataFrame, key: str = "hotspot_id") -> DataFrame:
    return rows.join(files.select(key), key, "left_semi")


def absent(rows: DataFrame, files: DataFrame, key: str = "hotspot_id") -> DataFrame:
    return rows.join(files.select(key), key, "left_anti")


def missing(expected: DataFrame, found: DataFrame, key: str = "hotspot_id") -> DataFrame:
    return expected.select(key).subtract(found.select(key))


def common_names(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    return a.select(name).intersect(b.select(name))


def species_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sorted distinct union of two lists with a flag for names in both."""
    both = a.select("species", F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(
        b.select("species", F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    return (both.filter(F.col("species").isNotNull()).groupBy("species")
            .agg(((F.max("in_a") + F.max("in_b")) == 2).alias("in_both")).orderBy("species"))


def restrict_species(rows: DataFrame, shared: DataFrame) -> DataFrame:
    return rows.join(shared.select("species"), "species", "left_semi")


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Row-wise union; columns missing on one side are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def resplit(rows: DataFrame, reference: DataFrame, on: str) -> DataFrame:
    """Own ids, the split of the reference table."""
    return rows.drop("split").join(reference.select(on, "split"), on)


def with_features(rows: DataFrame, features: DataFrame, key: str, drop: Sequence[str] = ()) -> DataFrame:
    return rows.join(features, key).drop(*drop)


def prefixed(key: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), key)
