"""Per-species statistics over target vectors.

Vectors are exploded inside the scan stage and aggregated by species at once, so each mapper ships at most one partial
row per species.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions import arrays


def cells(targets: DataFrame, vector: str = "probs", *keep: str) -> DataFrame:
    return targets.select(*keep, arrays.unrolled(vector, "species_idx", "rate"))


def mean_rates(targets: DataFrame, vector: str = "probs") -> DataFrame:
    return cells(targets, vector).groupBy("species_idx").agg(F.avg("rate").alias("mean_rate"))


def extremes(targets: DataFrame, n: int, vector: str = "probs") -> DataFrame:
    """The ``n`` most and least frequent species by mean rate: top-k sorts, ties by index."""
    means = mean_rates(targets, vector)
    key = F.round("mean_rate", 9)
    most = means.orderBy(F.desc(key), "species_idx").limit(n).select(F.lit("most").alias("side"), "species_idx", "mean_rate")
    least = means.orderBy(F.asc(key), "species_idx").limit(n).select(F.lit("least").alias("side"), "species_idx", "mean_rate")
    return most.unionByName(least)


def frequencies(targets: DataFrame) -> DataFrame:
    """Expected reports per species: sum of rate x checklists."""
    return (cells(targets, "probs", "num_complete_checklists").groupBy("species_idx")
            .agg(F.sum(F.col("rate") * F.col("num_complete_checklists")).alias("frequency")))


def most_least_common(freq: DataFrame) -> DataFrame:
    """Index of the largest and of the smallest non-zero frequency, ties to the lower index."""
    f = F.round("frequency", 9)
    tie = F.struct(f, -F.col("species_idx"))
    low = F.when(f > 0, F.struct(f, F.col("species_idx")))
    return freq.agg(F.max_by("species_idx", tie).alias("most_common"), F.min_by("species_idx", low).alias("least_common"))


def random_subset(freq: DataFrame, n: int, seed: int) -> DataFrame:
    """Most and least common species plus ``n - 2`` others with a non-zero frequency, drawn by a seeded hash."""
    ends = most_least_common(freq).select(F.explode(F.array("most_common", "least_common")).alias("species_idx")).distinct()
    draw = arrays.uniform(seed, F.col("species_idx"))
    others = (freq.filter(F.col("frequency") > 0).select("species_idx").join(ends, "species_idx", "left_anti")
              .orderBy(draw, "species_idx").limit(n - 2))
    return ends.unionByName(others)


def zero_in_both(first: DataFrame, second: DataFrame) -> DataFrame:
    def zero(f: DataFrame) -> DataFrame:
        return f.filter(F.col("frequency") == 0).select("species_idx")

    return zero(first).intersect(zero(second))


def occurrence_counts(targets: DataFrame) -> DataFrame:
    """Hotspots with a non-zero rate per species, most frequent first."""
    return (cells(targets).groupBy("species_idx").agg(F.count_if(F.col("rate") > 0).alias("hotspots"))
            .orderBy(F.desc("hotspots"), "species_idx"))


def never_present(targets: DataFrame) -> DataFrame:
    return (cells(targets).groupBy("species_idx").agg(F.max("rate").alias("m")).filter(F.col("m") == 0).select("species_idx"))


def places_of(targets: DataFrame, hotspots: DataFrame, species_idx: Column, place: str) -> DataFrame:
    """Where one species occurs: hotspots per place with a non-zero rate."""
    found = targets.filter(F.get("probs", species_idx) > 0).select("hotspot_id")
    return found.join(hotspots.select("hotspot_id", place), "hotspot_id").groupBy(place).agg(F.count("*").alias("hotspots"))


def presence_pairs(targets: DataFrame) -> DataFrame:
    """Sparse presence matrix: one row per (hotspot, species) with a non-zero rate."""
    return cells(targets, "probs", "hotspot_id").filter(F.col("rate") > 0).select("hotspot_id", "species_idx", F.lit(1).alias("present"))
