"""Row and hotspot filters, projections and small per-key summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.operators import distribution, encounter

# Months of the two seasons.
SEASON_MONTHS = {"summer": (6, 7), "winter": (12, 1)}


def _months(date: str, months: Sequence[int]) -> Column:
    return F.month(date).isin(*months)


def complete_season_rows(log: DataFrame, first_year: int = 2010, last_year: int = 2029, months: Sequence[int] = (6, 7, 12, 1)) -> DataFrame:
    return log.filter((F.col("complete") == 1) & F.year("obs_date").between(first_year, last_year) & _months("obs_date", months))


def complete_season_text(log: DataFrame, pattern: str) -> DataFrame:
    """Same on dates still kept as text."""
    return log.filter((F.col("complete").cast("string") == "1") & F.col("obs_date").cast("string").rlike(pattern))


def target_rows(log: DataFrame, first_year: int = 2010, months: Sequence[int] = (6, 7, 12, 1)) -> DataFrame:
    return log.filter((F.col("complete") == 1) & (F.year("obs_date") >= first_year) & _months("obs_date", months))


def checklist_rows(log: DataFrame, country: str, excluded_states: Sequence[str], first_year: int = 2010) -> DataFrame:
    return log.filter((F.col("country") == country) & (F.col("complete") == 1)
                      & ~F.col("state").isin(*excluded_states) & (F.year("obs_date") >= first_year))


def with_season(log: DataFrame) -> DataFrame:
    """Rows of the two seasons with a ``season`` label: one scan serves both outputs."""
    label = F.lit(None).cast("string")
    for name, months in SEASON_MONTHS.items():
        label = F.when(_months("obs_date", months), name).otherwise(label)
    return log.withColumn("season", label).filter(F.col("season").isNotNull())


def drop_hotspots_with(log: DataFrame, unwanted: Column, hotspot: str = "hotspot_id") -> DataFrame:
    """Drop every row of a hotspot that has any unwanted row."""
    return log.join(log.filter(unwanted).select(hotspot).distinct(), hotspot, "left_anti")


def exclude_states(df: DataFrame, states: Sequence[str], column: str = "state") -> DataFrame:
    """Row-level exclusion that keeps rows without a state."""
    return df.filter(~F.col(column).isin(*states) | F.col(column).isNull())


def drop_columns_like(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith(prefix)])


def dedupe_rows_and_headers(df: DataFrame, id_column: str, header_text: str) -> DataFrame:
    return df.filter(F.col(id_column) != header_text).dropDuplicates()


def rate_violations(targets: DataFrame, limit: float = 1.0) -> DataFrame:
    return (targets.select("hotspot_id", F.array_max("probs").alias("max_rate")).filter(F.col("max_rate") > limit))


def size_summary(df: DataFrame, key: str, large: int) -> DataFrame:
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    median = distribution.exact_quantiles(sizes, "n", [0.5]).select("quantile").scalar()
    return sizes.agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.avg("n").alias("mean_n"),
                     F.count_if(F.col("n") > large).alias("large")).select(
        "min_n", "max_n", "mean_n", median.alias("median_n"), "large")


def occurrence_hotspots(occ: DataFrame) -> DataFrame:
    """Per hotspot: place, rows, distinct events, distinct species with NULL as one value.

    Distinct events and species are made distinct in one expanded pass, like the encounter counts.
    """
    counts = encounter.marks(occ, checklist="event_id").groupBy("hotspot_id").agg(
        F.max(F.when(F.col("kind") == 1, F.col("checklists"))).alias("num_complete_checklists"),
        F.count(F.when(F.col("kind") == 0, 1)).alias("named"))
    places = occ.groupBy("hotspot_id").agg(
        F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.min("state").alias("state"),
        F.count("*").alias("num_occurrences"), F.max(F.col("species").isNull().cast("int")).alias("unnamed"))
    return places.join(counts, "hotspot_id").select(
        "hotspot_id", "lat", "lon", "state", "num_occurrences", "num_complete_checklists",
        (F.col("named") + F.col("unnamed")).alias("num_different_species"))


def active_localities(log: DataFrame, key: str, order: str, min_rows: int = 5) -> DataFrame:
    return (log.groupBy(key).agg(F.count("*").alias("n"), F.min_by(F.struct("lat", "lon"), order).alias("first"))
            .filter(F.col("n") > min_rows).select(key, "n", "first.lat", "first.lon"))


def month_pivot(log: DataFrame, name: str, date: str) -> DataFrame:
    """Reports per name and month; the month list is fixed, so no extra pass finds the columns."""
    wide = log.select(name, F.month(date).alias("_month")).groupBy(name).pivot("_month", list(range(1, 13))).agg(F.count(F.lit(1)))
    return wide.select(name, *[F.coalesce(F.col(f"`{m}`"), F.lit(0)).alias(f"m{m}") for m in range(1, 13)])


def hotspot_profile(log: DataFrame) -> DataFrame:
    """One value per attribute and the number of distinct values seen (1 where the log is consistent)."""
    seen = distinct_values(log, ["state", "country"])
    first = log.groupBy("hotspot_id").agg(*[F.min(c).alias(c) for c in ("state", "country", "lat", "lon")])
    return first.join(seen, "hotspot_id").withColumnsRenamed({"n_state": "states", "n_country": "countries"})


def distinct_values(log: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per hotspot and column, counted after one shared de-duplication."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("v")) for c in columns])
    distinct = log.select("hotspot_id", F.inline(pairs)).filter(F.col("v").isNotNull()).distinct()
    return distinct.groupBy("hotspot_id").agg(*[F.count_if(F.col("col") == c).alias(f"n_{c}") for c in columns])


def shared_coordinates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Coordinates seen more than once over both sets, sorted within their longitude by count.

    A range-partitioned sort; unlike a window per longitude it can split a crowded longitude.
    """
    both = a.select("lon", "lat").unionByName(b.select("lon", "lat"))
    shared = both.groupBy("lon", "lat").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    return shared.orderBy("lon", F.desc("n"), "lat")


def checklist_species(log: DataFrame) -> DataFrame:
    """checklist -> taxa with their dense index; sets are bounded by the number of taxa."""
    taxa = encounter.species_dimension(log).withColumnRenamed("species_idx", "taxon_idx")
    distinct = log.select("checklist_id", "species").distinct().join(taxa, "species")
    return distinct.groupBy("checklist_id").agg(F.sort_array(F.collect_list(F.struct("taxon_idx", "species"))).alias("taxa"))
