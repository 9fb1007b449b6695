"""Hotspots sharing one exact coordinate.

Groups stay in long form (one row per member) and survivors come from min/max aggregates, so a coordinate shared by
very many hotspots is combined map-side and never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COORDINATES = ["lon", "lat"]


def keep_first(df: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """First row per key in ``order``; an aggregate, so duplicates collapse before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return first.select(*keys, "_row.*").select(*df.columns)


def merge_by_coordinates(hotspots: DataFrame, order: str, sums: Sequence[str]) -> DataFrame:
    """One row per coordinate: the first member's attributes with ``sums`` added up over all members."""
    placed = hotspots.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    rest = [c for c in hotspots.columns if c not in COORDINATES and c not in sums]
    merged = placed.groupBy(*COORDINATES).agg(
        F.min_by(F.struct(*rest), F.col(order)).alias("_row"), *[F.sum(c).alias(c) for c in sums])
    return merged.select(*COORDINATES, "_row.*", *sums)


def survivors(hotspots: DataFrame, hotspot: str, order: str) -> DataFrame:
    """Every hotspot with the first member of its coordinate as ``survivor_id``, and the member count."""
    first = hotspots.groupBy(*COORDINATES).agg(F.min_by(hotspot, order).alias("survivor_id"), F.count("*").alias("members"))
    return hotspots.join(first, COORDINATES)


def groups(hotspots: DataFrame, hotspot: str, order: str) -> DataFrame:
    """Members of coordinates that occur more than once."""
    return survivors(hotspots, hotspot, order).filter(F.col("members") > 1)


def suspicious(members: DataFrame, log: DataFrame) -> DataFrame:
    """Members of groups recorded by one identical observer set on a single date: (hotspot_id).

    All members of a group have the same observer set exactly when each has as many distinct observers as the whole
    group, so counts decide and no observer list is built. Members without log rows are passed over.
    """
    placed = log.join(members.select("hotspot_id", *COORDINATES), "hotspot_id")
    pairs = placed.select("hotspot_id", *COORDINATES, "observer_id").distinct()
    per_member = pairs.groupBy("hotspot_id", *COORDINATES).agg(F.count("observer_id").alias("own"))
    smallest = per_member.groupBy(*COORDINATES).agg(F.min("own").alias("smallest"))
    together = pairs.select(*COORDINATES, "observer_id").distinct().groupBy(*COORDINATES).agg(F.count("observer_id").alias("all"))
    dates = placed.groupBy(*COORDINATES).agg(F.min("obs_date").alias("first_date"), F.max("obs_date").alias("last_date"))
    bad = smallest.join(together, COORDINATES).join(dates, COORDINATES).filter(
        (F.col("smallest") == F.col("all")) & (F.col("first_date") == F.col("last_date")))
    return members.join(bad.select(*COORDINATES), COORDINATES, "left_semi").select("hotspot_id")


def drop_suspicious(hotspots: DataFrame, flagged: DataFrame) -> DataFrame:
    return hotspots.join(flagged, "hotspot_id", "left_anti")


def merge_map(members: DataFrame, alive: DataFrame, order: str) -> DataFrame:
    """(survivor_id, member_id): the last member still listed in ``alive`` takes over the members that are gone."""
    flagged = members.join(alive.select("hotspot_id", F.lit(True).alias("alive")), "hotspot_id", "left")
    last = flagged.groupBy(*COORDINATES).agg(F.max_by("hotspot_id", F.when(F.col("alive"), F.col(order))).alias("survivor"))
    gone = flagged.filter(F.col("alive").isNull()).select(*COORDINATES, F.col("hotspot_id").alias("member_id"))
    return (gone.join(last.filter(F.col("survivor").isNotNull()), COORDINATES)
            .select(F.col("survivor").alias("survivor_id"), "member_id"))
