"""Satellite scenes, mosaics and tile files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.operators import boxes, distribution


def search(areas: DataFrame, scenes: DataFrame, start: str, end: str, max_cloud: float, clearest: bool = False) -> DataFrame:
    """Scenes whose footprint meets an area, acquired in [start, end], cloud cover below the limit:
    structs ``l`` (area) and ``r`` (scene). With ``clearest`` only the least cloudy scene of each footprint, ties by scene id.

    Date and cloud limits are applied to the catalogue before the spatial join, where the scan can use them. Scenes
    with the same footprint are compared with the areas once.
    """
    fit = scenes.filter(F.col("acquired").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col("cloud") < max_cloud))
    axes = [boxes.LON, boxes.LAT]
    if clearest:
        best = F.min_by(F.struct(*fit.columns), F.struct("cloud", "scene_id")).alias("s")
        return boxes.overlap_join(areas, fit.groupBy(*[c for a in axes for c in (a.low, a.high)]).agg(best).select("s.*"), axes)
    pairs = boxes.shared_overlap_join(fit, areas, axes)
    return pairs.select(F.col("r").alias("l"), F.col("l").alias("r"))


def least_cloudy(found: DataFrame, key: str) -> DataFrame:
    """One scene per area, ties by scene id."""
    return found.groupBy(F.col(f"l.{key}").alias(key)).agg(
        F.min_by(F.struct("r.scene_id", "r.cloud"), F.struct("r.cloud", "r.scene_id")).alias("s")).select(key, "s.scene_id", "s.cloud")


def median_mosaic(pixels: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Exact median over scenes per pixel, 0 counting as missing: (keys, median)."""
    valid = pixels.withColumn(value, F.nullif(F.col(value), F.lit(0.0)))
    return distribution.counted_median(valid, keys, value)


def incomplete(expected: DataFrame, mosaic: DataFrame, key: str, pixels_per_image: int) -> DataFrame:
    """Hotspots without a scene or with a missing pixel."""
    counts = mosaic.filter(F.col("median").isNotNull()).groupBy(key).agg(F.count("*").alias("present"))
    joined = expected.select(key).join(counts, key, "left").withColumn("present", F.coalesce("present", F.lit(0)))
    return joined.filter(F.col("present") < pixels_per_image)


def mosaic_first(pixels: DataFrame, keys: Sequence[str], order: str, value: str = "value") -> DataFrame:
    """First non-missing value per pixel in tile order, as whole numbers."""
    return pixels.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).cast("int").alias(value))


def tile_query(queries: DataFrame, tiles: DataFrame, axes, key: str, strict: bool = False) -> DataFrame:
    """(key, tile_id) of tiles overlapping each query box; with ``strict`` a query without a tile is an error."""
    found = boxes.overlap_join(queries, tiles, axes).select(F.col(f"l.{key}").alias(key), F.col("r.tile_id").alias("tile_id"))
    if not strict:
        return found
    message = F.concat(F.lit("no tile overlaps query "), F.col(key).cast("string"))
    checked = queries.select(key).join(found, key, "left")
    return checked.withColumn("tile_id", F.when(F.col("tile_id").isNull(), F.raise_error(message).cast("bigint")).otherwise(F.col("tile_id")))


def tile_spans(scenes: DataFrame, axes: Sequence[boxes.Axis], time: boxes.Axis) -> DataFrame:
    """Tiles with their footprint on ``axes`` and the spans of time that their scenes cover, instead of one box for each scene."""
    return boxes.merged_spans(scenes, ["tile_id", *[c for a in axes for c in (a.low, a.high)]], time)


def sibling_name(name: Column, band: str, resolution: str) -> Column:
    """Name of the same tile's file for another band and resolution."""
    return F.regexp_replace(F.regexp_replace(name, r"_B\w\w_", f"_{band}_"), r"_\d+m\.", f"_{resolution}.")


def bands_from_files(files: DataFrame, lead: str, bands: dict[str, str]) -> DataFrame:
    """Per lead-band file the sibling files of other bands: (file, one column per band)."""
    leads = files.filter(F.col("file").contains(f"_{lead}_")).select("file")
    wanted = F.array(*[F.struct(F.lit(b).alias("band"), sibling_name(F.col("file"), b, r).alias("sibling")) for b, r in bands.items()])
    asked = leads.select("file", F.inline(wanted))
    found = asked.join(files.select(F.col("file").alias("sibling"), "size"), "sibling")
    return found.groupBy("file").pivot("band", list(bands)).agg(F.first("size"))
