"""Species range polygons against hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions import arrays
from fieldmark.operators import cells, regions
from fieldmark.session import materialize


def inside_pairs(points: DataFrame, polygons: DataFrame, point_key: str, polygon_key: str, coarsest: float = regions.COARSEST) -> DataFrame:
    """Distinct (point, polygon key) with the point strictly inside any polygon of that key.

    Polygons are cut into cells once; a point falls into one cell of each size in use and meets the few edges held there.
    Cells are broadcast if they are few, and points dealt out evenly; else both sides meet on the cell, with crowded cells
    dealt out. Points without a place are inside nothing.
    """
    placed = points.select(point_key, "lon", "lat").filter(
        F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan(F.col("lon").cast("double")) & ~F.isnan(F.col("lat").cast("double")))
    cut = materialize(regions.cut(polygons, polygon_key, coarsest).withColumnRenamed(polygon_key, "_polygon"), "polygon-cells")
    levels = cut.agg(F.collect_set("level").alias("levels")).select("levels").scalar()  # some tens of sizes at most
    at = placed.select(F.col(point_key).alias("_point"), "lon", "lat", levels.alias("levels")).withColumn("level", F.explode("levels")).drop("levels")
    size = F.pow(F.lit(2.0), F.col("level"))
    at = at.withColumns({"cx": F.floor(F.col("lon") / size).cast("bigint"), "cy": F.floor(F.col("lat") / size).cast("bigint")})
    keys = ["level", "cx", "cy"]
    sized = cells.if_small(cut, F.lit(80) + 32 * F.size("edges") + 8 * F.size("turns"))
    if sized is not cut:
        pairs = at.repartition("_point").join(sized, keys)  # edge tests cost more than moving points: use every core
    else:
        pairs = cells.join(materialize(at, "placed"), cut, keys, F.xxhash64("_point"))
    hit = pairs.filter(regions.inside_cell(F.col("lon"), F.col("lat"), F.col("edges"), F.col("turns"), F.col("odd")))
    return hit.select(F.col("_point").alias(point_key), F.col("_polygon").alias(polygon_key)).distinct()


def _indicator(entries: Column, size: Column) -> Column:
    return arrays.scatter(F.transform(entries, lambda i: F.struct(i.cast("int").alias("idx"), F.lit(1.0).alias("value"))), size)


def range_masks(hotspots: DataFrame, polygons: DataFrame, species_list: DataFrame) -> DataFrame:
    """(hotspot_id, in_range, mask): vectors over the species list.

    ``in_range`` is true/false for species with geometry and NULL otherwise; ``mask`` turns NULL into true.
    The sparse hits are collected per hotspot (at most one per species) and widened inside the row.
    """
    size = species_list.agg(F.count("*").alias("n")).select("n").scalar()
    listed = polygons.agg(F.array_sort(F.collect_set("species_idx")).alias("k")).select("k").scalar()
    hits = (inside_pairs(hotspots, polygons, "hotspot_id", "species_idx").groupBy("hotspot_id")
            .agg(F.sort_array(F.collect_list("species_idx")).alias("hits")))
    empty = F.array().cast("array<bigint>")
    per_hotspot = hotspots.select("hotspot_id").join(hits, "hotspot_id", "left").select(
        "hotspot_id", F.coalesce(F.col("hits").cast("array<bigint>"), empty).alias("hits"), size.alias("s"), listed.alias("listed"))
    dense = per_hotspot.select("hotspot_id", _indicator(F.col("hits"), F.col("s")).alias("d"), _indicator(F.col("listed"), F.col("s")).alias("k"))
    in_range = F.zip_with("d", "k", lambda d, k: F.when(k > 0, d > 0))
    return dense.select("hotspot_id", in_range.alias("in_range")).withColumn(
        "mask", F.transform("in_range", lambda r: F.coalesce(r, F.lit(True))))


def masked(vector: str | Column, mask: str | Column) -> Column:
    return F.zip_with(vector, mask, lambda v, m: F.when(m, v).otherwise(F.lit(0.0)))


def correct_targets(targets: DataFrame, masks: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Rates outside the range set to 0, for hotspots not in ``done``."""
    todo = targets if done is None else targets.join(done.select("hotspot_id"), "hotspot_id", "left_anti")
    return todo.join(masks.select("hotspot_id", "mask"), "hotspot_id").withColumn("probs", masked("probs", "mask")).drop("mask")


def masked_predictions(predictions: DataFrame, masks: DataFrame, subset: Column | None = None, soft: bool = False) -> DataFrame:
    """Targets and predictions times the mask (targets only when ``soft``), optionally on a species subset."""
    joined = predictions.join(masks.select("hotspot_id", "mask"), "hotspot_id")
    out = joined.withColumn("y", masked("y", "mask"))
    if not soft:
        out = out.withColumn("p", masked("p", "mask"))
    if subset is not None:
        def pick(vector: Column) -> Column:
            return F.transform(subset, lambda i: F.get(vector, i))

        out = out.withColumns({"y": pick(F.col("y")), "p": pick(F.col("p"))})
    return out.drop("mask")


def keep_inside(points: DataFrame, boundary: DataFrame, key: str) -> DataFrame:
    """Points strictly inside any boundary polygon."""
    tagged = boundary.select("rings", F.lit(0).alias("boundary"))
    return points.join(inside_pairs(points, tagged, key, "boundary").select(key), key, "left_semi")
