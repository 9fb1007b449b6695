"""Environmental rasters and patches.

A raster is a table of pixels (row, col, values) with all layers of one resolution stacked in ``values``, so sampling
every layer at a point is a single equi-join. Patch arithmetic is row-local.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions import arrays
from fieldmark.operators import ranges

BLOCK = 64  # pixels per strip


class Grid(NamedTuple):
    """North-up grid: position of the upper left corner and pixel size in degrees."""

    top: float
    left: float
    dlat: float
    dlon: float

    def row(self, lat: Column) -> Column:
        return F.floor((F.lit(self.top) - lat) / F.lit(self.dlat))

    def col(self, lon: Column) -> Column:
        return F.floor((lon - F.lit(self.left)) / F.lit(self.dlon))

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        lat = F.lit(self.top) - (row + F.lit(0.5)) * F.lit(self.dlat)
        return lat, F.lit(self.left) + (col + F.lit(0.5)) * F.lit(self.dlon)


GRID = Grid(34.0, -100.0, 0.16, 0.4)


def stack_layers(pixels: DataFrame, layers: int) -> DataFrame:
    """Long pixels (layer, row, col, value) of equally sized rasters to one row per pixel; a group has one entry per
    layer."""
    entries = F.sort_array(F.collect_list(F.struct(F.col("layer").cast("int").alias("idx"), "value")))
    return pixels.groupBy("row", "col").agg(entries.alias("e")).select(
        "row", "col", arrays.scatter(F.col("e"), F.lit(layers), fill=None).alias("values"))


def locate(points: DataFrame, grid: Grid) -> DataFrame:
    return points.withColumns({"row": grid.row(F.col("lat")), "col": grid.col(F.col("lon"))})


def sample(points: DataFrame, raster: DataFrame, grid: Grid, out_of_bounds: str = "ignore", values: str = "env") -> DataFrame:
    """Points with the layer vector of their pixel. Outside the raster: NULL vector (``ignore``), a NULL vector and
    ``outside`` = true (``warn``), or a run-time error (``error``)."""
    located = locate(points, grid)
    pixels = raster.select("row", "col", F.col("values").alias(values), F.lit(True).alias("_in"))
    joined = located.join(pixels, ["row", "col"], "left")
    if out_of_bounds == "error":
        message = F.format_string("coordinates outside the raster: %s %s", F.col("lat").cast("string"), F.col("lon").cast("string"))
        joined = joined.withColumn("row", F.when(F.col("_in").isNull(), F.raise_error(message).cast("bigint")).otherwise(F.col("row")))
    elif out_of_bounds == "warn":
        joined = joined.withColumn("outside", F.col("_in").isNull())
    return joined.drop("_in")


def layer_value(vector: str, layer: int) -> Column:
    return F.get(F.col(vector), F.lit(layer))


def layer_subset(vector: str, start: int, count: int) -> Column:
    return F.slice(vector, start + 1, count)


def add_missing_layers(rows: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """One column per layer, by name, for names not present yet."""
    return rows.select("*", *[layer_value(vector, i).alias(n) for i, n in enumerate(names) if n not in rows.columns]).drop(vector)


def strips(raster: DataFrame) -> DataFrame:
    """Pixels regrouped as short row strips of at most ``BLOCK`` pixels."""
    block = F.floor(F.col("col") / BLOCK).alias("block")
    return raster.groupBy("row", block).agg(F.sort_array(F.collect_list(F.struct("col", "values"))).alias("strip"))


def extract_patches(points: DataFrame, raster: DataFrame, grid: Grid, size: int, layers: int, key: str = "hotspot_id") -> DataFrame:
    """(key, patch) with rows [r-h, r+h) and columns [c-h, c+h), h = size // 2; pixels off the raster are NULL.

    A point asks for ``size`` row strips instead of size x size pixels, and gets at most 2 x size pieces back.
    """
    half = size // 2
    wanted = locate(points.select(key, "lat", "lon"), grid).select(key, F.col("row").alias("r0"), F.col("col").alias("c0"))
    wanted = wanted.withColumn("row", F.explode(F.sequence(F.col("r0") - half, F.col("r0") + (half - 1))))
    wanted = wanted.withColumn("block", F.explode(F.sequence(F.floor((F.col("c0") - half) / BLOCK), F.floor((F.col("c0") + (half - 1)) / BLOCK))))
    joined = wanted.join(strips(raster), ["row", "block"], "left")
    first_row, first_col = F.col("r0") - half, F.col("c0") - half
    side = 2 * half

    def place(p: Column) -> Column:
        x = p["col"] - first_col
        return F.struct(((F.col("row") - first_row) * side + x).cast("int").alias("idx"), p["values"].alias("value"))

    inside = F.filter("strip", lambda p: (p["col"] >= first_col) & (p["col"] < first_col + side))
    pieces = joined.select(key, F.coalesce(F.transform(inside, place), F.array().cast(
        "array<struct<idx:int,value:array<double>>>")).alias("piece"))
    whole = pieces.groupBy(key).agg(F.sort_array(F.flatten(F.collect_list("piece"))).alias("pixels"))

    # pixels are put in place once, with all their layers; each layer then reads its own value from every place
    placed = arrays.scatter(F.col("pixels"), F.lit(side * side), fill=None, kind="array<double>")
    data = arrays.let(placed, lambda places: F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(layers - 1)), lambda i: F.transform(places, lambda values: F.get(values, i)))))
    return whole.select(key, arrays.patch(data, layers, side, side).alias("img"))


def window_from_bounds(areas: DataFrame, raster: DataFrame, grid: Grid, key: str) -> DataFrame:
    """Pixels of the window covering each area (minx, maxx, miny, maxy): (key, y, x, values), all bands stacked."""
    r0, r1 = grid.row(F.col("maxy")), grid.row(F.col("miny"))
    c0, c1 = grid.col(F.col("minx")), grid.col(F.col("maxx"))
    wanted = areas.select(key, r0.alias("r0"), r1.alias("r1"), c0.alias("c0"), c1.alias("c1"))
    wanted = wanted.withColumn("row", F.explode(F.sequence("r0", "r1")))
    wanted = wanted.withColumn("block", F.explode(F.sequence(F.floor(F.col("c0") / BLOCK), F.floor(F.col("c1") / BLOCK))))
    inside = F.filter("strip", lambda p: (p["col"] >= F.col("c0")) & (p["col"] <= F.col("c1")))
    found = wanted.join(strips(raster), ["row", "block"]).select(key, "row", "r0", "c0", F.inline(inside))
    return found.select(key, (F.col("row") - F.col("r0")).alias("y"), (F.col("col") - F.col("c0")).alias("x"), "values")


def clip_to_polygon(raster: DataFrame, polygons: DataFrame, grid: Grid) -> DataFrame:
    """Pixels whose centre lies strictly inside a polygon, in long form."""
    lat, lon = grid.centre(F.col("row"), F.col("col"))
    centres = raster.select(F.struct("row", "col").alias("cell"), lat.alias("lat"), lon.alias("lon"))
    inside = ranges.keep_inside(centres, polygons, "cell").select("cell.row", "cell.col")
    kept = raster.join(inside, ["row", "col"], "left_semi")
    return kept.select("row", "col", arrays.unrolled("values", "layer", "value"))


# --------------------------------------------------------------------------- patches

def _line(values: Column, step: Column, start: Column, length: Column, place: Column) -> Column:
    """Linear interpolation along one line at ``place``; beyond the outermost valid pixel its value is carried on."""

    def value(k: Column) -> Column:
        return arrays.at(values, start + k * step)

    valid = F.filter(F.sequence(F.lit(0), length.cast("int") - 1), lambda k: value(k).isNotNull())
    ends = F.struct(F.array_max(F.filter(valid, lambda k: k < place)).alias("left"),
                    F.array_min(F.filter(valid, lambda k: k > place)).alias("right"))
    return arrays.let(ends, lambda e: _between(e["left"], e["right"], value, place))


def _between(left: Column, right: Column, value, place: Column) -> Column:
    lv, rv = value(left), value(right)
    both = lv + (rv - lv) * (place - left) / F.when(right > left, right - left)
    return F.when(left.isNull(), rv).when(right.isNull(), lv).otherwise(both)


@arrays.on_image
def interpolate_gaps(img: Column) -> Column:
    """Fill missing pixels of partly missing bands: mean of the linear interpolations along row and column, or of
    whichever exists, else the mean of the band. Valid pixels and fully missing bands stay as they are."""
    h, w = img["h"], img["w"]

    def band(values: Column) -> Column:
        def fill(v: Column, i: Column) -> Column:
            y, x = F.floor(i / w), i % w
            row = _line(values, F.lit(1), y * w, w, x)
            col = _line(values, w, x, h, y)
            estimate = arrays.let(F.struct(row.alias("r"), col.alias("c")), lambda s: F.when(s["r"].isNull(), s["c"]).when(
                s["c"].isNull(), s["r"]).otherwise((s["r"] + s["c"]) / 2))
            return F.when(v.isNotNull(), v).otherwise(F.coalesce(estimate, arrays.mean(values)))

        return F.transform(values, fill)

    bands = F.transform(F.sequence(F.lit(0), img["bands"] - 1), lambda b: arrays.let(arrays.band_slice(img, b), band))
    return arrays.patch(F.flatten(bands), img["bands"], h, w)


def fill_means(img: Column, means: Column) -> Column:
    return arrays.map_pixels(img, lambda v, band: F.coalesce(v, arrays.at(means, band)))


def filled_layers(img: Column) -> Column:
    """Number of bands with a missing pixel."""
    return F.size(F.filter(arrays.per_band(img, lambda b: F.exists(b, lambda v: v.isNull())), lambda x: x))


def clip_layers(img: Column, low: Column, high: Column) -> Column:
    """Clamp each band to its bounds; missing pixels stay missing."""
    return arrays.map_pixels(img, lambda v, band: F.when(
        v.isNotNull(), F.greatest(F.least(v, arrays.at(high, band)), arrays.at(low, band))))


def layer_ranges(patches: DataFrame, img: str = "img") -> DataFrame:
    """(band, low, high, gaps): extremes over all patches and the number of patches with a gap in the band.

    Bands are reduced inside the row first; one short row per band and patch is aggregated.
    """
    summary = arrays.per_band(F.col(img), lambda b: F.struct(
        F.array_min(b).alias("low"), F.array_max(b).alias("high"), F.exists(b, lambda v: v.isNull()).alias("gap")))
    return patches.select(arrays.unrolled(summary, "band", "s")).groupBy("band").agg(
        F.min("s.low").alias("low"), F.max("s.high").alias("high"), F.count_if(F.col("s.gap")).alias("gaps"))


@arrays.on_image
def percentile_stretch(img: Column, low: float = 0.02, high: float = 0.98) -> Column:
    """Scale an image to its own percentiles, clipped to [0, 1]."""

    def quantile(ordered: Column, q: float) -> Column:
        pos = F.lit(float(q)) * (F.size(ordered) - 1)
        a, b = arrays.at(ordered, F.floor(pos)), arrays.at(ordered, F.ceil(pos))
        return a + (b - a) * (pos - F.floor(pos))

    def ends(ordered: Column) -> Column:
        return F.struct(quantile(ordered, low).alias("lo"), quantile(ordered, high).alias("hi"))

    def stretch(e: Column) -> Column:
        return arrays.map_pixels(img, lambda v, band: F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(
            F.lit(1.0), (v - e["lo"]) / F.nullif(e["hi"] - e["lo"], F.lit(0.0))))))

    return arrays.let(arrays.let(F.sort_array(arrays.present(img["data"])), ends), stretch)
