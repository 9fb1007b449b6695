"""Scenes, tiles, time."""

from pyspark.sql import functions as F

from fieldmark.functions import arrays
from fieldmark.functions import time
from fieldmark.operators import boxes, raster, samples, scenes
from fieldmark.plans.catalog import query
from fieldmark.plans.q_spatial import DAYS, OVERLAP, SCENE_BOX, SITE_BOX, scene_boxes, site_boxes

FOUND = f"""
WITH f AS (SELECT q.site_key, b.scene_id, b.cloud FROM {SITE_BOX} q JOIN {SCENE_BOX} b
  ON q.minx <= b.maxx AND q.maxx >= b.minx AND q.miny <= b.maxy AND q.maxy >= b.miny
  WHERE acquired BETWEEN DATE '1998-06-01' AND DATE '1998-07-31' AND cloud < 10)"""


def found(d, clearest=False):
    areas = site_boxes(d).drop("hotspot_id", "mint", "maxt")
    return scenes.search(areas, scene_boxes(d).drop("tile_id", "mint", "maxt"), "1998-06-01", "1998-07-31", 10, clearest)


@query("scene_search", FOUND + " SELECT site_key, scene_id FROM f")
def scene_search(d):
    return found(d).select("l.site_key", "r.scene_id")


@query("least_cloudy", FOUND + """
SELECT site_key, scene_id, cloud FROM (SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY cloud, scene_id) AS rk FROM f) t WHERE rk = 1""", "cloud")
def least_cloudy(d):
    return scenes.least_cloudy(found(d, clearest=True), "site_key")


PIXELS = "(SELECT patch_key % 25 AS tile, band, y, x, CASE WHEN (patch_key + band + y + x) % 3 = 0 OR (patch_key % 25 < 2 AND x = 1) THEN NULL ELSE value END AS value FROM fx_image) i"


def scene_pixels(d):
    """20 scenes or more per tile; zeros mark missing pixels, two tiles never see one column."""
    p = samples.pixels(d.image, "patch_key")
    k = F.col("patch_key")
    gap = ((k + F.col("band") + F.col("y") + F.col("x")) % 3 == 0) | ((k % 25 < 2) & (F.col("x") == 1))
    return p.select((k % 25).alias("tile"), "patch_key", "band", "y", "x", F.when(gap, 0.0).otherwise(F.col("value")).alias("value"))


@query("median_mosaic", f"SELECT tile, band, y, x, median(value) AS median FROM {PIXELS} WHERE value IS NOT NULL AND value <> 0 GROUP BY tile, band, y, x", "median", "band y x")
def median_mosaic(d):
    return scenes.median_mosaic(scene_pixels(d), ["tile", "band", "y", "x"])


@query("incomplete_mosaics", f"""
WITH m AS (SELECT tile, count(*) AS present FROM (SELECT tile, band, y, x FROM {PIXELS} WHERE value IS NOT NULL AND value <> 0 GROUP BY tile, band, y, x) t GROUP BY tile)
SELECT e.tile, coalesce(present, 0) AS present FROM (SELECT DISTINCT vec_id % 27 AS tile FROM embeddings) e LEFT JOIN m ON m.tile = e.tile
WHERE coalesce(present, 0) < 64""", bigints="present")
def incomplete_mosaics(d):
    expected = d.table("embeddings").select((F.col("vec_id") % 27).alias("tile")).distinct()
    return scenes.incomplete(expected, scenes.median_mosaic(scene_pixels(d), ["tile", "band", "y", "x"]), "tile", 64)


@query("window_from_bounds", """
SELECT hotspot_id, r."row" - r0 AS y, r.col - c0 AS x, layer, value FROM (
  SELECT hotspot_id, CAST(floor((34e0 - (lat + 2e-1)) / 16e-2) AS BIGINT) AS r0, CAST(floor((34e0 - (lat - 2e-1)) / 16e-2) AS BIGINT) AS r1,
         CAST(floor((lon - 2e-1 + 1e2) / 4e-1) AS BIGINT) AS c0, CAST(floor((lon + 2e-1 + 1e2) / 4e-1) AS BIGINT) AS c1 FROM fx_site) s
JOIN fx_raster r ON r."row" BETWEEN r0 AND r1 AND r.col BETWEEN c0 AND c1""", "value", "y x layer")
def window_from_bounds(d):
    areas = d.site.select("hotspot_id", (F.col("lon") - 0.2).alias("minx"), (F.col("lon") + 0.2).alias("maxx"),
                          (F.col("lat") - 0.2).alias("miny"), (F.col("lat") + 0.2).alias("maxy"))
    window = raster.window_from_bounds(areas, d.raster, raster.GRID, "hotspot_id")
    return window.select("hotspot_id", "y", "x", arrays.unrolled("values", "layer", "value"))


FORMATS = {"%Y": ("yyyy", "year"), "%Y-%m": ("yyyy-MM", "month"), "%Y%m%d": ("yyyyMMdd", "day"), "%Y-%m-%d %H": ("yyyy-MM-dd HH", "hour"),
           "%Y-%m-%d %H:%M": ("yyyy-MM-dd HH:mm", "minute"), "%Y-%m-%d %H:%M:%S": ("yyyy-MM-dd HH:mm:ss", "second")}


@query("disambiguate_timestamp", " UNION ALL ".join(f"""
SELECT event_id, '{unit}' AS resolution, date_trunc('{unit}', ts) - INTERVAL 1 MICROSECOND AS mint,
       date_trunc('{unit}', ts) + INTERVAL 1 {unit} - INTERVAL 1 MICROSECOND AS maxt FROM events""" for _, unit in FORMATS.values()))
def disambiguate_timestamp(d):
    events = d.table("events")
    out = None
    for fmt, (pattern, unit) in FORMATS.items():
        part = events.select("event_id", F.lit(unit).alias("resolution"), time.interval_of(F.date_format("ts", pattern), fmt).alias("i"))
        part = part.select("event_id", "resolution", "i.mint", "i.maxt")
        out = part if out is None else out.unionByName(part)
    return out


@query("tile_query", f"""
SELECT DISTINCT q.site_key, b.tile_id FROM {SITE_BOX} q JOIN fx_tile b ON q.minx <= b.maxx AND q.maxx >= b.minx AND q.miny <= b.maxy AND q.maxy >= b.miny""")
def tile_query(d):
    return scenes.tile_query(site_boxes(d), d.tile, [boxes.LON, boxes.LAT], "site_key")


@query("tile_query_in_time", f"SELECT DISTINCT q.site_key, b.tile_id FROM {SITE_BOX} q JOIN {SCENE_BOX} b ON {OVERLAP}")
def tile_query_in_time(d):
    """The scenes of a tile count as the spans of time that they cover together."""
    place = [boxes.LON, boxes.LAT]
    return scenes.tile_query(site_boxes(d).drop("hotspot_id"), scenes.tile_spans(scene_boxes(d), place, DAYS), [*place, DAYS], "site_key").distinct()


@query("mosaic_first", """
SELECT tile, band, y, x, value FROM (
  SELECT patch_key % 25 AS tile, band, y, x, CAST(1e3 * value AS INTEGER) AS value, row_number() OVER (PARTITION BY patch_key % 25, band, y, x ORDER BY value IS NULL, patch_key) AS rk
  FROM (SELECT patch_key, band, y, x, CASE WHEN (patch_key + band * 16 + y * 4 + x) % 2 = 1 THEN NULL ELSE trunc(value / 1e2) / 1e3 END AS value FROM fx_image) f) t WHERE rk = 1""",
       bigints="band y x value")
def mosaic_first(d):
    p = samples.pixels(d.image, "patch_key")
    gap = (F.col("patch_key") + F.col("band") * 16 + F.col("y") * 4 + F.col("x")) % 2 == 1
    tiles = p.select((F.col("patch_key") % 25).alias("tile"), "patch_key", "band", "y", "x",
                     F.when(~gap, F.col("value") / 100).alias("value"))
    return scenes.mosaic_first(tiles, ["tile", "band", "y", "x"], "patch_key")


@query("bands_from_files", """
SELECT concat('T', CAST(scene_id AS VARCHAR), '_B02_10m.tif') AS file, scene_id * 3 + 1 AS "B03", CASE WHEN scene_id % 4 <> 0 THEN scene_id * 3 + 2 END AS "B11" FROM fx_scene""")
def bands_from_files(d):
    s = F.col("scene_id")
    stem = F.concat(F.lit("T"), s.cast("string"))
    names = F.array(*[F.struct(F.concat(stem, F.lit(f"_{b}_{r}.tif")).alias("file"), (s * 3 + i).alias("size"))
                      for i, (b, r) in enumerate((("B02", "10m"), ("B03", "10m"), ("B11", "20m")))])
    files = d.scene.select(s, F.inline(names)).filter(~((s % 4 == 0) & F.col("file").contains("_B11_"))).select("file", "size")
    return scenes.bands_from_files(files, "B02", {"B03": "10m", "B11": "20m"})
