"""Environmental rasters, patches and normalization statistics."""

from pyspark.sql import functions as F

from fieldmark import schemas
from fieldmark.functions import arrays, transforms
from fieldmark.operators import raster, samples, stats
from fieldmark.plans.catalog import query
from fieldmark.plans.inputs import split_of

PIXEL = 'CAST(floor((34e0 - lat) / 16e-2) AS BIGINT) AS "row", CAST(floor((lon + 1e2) / 4e-1) AS BIGINT) AS col'
LOCATED = f"(SELECT hotspot_id, site_key, lat, lon, {PIXEL} FROM fx_site)"


@query("sample_point", f"""
SELECT hotspot_id, value FROM {LOCATED} s LEFT JOIN (SELECT * FROM fx_raster WHERE layer = 3) r ON r."row" = s."row" AND r.col = s.col""", "value")
def sample_point(d):
    return raster.sample(d.site, d.raster, raster.GRID).select("hotspot_id", raster.layer_value("env", 3).alias("value"))


@query("sample_all_rasters", f"""
SELECT hotspot_id, CASE WHEN layer < 19 THEN 'climate' ELSE 'soil' END AS part, CASE WHEN layer < 19 THEN layer ELSE layer - 19 END AS pos, value
FROM {LOCATED} s JOIN fx_raster r ON r."row" = s."row" AND r.col = s.col""", "value", "pos")
def sample_all_rasters(d):
    sampled = raster.sample(d.site, d.raster, raster.GRID)
    parts = F.array(F.struct(F.lit("climate").alias("part"), raster.layer_subset("env", 0, 19).alias("v")),
                    F.struct(F.lit("soil").alias("part"), raster.layer_subset("env", 19, 8).alias("v")))
    inside = sampled.filter(F.col("env").isNotNull())
    return inside.select("hotspot_id", F.inline(parts)).select("hotspot_id", "part", arrays.unrolled("v", "pos", "value"))


@query("out_of_bounds_policy", """
SELECT hotspot_id, r.value IS NULL AND r.layer IS NULL AS outside, value FROM (
  SELECT hotspot_id, CAST(floor((34e0 - (lat + 2e0)) / 16e-2) AS BIGINT) AS "row", CAST(floor((lon + 1e2) / 4e-1) AS BIGINT) AS col FROM fx_site) s
LEFT JOIN (SELECT * FROM fx_raster WHERE layer = 0) r ON r."row" = s."row" AND r.col = s.col""", "value")
def out_of_bounds_policy(d):
    shifted = d.site.withColumn("lat", F.col("lat") + 2)
    sampled = raster.sample(shifted, d.raster, raster.GRID, out_of_bounds="warn")
    return sampled.select("hotspot_id", "outside", raster.layer_value("env", 0).alias("value"))


@query("extract_patch", f"""
SELECT s.hotspot_id, layer AS band, r."row" - s."row" + 2 AS y, r.col - s.col + 2 AS x, value
FROM {LOCATED} s JOIN fx_raster r ON r."row" BETWEEN s."row" - 2 AND s."row" + 1 AND r.col BETWEEN s.col - 2 AND s.col + 1
WHERE value IS NOT NULL""", "value", "band y x")
def extract_patch(d):
    patches = raster.extract_patches(d.site, d.raster, raster.GRID, size=4, layers=27)
    return samples.pixels(patches, "hotspot_id").filter(F.col("value").isNotNull())


@query("add_env_columns", f"""
SELECT s.hotspot_id, s.lat AS bio_1, max(CASE WHEN layer = 1 THEN value END) AS bio_2, max(CASE WHEN layer = 26 THEN value END) AS sndppt
FROM {LOCATED} s LEFT JOIN fx_raster r ON r."row" = s."row" AND r.col = s.col GROUP BY s.hotspot_id, s.lat""", "bio_1 bio_2 sndppt")
def add_env_columns(d):
    sampled = raster.sample(d.site.withColumn("bio_1", F.col("lat")), d.raster, raster.GRID)
    return raster.add_missing_layers(sampled, "env", schemas.ENVIRONMENT).select("hotspot_id", "bio_1", "bio_2", "sndppt")


@query("env_vector_table", f"""
SELECT occurrence_id, layer, value FROM (SELECT occurrence_id, {PIXEL} FROM fx_occ) s
JOIN fx_raster r ON r."row" = s."row" AND r.col = s.col""", "value", "layer")
def env_vector_table(d):
    sampled = raster.sample(d.occ.select("occurrence_id", "lat", "lon"), d.raster, raster.GRID)
    rows = sampled.filter(F.col("env").isNotNull()).select("occurrence_id", arrays.unrolled("env", "layer", "value"))
    return rows.orderBy("occurrence_id", "layer")


def neighbour(part, order):
    before = f"PARTITION BY patch_key, band, {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    after = f"PARTITION BY patch_key, band, {part} ORDER BY {order} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
    at = f"CASE WHEN value IS NOT NULL THEN {order} END"
    return [f"last_value(value IGNORE NULLS) OVER ({before})", f"last_value({at} IGNORE NULLS) OVER ({before})",
            f"first_value(value IGNORE NULLS) OVER ({after})", f"first_value({at} IGNORE NULLS) OVER ({after})"]


LINES = ", ".join(f"{e} AS {n}" for e, n in zip(neighbour("y", "x") + neighbour("x", "y"), ["lv", "lx", "rv", "rx", "uv", "uy", "dv", "dy"]))


@query("interpolate_nan", f"""
WITH n AS (SELECT *, {LINES}, avg(value) OVER (PARTITION BY patch_key, band) AS band_mean FROM fx_patch),
 e AS (SELECT *, CASE WHEN lx IS NULL THEN rv WHEN rx IS NULL THEN lv ELSE lv + (rv - lv) * (x - lx) / (rx - lx) END AS re,
   CASE WHEN uy IS NULL THEN dv WHEN dy IS NULL THEN uv ELSE uv + (dv - uv) * (y - uy) / (dy - uy) END AS ce FROM n)
SELECT patch_key, band, y, x, coalesce(value, CASE WHEN re IS NULL THEN ce WHEN ce IS NULL THEN re ELSE (re + ce) / 2 END, band_mean) AS value FROM e""",
       "value", "band y x")
def interpolate_nan(d):
    filled = d.patch.withColumn("img", raster.interpolate_gaps(F.col("img")))
    return samples.pixels(filled, "patch_key")


@query("fill_layer_mean", """
SELECT p.patch_key, band, y, x, coalesce(p.value, m) AS value, sum(CASE WHEN p.value IS NULL AND first THEN 1 ELSE 0 END) OVER (PARTITION BY p.patch_key) AS filled
FROM (SELECT *, row_number() OVER (PARTITION BY patch_key, band ORDER BY value IS NOT NULL, y, x) = 1 AS first FROM fx_patch) p
JOIN (SELECT layer, avg(value) AS m FROM fx_env WHERE layer < 4 GROUP BY layer) t ON t.layer = p.band""", "value", "band y x filled")
def fill_layer_mean(d):
    means = stats.vector_of(stats.point_stats(d.env_wide.select(F.slice("env", 1, 4).alias("env")), "env"), "layer", "mean")
    rows = d.patch.withColumn("means", means).select(
        "patch_key", F.struct("patch_key", raster.filled_layers(F.col("img")).alias("filled")).alias("key"),
        raster.fill_means(F.col("img"), F.col("means")).alias("img"))
    return samples.pixels(rows, "key").select("key.patch_key", "band", "y", "x", "value", "key.filled")


@query("clip_layers", """
SELECT patch_key, band, y, x, CASE WHEN value IS NULL THEN NULL ELSE greatest(least(value, 5e-2 + band * 1e-2), -5e-2) END AS value FROM fx_patch""", "value", "band y x")
def clip_layers(d):
    low, high = arrays.literal_vector([-0.05] * 4), arrays.literal_vector([0.05, 0.06, 0.07, 0.08])
    return samples.pixels(d.patch.withColumn("img", raster.clip_layers(F.col("img"), low, high)), "patch_key")


@query("layer_min_max", """
SELECT band, min(value) AS low, max(value) AS high, count(DISTINCT CASE WHEN value IS NULL THEN patch_key END) AS gaps FROM fx_patch GROUP BY band""", "low high", "band gaps")
def layer_min_max(d):
    return raster.layer_ranges(d.patch)


@query("file_set_diff", """
SELECT vec_id AS id, 'copied' AS action FROM embeddings WHERE vec_id NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT vec_id, 'removed' FROM embeddings WHERE vec_id IN (SELECT s_suppkey FROM supplier)""")
def file_set_diff(d):
    a, b = d.table("embeddings").select(F.col("vec_id").alias("id")), d.table("supplier").select(F.col("s_suppkey").alias("id"))
    tagged = a.join(b.select("id", F.lit("removed").alias("action")).distinct(), "id", "left")
    return tagged.select("id", F.coalesce("action", F.lit("copied")).alias("action"))


@query("missing_flag", """
SELECT env_key, max(CASE WHEN layer < 19 AND value IS NULL THEN 1 ELSE 0 END) = 1 AS climate_missing,
       max(CASE WHEN layer >= 19 AND value IS NULL THEN 1 ELSE 0 END) = 1 AS soil_missing FROM fx_env GROUP BY env_key""")
def missing_flag(d):
    def gap(v):
        return F.exists(v, lambda x: x.isNull())

    return d.env_wide.select("env_key", gap(F.slice("env", 1, 19)).alias("climate_missing"), gap(F.slice("env", 20, 8)).alias("soil_missing"))


@query("percentile_stretch", """
SELECT patch_key, band, y, x, CASE WHEN value IS NOT NULL THEN greatest(0e0, least(1e0, (value - lo) / (hi - lo))) END AS value FROM fx_patch
JOIN (SELECT patch_key AS k, quantile_cont(value, 2e-2) AS lo, quantile_cont(value, 98e-2) AS hi FROM fx_patch GROUP BY patch_key) q ON k = patch_key""",
       "value", "band y x")
def percentile_stretch(d):
    return samples.pixels(d.patch.withColumn("img", raster.percentile_stretch(F.col("img"))), "patch_key")


@query("center_crop", "SELECT patch_key, band, y - 1 AS y, x - 1 AS x, value FROM fx_patch WHERE y IN (1, 2) AND x IN (1, 2)", "value", "band y x")
def center_crop(d):
    return samples.pixels(d.patch.withColumn("img", transforms.center_crop_half(F.col("img"), 2)), "patch_key")


CROP = "FROM fx_image WHERE y IN (1, 2) AND x IN (1, 2)"


@query("image_channel_means", f"""
SELECT band, avg(m) AS mean FROM (SELECT patch_key, band, avg(value) AS m {CROP} GROUP BY patch_key, band) t GROUP BY band""", "mean", "band")
def image_channel_means(d):
    return stats.band_means(d.image, crop=2)


@query("image_channel_stds", f"""
SELECT t.band, sqrt(avg(s)) AS std FROM (
  SELECT patch_key, i.band, sum((value - mu) * (value - mu)) / 4e0 AS s FROM (SELECT * {CROP}) i
  JOIN (SELECT band, avg(m) AS mu FROM (SELECT patch_key, band, avg(value) AS m {CROP} GROUP BY patch_key, band) u GROUP BY band) g ON g.band = i.band
  GROUP BY patch_key, i.band) t GROUP BY t.band""", "std", "band")
def image_channel_stds(d):
    means = stats.vector_of(stats.band_means(d.image, crop=2), "band", "mean")
    return stats.band_deviations(d.image, means, crop=2)


@query("visual_means_stds", """
WITH i AS (SELECT * FROM fx_image WHERE band < 3), m AS (SELECT band, avg(a) AS mean FROM (SELECT patch_key, band, avg(value) AS a FROM i GROUP BY patch_key, band) t GROUP BY band),
 s AS (SELECT patch_key, i.band, sum((value - mean) * (value - mean)) / 16e0 AS s FROM i JOIN m ON m.band = i.band GROUP BY patch_key, i.band)
SELECT m.band, max(mean) AS mean, sqrt(avg(s)) AS std FROM m JOIN s ON s.band = m.band GROUP BY m.band""", "mean std", "band")
def visual_means_stds(d):
    visual = d.image.withColumn("img", transforms.take_bands(F.col("img"), 0, 3))
    return stats.band_stats(visual, crop=None)


@query("env_point_stats", "SELECT layer, avg(value) AS mean, stddev_pop(value) AS std FROM fx_env WHERE env_key % 10 < 7 GROUP BY layer", "mean std", "layer")
def env_point_stats(d):
    return stats.point_stats(d.env_wide.filter(split_of(F.col("env_key")) == "train"), "env")


@query("env_patch_stats", """
WITH m AS (SELECT band, avg(a) AS mean FROM (SELECT patch_key, band, avg(value) AS a FROM fx_patch GROUP BY patch_key, band) t GROUP BY band),
 s AS (SELECT patch_key, p.band, coalesce(sum((value - mean) * (value - mean)), 0) / 16e0 AS s FROM fx_patch p JOIN m ON m.band = p.band GROUP BY patch_key, p.band)
SELECT m.band, max(mean) AS mean, sqrt(avg(s)) AS std FROM m JOIN s ON s.band = m.band GROUP BY m.band""", "mean std", "band")
def env_patch_stats(d):
    return stats.band_stats(d.patch, crop=None, divisor=16)


@query("streaming_pixel_mean", """
SELECT band * 16 + y * 4 + x AS pos, avg(value) AS mean, stddev_pop(value) AS std FROM fx_image GROUP BY 1""", "mean std", "pos")
def streaming_pixel_mean(d):
    return stats.pixel_stats(d.image)
