"""Training-sample assembly."""

from pyspark.sql import functions as F

from fieldmark.functions import arrays, transforms
from fieldmark.operators import samples, stats
from fieldmark.plans.catalog import query
from fieldmark.plans.oracle import normal, uniform
from fieldmark.session import materialize

PX = "band y x"


def shown(df, img):
    return samples.pixels(df.select("patch_key", img.alias("img")), "patch_key")


def img():
    return F.col("img")


@query("band_reorder", "SELECT patch_key, CASE WHEN band = 3 THEN 3 ELSE 2 - band END AS band, y, x, value FROM fx_image", "value", PX)
def band_reorder(d):
    return shown(d.image, transforms.reorder_bands(img(), [2, 1, 0, 3]))


@query("channels_first", """
SELECT patch_key, (band * 16 + y * 4 + x) % 4 AS band, (band * 16 + y * 4 + x) // 16 AS y, (band * 16 + y * 4 + x) // 4 % 4 AS x, value FROM fx_image""", "value", PX)
def channels_first(d):
    return shown(d.image, transforms.channels_first(img()))


@query("normalize", """
WITH m AS (SELECT band, avg(value) AS mean FROM fx_image GROUP BY band),
 t AS (SELECT i.band, mean, sqrt(avg((value - mean) * (value - mean))) AS std FROM fx_image i JOIN m ON m.band = i.band GROUP BY i.band, mean)
SELECT patch_key, i.band, y, x, (value - mean) / std AS value FROM fx_image i JOIN t ON t.band = i.band""", "value", PX)
def normalize(d):
    """Images brought to the means and deviations of their own bands."""
    bands = materialize(stats.band_stats(d.image, None), "band-stats")
    known = d.image.withColumns({"_mean": stats.vector_of(bands, "band", "mean"), "_std": stats.vector_of(bands, "band", "std")})
    return shown(known, transforms.normalize(img(), F.col("_mean"), F.col("_std")))


@query("max_channel_scale", "SELECT patch_key, band, y, x, value / max(value) OVER (PARTITION BY patch_key, band) AS value FROM fx_image", "value", PX)
def max_channel_scale(d):
    return shown(d.image, transforms.max_channel_scale(img()))


@query("scale_255", "SELECT patch_key, band, y, x, value / 255e0 AS value FROM fx_image", "value", PX)
def scale_255(d):
    return shown(d.image, transforms.scale(img(), 255.0))


@query("minmax_scale", """
SELECT patch_key, band, y, x, 1e0 + 2e0 * (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) AS value FROM fx_image
WINDOW w AS (PARTITION BY patch_key)""", "value", PX)
def minmax_scale(d):
    return shown(d.image, transforms.minmax(img(), 1.0, 3.0))


@query("match_resolution", """
SELECT i.patch_key, i.band, y2 AS y, x2 AS x, value FROM fx_image i CROSS JOIN (SELECT unnest(range(6)) AS y2) a CROSS JOIN (SELECT unnest(range(6)) AS x2) b
WHERE i.y = 1 + y2 * 2 // 6 AND i.x = 1 + x2 * 2 // 6""", "value", PX)
def match_resolution(d):
    return shown(d.image, transforms.match_resolution(img(), 20, 10, 6, 6))


@query("match_resolution_empty", """
SELECT vec_id AS patch_key, b AS band, y, x, CASE WHEN vec_id % 2 = 0 THEN 1e1 + b ELSE 1e3 + round(CAST(embedding[b * 16 + 11] AS DOUBLE) * 1e3) END AS value
FROM embeddings CROSS JOIN (SELECT unnest(range(4)) AS b) g CROSS JOIN (SELECT unnest(range(2)) AS y) p CROSS JOIN (SELECT unnest(range(2)) AS x) q""", "value", PX)
def match_resolution_empty(d):
    """Coarse patches shrink to their centre pixel; patches without pixels become the layer means."""
    hollow = F.when(F.col("patch_key") % 2 == 0, arrays.patch(F.array().cast("array<double>"), 4, 0, 0)).otherwise(img())
    means = arrays.literal_vector([10, 11, 12, 13])
    return shown(d.image, transforms.match_resolution(hollow, 1000, 10, 2, 2, means))


@query("crop_centered", "SELECT patch_key, band, y, x - 1 AS x, value FROM fx_image WHERE y < 3 AND x IN (1, 2)", "value", PX)
def crop_centered(d):
    return shown(d.image, transforms.center_crop(img(), 3, 2))


@query("random_or_center_crop", f"""
WITH g AS (SELECT vec_id, {uniform(4, "vec_id")} < 5e-1 AS cropped, CAST(floor({uniform(5, "vec_id")} * 2) AS BIGINT) AS top,
  CAST(floor({uniform(6, "vec_id")} * 2) AS BIGINT) AS first FROM embeddings)
SELECT i.patch_key, i.band, CASE WHEN cropped THEN y - top ELSE y END AS y, CASE WHEN cropped THEN x - first ELSE x END AS x, value
FROM fx_image i JOIN g ON g.vec_id = i.patch_key WHERE NOT cropped OR (y - top IN (0, 1) AND x - first IN (0, 1))""", "value", PX)
def random_or_center_crop(d):
    """Half of the images, drawn by their key, are cropped at seeded offsets."""
    key = F.col("patch_key")
    return shown(d.image, samples.gated(img(), transforms.random_crop(img(), 2, 2, 5, key), 0.5, 4, key))


@query("hflip", "SELECT patch_key, band, y, 3 - x AS x, value FROM fx_image", "value", PX)
def hflip(d):
    return shown(d.image, transforms.hflip(img()))


@query("vflip", "SELECT patch_key, band, 3 - y AS y, x, value FROM fx_image", "value", PX)
def vflip(d):
    return shown(d.image, transforms.vflip(img()))


@query("flip_boxes", """
SELECT tile_id, 2e2 - maxx AS minx, 2e2 - minx AS maxx, 1e2 - maxy AS miny, 1e2 - miny AS maxy FROM fx_tile""", "minx maxx miny maxy")
def flip_boxes(d):
    boxed = d.tile.select("tile_id", F.struct("minx", "maxx", "miny", "maxy").alias("b"))
    mirrored = boxed.select("tile_id", transforms.flip_box(F.col("b"), F.lit(200.0), "minx", "maxx").alias("b"))
    return mirrored.select("tile_id", transforms.flip_box(F.col("b"), F.lit(100.0), "miny", "maxy").alias("b")).select("tile_id", "b.*")


@query("resize_nearest", """
SELECT i.patch_key, i.band, y2 AS y, x2 AS x, value FROM fx_image i CROSS JOIN (SELECT unnest(range(6)) AS y2) a CROSS JOIN (SELECT unnest(range(3)) AS x2) b
WHERE i.y = y2 * 4 // 6 AND i.x = x2 * 4 // 3""", "value", PX)
def resize_nearest(d):
    return shown(d.image, transforms.resize_nearest(img(), 6, 3))


_AT = "(1e3 + round(CAST(embedding[band * 16 + {} * 4 + {} + 1] AS DOUBLE) * 1e3))"


@query("resize_bilinear", f"""
WITH s AS (SELECT i AS o, greatest(0e0, (i + 5e-1) * 4 / 6e0 - 5e-1) AS s FROM (SELECT unnest(range(6)) AS i) g),
 t AS (SELECT o, CAST(floor(s) AS BIGINT) AS i0, least(CAST(floor(s) AS BIGINT) + 1, 3) AS i1, s - floor(s) AS f FROM s)
SELECT vec_id AS patch_key, band, ty.o AS y, tx.o AS x,
  ({_AT.format("ty.i0", "tx.i0")} * (1 - tx.f) + {_AT.format("ty.i0", "tx.i1")} * tx.f) * (1 - ty.f)
  + ({_AT.format("ty.i1", "tx.i0")} * (1 - tx.f) + {_AT.format("ty.i1", "tx.i1")} * tx.f) * ty.f AS value
FROM embeddings CROSS JOIN (SELECT unnest(range(4)) AS band) b CROSS JOIN t ty CROSS JOIN t tx""", "value", PX)
def resize_bilinear(d):
    return shown(d.image, transforms.resize_bilinear(img(), 6, 6))


@query("noise", f"""
SELECT patch_key, band, y, x, value + greatest(0e0, least(5e-2, 1e-2 * {normal(9, "patch_key", "band * 16 + y * 4 + x")})) AS value FROM fx_image""", "value", PX)
def noise(d):
    """Clamped normal noise drawn by image and pixel."""
    return shown(d.image, transforms.noise(img(), 1e-2, 5e-2, 9, F.col("patch_key")))


UNIT = "(SELECT patch_key, band, y, x, value / (12345678e-3 / 7e0) AS value FROM fx_image)"


@query("brightness", f"SELECT patch_key, band, y, x, CASE WHEN band < 3 THEN greatest(0e0, least(1e0, value * 18e-1)) ELSE value END AS value FROM {UNIT} u", "value", PX)
def brightness(d):
    return shown(d.image, transforms.brightness(transforms.scale(img(), 12345.678 / 7.0), 1.8))


@query("contrast", f"""
SELECT u.patch_key, band, y, x, CASE WHEN band < 3 THEN greatest(0e0, least(1e0, 14e-1 * value + (1 - 14e-1) * g)) ELSE value END AS value FROM {UNIT} u
JOIN (SELECT patch_key, sum(CASE band WHEN 0 THEN 2989e-4 WHEN 1 THEN 587e-3 WHEN 2 THEN 114e-3 ELSE 0e0 END * value) / 16e0 AS g FROM {UNIT} v GROUP BY patch_key) m
ON m.patch_key = u.patch_key""", "value", PX)
def contrast(d):
    return shown(d.image, transforms.contrast(transforms.scale(img(), 12345.678 / 7.0), 1.4))


@query("gaussian_blur", """
WITH k AS (SELECT i - 1 AS dlt, exp(-5e-1 * power((i - 1) / 8e-1, 2)) / (1e0 + 2e0 * exp(-5e-1 * power(1 / 8e-1, 2))) AS w FROM (SELECT unnest(range(3)) AS i) g),
 o AS (SELECT c, k.w, CASE WHEN c + dlt < 0 THEN -(c + dlt) WHEN c + dlt > 3 THEN 6 - (c + dlt) ELSE c + dlt END AS src FROM (SELECT unnest(range(4)) AS c) g CROSS JOIN k)
SELECT patch_key, band, oy.c AS y, ox.c AS x, sum(oy.w * ox.w * value) AS value FROM fx_image i JOIN o oy ON oy.src = i.y JOIN o ox ON ox.src = i.x
GROUP BY patch_key, band, oy.c, ox.c""", "value", PX)
def gaussian_blur(d):
    return shown(d.image, transforms.gaussian_blur(img(), 3))


STATS = {"sat": ([1000.0, 1001.0, 1002.0, 1003.0], [50.0, 51.0, 52.0, 53.0])}
SPECS = [{"name": "hflip", "p": 1.0, "ignore": "val"}, {"name": "vflip", "p": 1.0}, {"name": "randomcontrast", "val": 2.0, "ignore": True},
         {"name": "crop", "height": 2, "width": 2, "center": "val"}, {"name": "normalize"}]


@query("transforms_by_mode", """
SELECT patch_key, band, 2 - y AS y, x - 1 AS x, (value - (1e3 + band)) / (5e1 + band) AS value FROM fx_image WHERE y IN (1, 2) AND x IN (1, 2)""", "value", PX)
def transforms_by_mode(d):
    """Validation mode: no horizontal flip, vertical flip, centred crop, normalization."""
    chain = samples.steps(SPECS, "val", "patch_key", STATS)
    rows = samples.assemble(d.image.withColumnRenamed("img", "sat"), chain)
    return shown(rows, F.col("sat"))


SCALED = [{"name": "crop", "inputs": ["sat", "env"], "skip": ["env"], "center": "val"}, {"name": "hflip", "p": 1.0, "inputs": ["sat", "env"]}]


@query("multiscale_crops", """
SELECT i.patch_key, s AS scale, 'sat' AS input, band, y - (4 - s) // 2 AS y, s - 1 - (x - (4 - s) // 2) AS x, value FROM fx_image i
CROSS JOIN (SELECT unnest([2, 3]) AS s) g WHERE y - (4 - s) // 2 BETWEEN 0 AND s - 1 AND x - (4 - s) // 2 BETWEEN 0 AND s - 1
UNION ALL SELECT p.patch_key, s, 'env', band, y, 3 - x, value FROM fx_patch p CROSS JOIN (SELECT unnest([2, 3]) AS s) g""", "value", "scale " + PX)
def multiscale_crops(d):
    """Two crop sizes of each image beside an input that the crop skips, then a flip of both."""
    both = d.image.withColumnRenamed("img", "sat").join(d.patch.withColumnRenamed("img", "env"), "patch_key")
    by_scale, chain = samples.multiscale(SCALED, "val", "patch_key", STATS, [2, 3])
    rows = samples.assemble_scales(both, by_scale, chain, ["sat", "env"])
    each = rows.select("patch_key", "scale", F.inline(F.array(F.struct(F.lit("sat").alias("input"), F.col("sat").alias("img")),
                                                              F.struct(F.lit("env").alias("input"), F.col("env").alias("img")))))
    keyed = each.select(F.struct("patch_key", "scale", "input").alias("k"), "img")
    return samples.pixels(keyed, "k").select("k.*", "band", "y", "x", "value")


@query("stack_inputs", """
SELECT patch_key, band, y, x, value FROM fx_image UNION ALL SELECT patch_key, 4 + band, y, x, value FROM fx_patch WHERE band < 2""", "value", PX)
def stack_inputs(d):
    both = d.image.withColumnRenamed("img", "sat").join(d.patch.select("patch_key", transforms.take_bands(F.col("img"), 0, 2).alias("env")), "patch_key")
    return shown(samples.assemble(both, [], env=["env"]), F.col("sat"))


@query("slice_env_groups", """
SELECT patch_key, CASE WHEN band < 1 THEN 'a' WHEN band < 3 THEN 'b' ELSE 'c' END AS part, CASE WHEN band < 1 THEN band WHEN band < 3 THEN band - 1 ELSE band - 3 END AS band, y, x, value FROM fx_patch""",
       "value", PX)
def slice_env_groups(d):
    groups = samples.env_groups(img(), [1, 2, 1])
    named = F.array(*[F.struct(F.lit(n).alias("part"), g.alias("img")) for n, g in zip("abc", groups)])
    rows = d.patch.select("patch_key", F.inline(named)).select(F.struct("patch_key", "part").alias("key"), "img")
    return samples.pixels(rows, "key").select("key.patch_key", "key.part", "band", "y", "x", "value")


@query("target_binary", "SELECT hotspot_id, species_idx, CASE WHEN y > 0 THEN 1e0 ELSE y END AS target, y AS original_target FROM fx_rate", "target original_target", "species_idx")
def target_binary(d):
    rows = d.targets.select("hotspot_id", *samples.target("binary"))
    return rows.select("hotspot_id", arrays.unrolled(F.arrays_zip("target", "original_target"), "species_idx", "t")).select(
        "hotspot_id", "species_idx", "t.target", "t.original_target")


@query("target_log", "SELECT hotspot_id, species_idx, y AS target FROM fx_rate", "target", "species_idx")
def target_log(d):
    return d.targets.select("hotspot_id", *samples.target("log")).select("hotspot_id", arrays.unrolled("target", "species_idx", "target"))


@query("nir_scale_stack", """
SELECT patch_key, band, y, x, CASE WHEN band < 3 THEN value ELSE floor(value / max(value) OVER (PARTITION BY patch_key, band) * 255e0) END / 255e0 AS value FROM fx_image""", "value", PX)
def nir_scale_stack(d):
    return shown(d.image, transforms.nir_stack(transforms.take_bands(img(), 0, 3), transforms.take_bands(img(), 3, 1)))


@query("reflectance_clip", "SELECT patch_key, band, y, x, greatest(0e0, least(1e0, (value - 9e2) * 1e2 / 1e4)) AS value FROM fx_image", "value", PX)
def reflectance_clip(d):
    stretched = arrays.map_pixels(img(), lambda v, b: (v - 900) * 100)
    return shown(d.image, transforms.reflectance_clip(stretched))


@query("channel_count", """
SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 30 WHEN 2 THEN 3 ELSE 20 END AS channels FROM embeddings""", bigints="channels")
def channel_count(d):
    lists = [["r", "g", "b", "nir"], ["rgb", "bioclim", "ped"], ["rgb", "unknown"], ["bioclim", "landuse"]]
    bands = F.lit(None).cast("array<string>")
    for i, names in enumerate(lists):
        bands = F.when(F.col("vec_id") % 4 == i, F.array(*[F.lit(n) for n in names])).otherwise(bands)
    return d.table("embeddings").select("vec_id", samples.channel_count(bands).alias("channels"))


@query("value_recode", """
SELECT vec_id, CASE label % 4 - 1 WHEN -1 THEN 1e1 WHEN 0 THEN 2e1 WHEN 1 THEN 3e1 ELSE label % 4 - 1 END AS code FROM embeddings""", "code")
def value_recode(d):
    v = (F.col("label") % 4 - 1).cast("double")
    return d.table("embeddings").select("vec_id", samples.recode(v, 10.0, 20.0, 30.0).alias("code"))
