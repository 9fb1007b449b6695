"""Distances, nearest hotspots, distance clusters, boxes and chips."""

from pyspark.sql import functions as F

from fieldmark.functions import geo
from fieldmark.operators import boxes, spatial
from fieldmark.plans.catalog import query
from fieldmark.plans.oracle import uniform


def dist(a, b, radius="63567523e-4"):
    return (f"2e0 * {radius} * asin(sqrt(least(1e0, power(sin((radians({b}.lat) - radians({a}.lat)) / 2e0), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) "
            f"* power(sin((radians({b}.lon) - radians({a}.lon)) / 2e0), 2))))")


def components(km, view="fx_site"):
    """Reachability along steps of at most ``km``; label = smallest key reached."""
    return f"""
WITH RECURSIVE pairs AS (SELECT a.site_key AS a, b.site_key AS b FROM {view} a JOIN {view} b ON abs(a.lat - b.lat) < 1e-1 AND a.site_key <> b.site_key
   WHERE {dist('a', 'b')} <= {km}),
 reach AS (SELECT site_key, site_key AS root FROM {view} UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.site_key),
 labels AS (SELECT site_key, min(root) AS cluster_id FROM reach GROUP BY site_key),
 sized AS (SELECT l.site_key, l.cluster_id, count(*) OVER (PARTITION BY l.cluster_id) AS cluster_size FROM labels l)"""


@query("haversine_km", f"""
SELECT o.occurrence_id, {dist('o', 's')} AS km, {dist('o', 's', '6371e0')} AS km_mean_radius
FROM fx_occ o JOIN fx_site s ON s.site_key = o.site_key + 1""", "km km_mean_radius")
def haversine_km(d):
    far = d.site.select((F.col("site_key") - 1).alias("site_key"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    ends = F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon")
    return d.occ.join(far, "site_key").select("occurrence_id", geo.haversine_km(*ends).alias("km"), geo.haversine_km(*ends, 6371.0).alias("km_mean_radius"))


@query("nearest_hotspot", f"""
SELECT occurrence_id, near_key, near_lat, near_lon, split, distance_km FROM (
  SELECT o.occurrence_id, s.site_key AS near_key, s.lat AS near_lat, s.lon AS near_lon,
         CASE WHEN s.site_key % 10 < 7 THEN 'train' WHEN s.site_key % 10 = 7 THEN 'valid' ELSE 'test' END AS split,
         {dist('o', 's')} AS distance_km,
         row_number() OVER (PARTITION BY o.occurrence_id ORDER BY round({dist('o', 's')}, 9), s.site_key) AS rk
  FROM fx_occ o JOIN fx_site s ON abs(o.lat - s.lat) < 2e-2 AND abs(o.lon - s.lon) < 2e-2) t WHERE rk = 1 AND distance_km < 1""",
       "near_lat near_lon distance_km", "near_key")
def nearest_hotspot(d):
    from fieldmark.plans.inputs import split_of
    centres = d.site.withColumn("split", split_of(F.col("site_key")))
    found = spatial.nearest(d.occ.select("occurrence_id", "lat", "lon"), centres, "site_key", 1.0, keep=("split",))
    return found.filter(F.col("distance_km") < 1).select("occurrence_id", "near_key", "near_lat", "near_lon", "split", "distance_km")


@query("nearest_hotspot_any_distance", f"""
SELECT hotspot_id, near_key, distance_km FROM (
  SELECT s.hotspot_id, l.loc_key AS near_key, {dist('s', 'l')} AS distance_km,
         row_number() OVER (PARTITION BY s.site_key ORDER BY round({dist('s', 'l')}, 9), l.loc_key) AS rk
  FROM fx_site s CROSS JOIN fx_loc l) t WHERE rk = 1""", "distance_km", "near_key")
def nearest_hotspot_any_distance(d):
    """Exact at any distance; the SQL twin is the brute-force minimum over all centres."""
    found = spatial.nearest_any(d.site.select("hotspot_id", "lat", "lon"), d.loc, "loc_key", first_km=4.0)
    return found.select("hotspot_id", "near_key", "distance_km")


@query("cluster_5km", components(5) + "SELECT site_key, cluster_id, cluster_size FROM sized", bigints="cluster_size")
def cluster_5km(d):
    return spatial.clusters(d.site, "site_key", 5.0).select("site_key", "cluster_id", "cluster_size")


@query("cluster_1km_drop_noise", components(1) + """
SELECT site_key, concat('L', CAST(cluster_id AS VARCHAR)) AS hotspot_id, cluster_size FROM sized WHERE cluster_size > 1""", bigints="cluster_size")
def cluster_1km_drop_noise(d):
    grouped = spatial.clusters(d.site.drop("hotspot_id"), "site_key", 1.0).filter(F.col("cluster_size") > 1)
    return grouped.select("site_key", F.concat(F.lit("L"), F.col("cluster_id").cast("string")).alias("hotspot_id"), "cluster_size")


@query("cluster_medoid", components(5) + f""",
 mid AS (SELECT cluster_id, avg(lat) AS lat, avg(lon) AS lon FROM sized z JOIN fx_site s ON s.site_key = z.site_key GROUP BY cluster_id)
SELECT cluster_id, site_key, lat, lon, cluster_size FROM (
  SELECT z.cluster_id, s.site_key, s.lat, s.lon, z.cluster_size,
         row_number() OVER (PARTITION BY z.cluster_id ORDER BY round({dist('s', 'mid')}, 9), s.site_key) AS rk
  FROM sized z JOIN fx_site s ON s.site_key = z.site_key JOIN mid ON mid.cluster_id = z.cluster_id) t WHERE rk = 1""",
       "lat lon", "cluster_size")
def cluster_medoid(d):
    return spatial.medoids(spatial.clusters(d.site, "site_key", 5.0), "site_key")


@query("degrees_for_km", """
SELECT hotspot_id, 5e0 / 63567523e-4 * 18e1 / pi() AS lat_degrees, 5e0 / (63567523e-4 * cos(abs(lat) * pi() / 18e1)) * 18e1 / pi() AS lon_degrees FROM fx_site""",
       "lat_degrees lon_degrees")
def degrees_for_km(d):
    km = F.lit(5.0)
    return d.site.select("hotspot_id", geo.lat_degrees(km).alias("lat_degrees"), geo.lon_degrees(km, F.col("lat")).alias("lon_degrees"))


@query("bbox_from_centre", """
SELECT hotspot_id, lon - 25e2 / e AS minx, lon + 25e2 / e AS maxx, lat - 25e2 / n AS miny, lat + 25e2 / n AS maxy FROM (
 SELECT *, 111132954e-3 - 559822e-3 * cos(2e0 * radians(lat)) + 1175e-3 * cos(4e0 * radians(lat)) - 23e-4 * cos(6e0 * radians(lat)) AS n,
   11141284e-2 * cos(radians(lat)) - 935e-1 * cos(3e0 * radians(lat)) + 118e-3 * cos(5e0 * radians(lat)) AS e FROM fx_site) t""",
       "minx maxx miny maxy")
def bbox_from_centre(d):
    return d.site.select("hotspot_id", geo.box_from_centre(F.col("lat"), F.col("lon"), 2500, 2500).alias("b")).select("hotspot_id", "b.*")


@query("square_buffer", """
SELECT hotspot_id, degrees((6378137e0 * radians(lon) - 25e2) / 6378137e0) AS minx, degrees((6378137e0 * radians(lon) + 25e2) / 6378137e0) AS maxx,
  degrees(2e0 * atan(exp((6378137e0 * ln(tan(pi() / 4e0 + radians(lat) / 2e0)) - 25e2) / 6378137e0)) - pi() / 2e0) AS miny,
  degrees(2e0 * atan(exp((6378137e0 * ln(tan(pi() / 4e0 + radians(lat) / 2e0)) + 25e2) / 6378137e0)) - pi() / 2e0) AS maxy FROM fx_site""",
       "minx maxx miny maxy")
def square_buffer(d):
    return d.site.select("hotspot_id", geo.square_buffer(F.col("lat"), F.col("lon"), 2500).alias("b")).select("hotspot_id", "b.*")


@query("bbox_validate", """
SELECT o_orderkey AS box_id, o_custkey * 1e0 AS minx, o_totalprice / 1e2 AS maxx FROM orders WHERE o_custkey > o_totalprice / 1e2""", "minx maxx")
def bbox_validate(d):
    b = d.table("orders").select(F.col("o_orderkey").alias("box_id"), F.col("o_custkey").cast("double").alias("minx"),
                                 (F.col("o_totalprice") / 100).alias("maxx"))
    return boxes.invalid(b, [boxes.Axis("minx", "maxx")])


SCENE_BOX = """(SELECT s.*, minx, maxx, miny, maxy, epoch(CAST(acquired AS TIMESTAMP)) / 864e2 AS mint, epoch(CAST(acquired AS TIMESTAMP)) / 864e2 + 1e1 AS maxt
 FROM fx_scene s JOIN fx_tile t ON t.tile_id = s.tile_id)"""
SITE_BOX = """(SELECT site_key, hotspot_id, lon - 2e-2 AS minx, lon + 2e-2 AS maxx, lat - 2e-2 AS miny, lat + 2e-2 AS maxy,
 1e4 + site_key % 5e2 AS mint, 1e4 + site_key % 5e2 + 2e0 AS maxt FROM fx_site)"""
DAYS = boxes.Axis("mint", "maxt", 8.0)
OVERLAP = "q.minx <= b.maxx AND q.maxx >= b.minx AND q.miny <= b.maxy AND q.maxy >= b.miny AND q.mint <= b.maxt AND q.maxt >= b.mint"


def site_boxes(d):
    t = F.lit(1e4) + F.col("site_key") % 500
    return d.site.select("site_key", "hotspot_id", (F.col("lon") - 0.02).alias("minx"), (F.col("lon") + 0.02).alias("maxx"),
                         (F.col("lat") - 0.02).alias("miny"), (F.col("lat") + 0.02).alias("maxy"), t.alias("mint"), (t + 2).alias("maxt"))


def scene_boxes(d):
    return d.scene_box.withColumns({"mint": F.unix_date("mint").cast("double"), "maxt": F.unix_date("maxt").cast("double")})


@query("bbox_intersect_join", f"""
SELECT q.site_key, b.scene_id FROM {SITE_BOX} q JOIN {SCENE_BOX} b ON {OVERLAP}""")
def bbox_intersect_join(d):
    scene_side = scene_boxes(d).drop("tile_id", "cloud", "acquired")
    pairs = boxes.shared_overlap_join(scene_side, site_boxes(d).drop("hotspot_id"), [boxes.LON, boxes.LAT, DAYS])
    return pairs.select("r.site_key", "l.scene_id")


@query("extent", f"""
SELECT min(minx) AS minx, min(miny) AS miny, min(mint) AS mint, max(maxx) AS maxx, max(maxy) AS maxy, max(maxt) AS maxt FROM {SCENE_BOX} b""",
       "minx miny mint maxx maxy maxt")
def extent(d):
    return boxes.extent(scene_boxes(d), [boxes.LON, boxes.LAT, DAYS])


@query("clip_to_polygon", """
SELECT "row", col, layer, value FROM (
  SELECT r."row", r.col, r.layer, r.value, max(CASE WHEN odd THEN 1 ELSE 0 END) AS hit FROM fx_raster r JOIN (
    SELECT g."row", g.col, p.part, sum(CASE WHEN (ay > g.lat) <> (b_y > g.lat) AND g.lon < (bx - ax) * (g.lat - ay) / nullif(b_y - ay, 0) + ax THEN 1 ELSE 0 END) % 2 = 1 AS odd
    FROM (SELECT DISTINCT "row", col, 34e0 - ("row" + 5e-1) * 16e-2 AS lat, -1e2 + (col + 5e-1) * 4e-1 AS lon FROM fx_raster) g
    CROSS JOIN (SELECT * FROM fx_poly WHERE species_idx = 3) p GROUP BY g."row", g.col, p.part) o ON o."row" = r."row" AND o.col = r.col
  GROUP BY r."row", r.col, r.layer, r.value) t WHERE hit = 1""", "value", "layer")
def clip_to_polygon(d):
    from fieldmark.operators import raster
    return raster.clip_to_polygon(d.raster, d.polygon.filter(F.col("species_idx") == 3), raster.GRID)


@query("random_chips", f"""
WITH t AS (SELECT *, row_number() OVER (ORDER BY tile_id) - 1 AS ordinal, count(*) OVER () AS n FROM fx_tile),
 d AS (SELECT o_orderkey AS draw, CAST(floor({uniform(7, "o_orderkey")} * (SELECT max(n) FROM t)) AS BIGINT) AS ordinal,
       {uniform(8, "o_orderkey")} AS u, {uniform(9, "o_orderkey")} AS v FROM orders),
 c AS (SELECT draw, tile_id, minx + u * (maxx - minx - 1e-1) AS x, miny + v * (maxy - miny - 1e-1) AS y FROM d JOIN t ON t.ordinal = d.ordinal)
SELECT draw, tile_id, x AS minx, x + 1e-1 AS maxx, y AS miny, y + 1e-1 AS maxy FROM c""", "minx maxx miny maxy")
def random_chips(d):
    """One seeded chip for each order."""
    return boxes.random_chips(d.tile, "tile_id", 0.1, d.table("orders").select(F.col("o_orderkey").alias("draw")), seed=7)


@query("grid_chips", """
SELECT tile_id, r AS chip_row, c AS chip_col, minx + c * 2e-1 AS minx, minx + c * 2e-1 + 3e-1 AS maxx, miny + r * 2e-1 AS miny, miny + r * 2e-1 + 3e-1 AS maxy
FROM (SELECT *, floor((maxy - miny - 3e-1) / 2e-1) AS nr, floor((maxx - minx - 3e-1) / 2e-1) AS nc FROM fx_tile) t
CROSS JOIN (SELECT unnest(range(20)) AS r) a CROSS JOIN (SELECT unnest(range(20)) AS c) b WHERE r <= nr AND c <= nc""", "minx maxx miny maxy")
def grid_chips(d):
    return boxes.grid_chips(d.tile, 0.3, 0.2).select("tile_id", "chip_row", "chip_col", "minx", "maxx", "miny", "maxy")


@query("unique_locations_concat", """
SELECT DISTINCT lon, lat FROM (SELECT lon, lat FROM fx_site UNION ALL SELECT lon, lat FROM fx_loc) u""", "lon lat")
def unique_locations_concat(d):
    return d.site.select("lon", "lat").unionByName(d.loc.select("lon", "lat")).dropDuplicates()


@query("sincos_location", """
SELECT hotspot_id, sin(pi() * (lon / 18e1)) AS s_lon, sin(pi() * (lat / 9e1)) AS s_lat, cos(pi() * (lon / 18e1)) AS c_lon,
       cos(pi() * (lat / 9e1)) AS c_lat, acctbal / 5e3 AS elev FROM fx_site""", "s_lon s_lat c_lon c_lat elev")
def sincos_location(d):
    v = d.site.select("hotspot_id", geo.sincos(F.col("lat"), F.col("lon"), F.col("acctbal")).alias("v"))
    return v.select("hotspot_id", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(["s_lon", "s_lat", "c_lon", "c_lat", "elev"])])
