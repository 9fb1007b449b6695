"""Joins and set operations."""

from pyspark.sql import functions as F

from fieldmark.functions import arrays
from fieldmark.operators import duplicates, filters, joins, splits
from fieldmark.plans.catalog import query
from fieldmark.plans.inputs import split_of

SPLIT = "CASE WHEN site_key % 10 < 7 THEN 'train' WHEN site_key % 10 = 7 THEN 'valid' ELSE 'test' END"
REF = f"(SELECT site_key, hotspot_id, lat, lon, {SPLIT} AS split FROM fx_site WHERE site_key % 4 <> 0)"


def reference(d):
    return d.site.filter(F.col("site_key") % 4 != 0).withColumn("split", split_of(F.col("site_key")))


@query("left_join_split", f"SELECT s.hotspot_id, r.split FROM fx_site s LEFT JOIN {REF} r ON r.hotspot_id = s.hotspot_id")
def left_join_split(d):
    return splits.inherit_split(d.site, reference(d)).select("hotspot_id", "split")


@query("join_on_coordinates", f"""
SELECT s.site_key, r.hotspot_id FROM fx_site s JOIN {REF} r ON r.lat = s.lat AND r.lon = s.lon""")
def join_on_coordinates(d):
    return joins.rekey_by_coordinates(d.site, reference(d)).select("site_key", "hotspot_id")


@query("season_reconcile", f"""
WITH r AS {REF}
SELECT site_key, hotspot_id, split FROM r
UNION ALL SELECT s.site_key, r.hotspot_id, r.split FROM fx_site s JOIN r ON r.lat = s.lat AND r.lon = s.lon WHERE s.site_key % 4 = 0""")
def season_reconcile(d):
    return joins.reconcile_seasons(d.site, reference(d)).select("site_key", "hotspot_id", "split")


@query("right_join_filler", """
SELECT l.species, l.species_idx, coalesce(n, 0) AS n FROM (SELECT species, count(*) AS n FROM fx_obs GROUP BY species) c
RIGHT JOIN fx_list l ON l.species = c.species""", bigints="species_idx n")
def right_join_filler(d):
    counts = d.obs.groupBy("species").agg(F.count("*").alias("n"))
    return counts.join(d.species_list, "species", "right").select("species", "species_idx", F.coalesce("n", F.lit(0)).alias("n"))


@query("semi_join_images", "SELECT hotspot_id FROM fx_site WHERE site_key IN (SELECT vec_id FROM embeddings)")
def semi_join_images(d):
    files = d.table("embeddings").select(F.concat(F.lit("C"), F.col("vec_id").cast("string")).alias("hotspot_id"))
    return joins.present(d.site, files).select("hotspot_id")


@query("anti_join_done", "SELECT hotspot_id FROM fx_site WHERE site_key NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)")
def anti_join_done(d):
    files = d.table("embeddings").filter(F.col("vec_id") % 2 == 0).select(F.concat(F.lit("C"), F.col("vec_id").cast("string")).alias("hotspot_id"))
    return joins.absent(d.site, files).select("hotspot_id")


@query("missing_hotspots", "SELECT hotspot_id FROM fx_site EXCEPT SELECT hotspot_id FROM fx_occ")
def missing_hotspots(d):
    return joins.missing(d.site, d.occ)


@query("name_overlap", """
SELECT species, count(*) AS n FROM fx_obs WHERE species IN (SELECT species FROM fx_list) AND state IN (SELECT state FROM fx_occ) GROUP BY species""", bigints="n")
def name_overlap(d):
    states = joins.common_names(d.obs, d.occ, "state")
    names = joins.common_names(d.obs, d.species_list, "species")
    rows = d.obs.join(states, "state", "left_semi").join(names, "species", "left_semi")
    return rows.groupBy("species").agg(F.count("*").alias("n"))


@query("species_intersect_union", """
SELECT species, bool_or(a) AND bool_or(b) AS in_both FROM (
  SELECT species, TRUE AS a, FALSE AS b FROM fx_list UNION ALL SELECT species, FALSE, TRUE FROM fx_obs) t GROUP BY species""")
def species_intersect_union(d):
    return joins.species_sets(d.species_list, d.obs)


@query("species_restrict_shared", """
SELECT l.species FROM fx_list l WHERE l.species IN (SELECT species FROM fx_obs)""")
def species_restrict_shared(d):
    shared = joins.species_sets(d.species_list, d.obs).filter("in_both")
    return joins.restrict_species(d.species_list, shared).select("species")


@query("concat", """
SELECT hotspot_id, lat, lon, state, NULL AS state_key FROM fx_loc UNION ALL SELECT hotspot_id, lat, lon, NULL, state_key FROM fx_site""",
       "lat lon", "state_key")
def concat(d):
    return joins.stack([d.loc.select("hotspot_id", "lat", "lon", "state"), d.site.select("hotspot_id", "lat", "lon", "state_key")])


@query("join_on_locality_name", """
SELECT state, hotspot_id, n FROM (SELECT l.state, min(l.hotspot_id) AS hotspot_id, count(*) AS n
  FROM fx_occ o JOIN fx_loc l ON l.state = o.state WHERE o.country_code = 'US' AND l.state NOT IN ('NATION_3', 'NATION_7', 'NATION_11')
  GROUP BY l.state) t WHERE n > 49""", bigints="n")
def join_on_locality_name(d):
    us = filters.exclude_states(d.occ.filter(F.col("country_code") == "US"), ["NATION_3", "NATION_7", "NATION_11"])
    # counts first, so the name join runs on one row per name and not on the log
    counted = us.filter(F.col("state").isNotNull()).groupBy("state").agg(F.count("*").alias("rows"))
    names = d.loc.groupBy("state").agg(F.min("hotspot_id").alias("hotspot_id"), F.count("*").alias("places"))
    joined = counted.join(names, "state").select("state", "hotspot_id", (F.col("rows") * F.col("places")).alias("n"))
    return joined.filter(F.col("n") > 49)


@query("resplit_by_reference", f"""
SELECT concat('B', s.hotspot_id) AS own_id, r.split FROM fx_site s JOIN {REF} r ON r.hotspot_id = s.hotspot_id""")
def resplit_by_reference(d):
    own = d.site.select("hotspot_id", joins.prefixed(F.col("hotspot_id"), "B").alias("own_id"), F.lit("none").alias("split"))
    return joins.resplit(own, reference(d), "hotspot_id").select("own_id", "split")


@query("join_env_features", f"""
SELECT r.hotspot_id, r.split, e.layer, e.value FROM {REF} r JOIN fx_env e ON e.env_key = r.site_key""", "value", "layer")
def join_env_features(d):
    env = d.env_wide.select(F.col("env_key").alias("site_key"), "env", "label")
    joined = joins.with_features(reference(d).select("site_key", "hotspot_id", "split"), env, "site_key", drop=["label"])
    return joined.select("hotspot_id", "split", arrays.unrolled("env", "layer", "value"))


@query("species_index_lookup", "SELECT species, species_idx FROM fx_list WHERE species IN ('Brand#11', 'Brand#20', 'Zz absent one')", bigints="species_idx")
def species_index_lookup(d):
    return d.species_list.filter(F.col("species").isin("Brand#11", "Brand#20", "Zz absent one")).select("species", "species_idx")


@query("coalesce_update", f"""
SELECT s.hotspot_id, coalesce(r.split, CASE WHEN s.site_key % 8 = 0 THEN 'computed' END) AS split FROM fx_site s LEFT JOIN {REF} r ON r.hotspot_id = s.hotspot_id""")
def coalesce_update(d):
    rows = splits.inherit_split(d.site, reference(d))
    computed = d.site.filter(F.col("site_key") % 8 == 0).select("hotspot_id", F.lit("computed").alias("split"))
    return splits.coalesce_split(rows, computed).select("hotspot_id", "split")


@query("rekey_prefix", "SELECT concat('B', hotspot_id) AS hotspot_id, lat, lon FROM fx_site", "lat lon")
def rekey_prefix(d):
    return d.site.select(joins.prefixed(F.col("hotspot_id"), "B").alias("hotspot_id"), "lat", "lon")


@query("attach_attributes", """
SELECT o.hotspot_id, s.state_key, e.layer, e.value FROM (SELECT DISTINCT hotspot_id, site_key FROM fx_occ) o
JOIN fx_site s ON s.site_key = o.site_key JOIN fx_env e ON e.env_key = o.site_key""", "value", "state_key layer")
def attach_attributes(d):
    hotspots = duplicates.keep_first(d.occ.select("hotspot_id", "site_key", "occurrence_id"), "hotspot_id", "occurrence_id").drop("occurrence_id")
    env = d.env_wide.select(F.col("env_key").alias("site_key"), "env")
    joined = joins.with_features(hotspots, d.site.select("site_key", "state_key"), "site_key").join(env, "site_key")
    return joined.select("hotspot_id", "state_key", arrays.unrolled("env", "layer", "value"))
