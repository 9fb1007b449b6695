"""Checklist aggregation and duplicate-hotspot resolution."""

from pyspark.sql import functions as F

from fieldmark.functions import arrays
from fieldmark.operators import distribution, duplicates, encounter, filters
from fieldmark.plans.catalog import query

SUMMER_OBS = "(SELECT * FROM fx_obs WHERE complete = 1 AND month(obs_date) IN (6, 7) AND year(obs_date) >= 1996) s"
OCC_N = "(SELECT hotspot_id, count(DISTINCT event_id) AS n FROM fx_occ GROUP BY hotspot_id)"
OCC_LIST = "(SELECT species FROM (SELECT species, count(*) AS c FROM fx_occ WHERE species IS NOT NULL GROUP BY species) l WHERE c >= 100)"


@query("encounter_rate", f"""
SELECT p.hotspot_id, species, count(DISTINCT checklist_id) / CAST(max(n) AS DOUBLE) AS rate, max(n) AS num_complete_checklists
FROM fx_pair p JOIN fx_n ON fx_n.hotspot_id = p.hotspot_id GROUP BY p.hotspot_id, species""", "rate", "num_complete_checklists")
def encounter_rate(d):
    return encounter.encounter_rates(d.season_obs, min_checklists=5)


@query("num_complete_checklists", """
SELECT hotspot_id, count(DISTINCT checklist_id) AS num_complete_checklists FROM fx_pair
GROUP BY hotspot_id HAVING count(DISTINCT checklist_id) > 60""", bigints="num_complete_checklists")
def num_complete_checklists(d):
    return encounter.checklist_counts(d.season_obs, min_checklists=60)


@query("hotspot_entry", f"""
SELECT hotspot_id, min(lat) AS lat, min(lon) AS lon, min(state) AS state, min(country) AS country,
       count(DISTINCT checklist_id) AS num_complete_checklists, count(DISTINCT species) AS num_different_species
FROM {SUMMER_OBS} GROUP BY hotspot_id HAVING count(DISTINCT checklist_id) > 5""",
       "lat lon", "num_complete_checklists num_different_species")
def hotspot_entry(d):
    return encounter.hotspot_entries(d.season_obs, ["lat", "lon", "state", "country"], min_checklists=5)


@query("hotspot_entry_conflicts", """
SELECT state AS hotspot_id, CAST(count(DISTINCT country) + max(CASE WHEN country IS NULL THEN 1 ELSE 0 END) > 1 AS BOOLEAN) AS country_conflict,
       CAST(count(DISTINCT lat) + max(CASE WHEN lat IS NULL THEN 1 ELSE 0 END) > 1 AS BOOLEAN) AS lat_conflict
FROM fx_obs GROUP BY state HAVING count(DISTINCT country) > 1 OR count(DISTINCT lat) > 1""")
def hotspot_entry_conflicts(d):
    renamed = d.obs.select(F.col("state").alias("hotspot_id"), "country", "lat")
    return encounter.attribute_conflicts(renamed, ["country", "lat"])


@query("dense_target_vector", """
SELECT hotspot_id, species_idx, y AS rate, n AS num_complete_checklists FROM fx_rate""", "rate",
       "species_idx num_complete_checklists")
def dense_target_vector(d):
    return encounter.long_targets(d.targets.drop("num_different_species"))


@query("winter_targets_excluding_states", """
SELECT h.hotspot_id, s.species_idx, coalesce(c.k, 0) / CAST(h.n AS DOUBLE) AS rate, h.n AS num_complete_checklists
FROM (SELECT hotspot_id, count(DISTINCT checklist_id) AS n FROM fx_obs
      WHERE complete = 1 AND month(obs_date) IN (12, 1) AND year(obs_date) >= 1996
        AND hotspot_id NOT IN (SELECT hotspot_id FROM fx_obs WHERE state IN ('NATION_3', 'NATION_7'))
      GROUP BY hotspot_id HAVING count(DISTINCT checklist_id) > 5) h
CROSS JOIN fx_list s
LEFT JOIN (SELECT hotspot_id, species, count(DISTINCT checklist_id) AS k FROM fx_obs
           WHERE complete = 1 AND month(obs_date) IN (12, 1) AND year(obs_date) >= 1996
           GROUP BY hotspot_id, species) c ON c.hotspot_id = h.hotspot_id AND c.species = s.species""",
       "rate", "species_idx num_complete_checklists")
def winter_targets_excluding_states(d):
    log = filters.target_rows(d.obs, first_year=1996, months=(12, 1))
    t = encounter.encounter_targets(log, d.species_list, 5, drop_if=F.col("state").isin("NATION_3", "NATION_7"))
    return encounter.long_targets(t.drop("num_different_species"))


@query("butterfly_targets", f"""
SELECT h.hotspot_id, s.species, coalesce(c.k, 0) / CAST(h.n AS DOUBLE) AS rate, h.n AS num_complete_checklists
FROM {OCC_N} h CROSS JOIN {OCC_LIST} s
LEFT JOIN (SELECT hotspot_id, species, count(DISTINCT event_id) AS k FROM fx_occ GROUP BY hotspot_id, species) c
ON c.hotspot_id = h.hotspot_id AND c.species = s.species""", "rate", "num_complete_checklists")
def butterfly_targets(d):
    frequent = distribution.value_counts(d.occ, "species").filter(F.col("n") >= 100)
    listed = encounter.species_dimension(frequent)
    t = encounter.encounter_targets(d.occ, listed, min_checklists=0, checklist="event_id")
    long = encounter.long_targets(t.drop("num_different_species"))
    return long.join(listed, "species_idx").select("hotspot_id", "species", "rate", "num_complete_checklists")


@query("rate_violations", """
SELECT hotspot_id, max(y) * 6e0 AS max_rate FROM fx_rate GROUP BY hotspot_id HAVING max(y) * 6e0 > 1""", "max_rate")
def rate_violations(d):
    inflated = d.targets.withColumn("probs", F.transform("probs", lambda y: y * F.lit(6.0)))
    return filters.rate_violations(inflated)


@query("species_frequency_list", """
SELECT species, count(*) AS n FROM fx_occ WHERE species IS NOT NULL GROUP BY species""", bigints="n")
def species_frequency_list(d):
    return distribution.value_counts(d.occ, "species")


@query("hotspot_size_summary", """
SELECT min(n) AS min_n, max(n) AS max_n, avg(n) AS mean_n, median(n) AS median_n, count(CASE WHEN n > 20 THEN 1 END) AS large
FROM (SELECT hotspot_id, count(*) AS n FROM fx_occ GROUP BY hotspot_id) t""", "mean_n median_n", "min_n max_n large")
def hotspot_size_summary(d):
    return filters.size_summary(d.occ, "hotspot_id", large=20)


@query("hotspot_size_large", """
SELECT hotspot_id, count(*) AS n FROM fx_occ GROUP BY hotspot_id HAVING count(*) > 20""", bigints="n")
def hotspot_size_large(d):
    return d.occ.groupBy("hotspot_id").agg(F.count("*").alias("n")).filter(F.col("n") > 20)


@query("butterfly_hotspot_table", """
SELECT hotspot_id, min(lat) AS lat, min(lon) AS lon, min(state) AS state, count(*) AS num_occurrences,
       count(DISTINCT event_id) AS num_complete_checklists,
       count(DISTINCT species) + max(CASE WHEN species IS NULL THEN 1 ELSE 0 END) AS num_different_species
FROM fx_occ GROUP BY hotspot_id""", "lat lon", "num_occurrences num_complete_checklists num_different_species")
def butterfly_hotspot_table(d):
    return filters.occurrence_hotspots(d.occ)


@query("total_checklists", "SELECT count(DISTINCT event_id) AS n FROM fx_occ", bigints="n")
def total_checklists(d):
    return d.occ.select("event_id").distinct().agg(F.count("event_id").alias("n"))


@query("nonzero_rate_stats", """
SELECT hotspot_id, count(CASE WHEN y <> 0 THEN 1 END) AS nonzero,
       1e2 * sum(count(CASE WHEN y <> 0 THEN 1 END)) OVER () / sum(count(*)) OVER () AS percent_nonzero
FROM fx_rate GROUP BY hotspot_id""", "percent_nonzero", "nonzero")
def nonzero_rate_stats(d):
    per = d.targets.select("hotspot_id", arrays.nonzero_count(F.col("probs")).cast("bigint").alias("nonzero"), F.size("probs").alias("s"))
    percent = per.agg((F.lit(100.0) * F.sum("nonzero") / F.sum("s")).alias("p")).select("p").scalar()
    return per.select("hotspot_id", "nonzero", percent.alias("percent_nonzero"))


@query("numeric_describe", "SELECT max(value) AS max_v, min(value) AS min_v, avg(value) AS mean_v FROM events",
       "max_v min_v mean_v")
def numeric_describe(d):
    return d.table("events").agg(F.max("value").alias("max_v"), F.min("value").alias("min_v"), F.avg("value").alias("mean_v"))


@query("taxonomy_counts", """
SELECT 'species' AS column_name, species AS value, count(*) AS n FROM fx_occ WHERE species IS NOT NULL GROUP BY species
UNION ALL SELECT 'country_code', country_code, count(*) FROM fx_occ GROUP BY country_code
UNION ALL SELECT 'state', state, count(*) FROM fx_occ WHERE state IS NOT NULL GROUP BY state
UNION ALL SELECT 'month', CAST(month(occ_date) AS VARCHAR), count(*) FROM fx_occ GROUP BY month(occ_date)""", bigints="n")
def taxonomy_counts(d):
    return distribution.many_value_counts(d.occ.withColumn("month", F.month("occ_date")), ["species", "country_code", "state", "month"])


@query("coordinate_counts", """
SELECT lat, lon, count(*) AS n FROM fx_occ GROUP BY lat, lon""", "lat lon", "n")
def coordinate_counts(d):
    return d.occ.groupBy("lat", "lon").agg(F.count("*").alias("n"))


@query("coordinate_distinct", """
SELECT count(DISTINCT lat) AS lats, count(DISTINCT lon) AS lons FROM fx_occ""", bigints="lats lons")
def coordinate_distinct(d):
    lats = d.occ.select("lat").distinct().agg(F.count("lat").alias("n")).select("n").scalar()
    return d.occ.select("lon").distinct().agg(F.count("lon").alias("lons")).select(lats.alias("lats"), "lons")


@query("active_localities", """
SELECT hotspot_id, n, lat, lon FROM (
  SELECT hotspot_id, count(*) OVER (PARTITION BY hotspot_id) AS n, lat, lon,
         row_number() OVER (PARTITION BY hotspot_id ORDER BY occurrence_id) AS rk FROM fx_occ) t
WHERE rk = 1 AND n > 5""", "lat lon", "n")
def active_localities(d):
    return filters.active_localities(d.occ, "hotspot_id", "occurrence_id", min_rows=5)


@query("month_species_pivot", "SELECT species, " + ", ".join(
    f"count(CASE WHEN month(obs_date) = {m} THEN 1 END) AS m{m}" for m in range(1, 13)) + " FROM fx_obs GROUP BY species",
       bigints=" ".join(f"m{m}" for m in range(1, 13)))
def month_species_pivot(d):
    return filters.month_pivot(d.obs, "species", "obs_date")


@query("hotspot_profile", """
SELECT hotspot_id, min(state) AS state, min(country) AS country, min(lat) AS lat, min(lon) AS lon,
       count(DISTINCT state) AS states, count(DISTINCT country) AS countries FROM fx_obs GROUP BY hotspot_id""",
       "lat lon", "states countries")
def hotspot_profile(d):
    return filters.hotspot_profile(d.obs)


@query("shared_coordinates", """
SELECT lon, lat, count(*) AS n FROM (SELECT lon, lat FROM fx_site UNION ALL SELECT lon, lat FROM fx_loc) u
GROUP BY lon, lat HAVING count(*) > 1 ORDER BY lon, n DESC, lat""", "lon lat", "n")
def shared_coordinates(d):
    return filters.shared_coordinates(d.site, d.loc)


@query("split_shares", """
SELECT split, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM (
  SELECT CASE WHEN site_key % 10 < 7 THEN 'train' WHEN site_key % 10 = 7 THEN 'valid' ELSE 'test' END AS split FROM fx_site) t
GROUP BY split""", "share", "n")
def split_shares(d):
    from fieldmark.plans.inputs import split_of
    return distribution.shares(d.site.withColumn("split", split_of(F.col("site_key"))), "split")


@query("repeat_locations", """
SELECT state, count(*) AS n FROM fx_loc GROUP BY state HAVING count(*) > 1""", bigints="n")
def repeat_locations(d):
    return d.loc.groupBy("state").agg(F.count("*").alias("n")).filter(F.col("n") > 1)


@query("checklist_species_sets", """
SELECT checklist_id, species, dense_rank() OVER (ORDER BY species) - 1 AS taxon_idx
FROM (SELECT DISTINCT checklist_id, species FROM fx_obs) t""", bigints="taxon_idx")
def checklist_species_sets(d):
    sets = filters.checklist_species(d.obs)
    return sets.select("checklist_id", F.inline("taxa")).select("checklist_id", "species", "taxon_idx")


@query("histogram", """
SELECT CAST(CASE WHEN step > 0 THEN least(floor((value - lo) / step), 19) ELSE 0 END AS BIGINT) AS bin,
       min(lo + CASE WHEN step > 0 THEN least(floor((value - lo) / step), 19) ELSE 0 END * step) AS lower_edge, count(*) AS n
FROM (SELECT value, min(value) OVER () AS lo, (max(value) OVER () - min(value) OVER ()) / 2e1 AS step FROM events) t
GROUP BY 1""", "lower_edge", "bin n")
def histogram(d):
    return distribution.histogram(d.table("events"), "value", 20)


MERGE = """
WITH members AS (
  SELECT lon, lat, loc_key, hotspot_id, min(loc_key) OVER (PARTITION BY lon, lat) AS keep FROM fx_loc),
 m AS (SELECT concat('L', CAST(keep AS VARCHAR)) AS survivor_id, hotspot_id AS member_id FROM members)
SELECT survivor_id AS hotspot_id, species_idx, sum(y * n) / sum(n) AS rate, sum(n) AS num_complete_checklists
FROM m JOIN fx_rate r ON r.hotspot_id = m.member_id GROUP BY survivor_id, species_idx"""


@query("merge_targets_weighted", MERGE, "rate", "species_idx num_complete_checklists")
def merge_targets_weighted(d):
    members = duplicates.survivors(d.loc, "hotspot_id", "loc_key")
    return encounter.merge_targets(d.targets, members.select("survivor_id", F.col("hotspot_id").alias("member_id")))


@query("nonzero_species_recount", """
SELECT hotspot_id, n AS num_complete_checklists, count(CASE WHEN y > 0 THEN 1 END) AS num_different_species
FROM fx_rate GROUP BY hotspot_id, n""", bigints="num_complete_checklists num_different_species")
def nonzero_species_recount(d):
    recount = F.size(F.filter("probs", lambda y: y > 0))
    return d.targets.select("hotspot_id", "num_complete_checklists", recount.alias("num_different_species"))


@query("merge_duplicate_coords", """
SELECT lon, lat, hotspot_id, num_complete_checklists, num_different_species FROM (
  SELECT s.lon, s.lat, s.hotspot_id, row_number() OVER w AS rk, sum(c.k) OVER p AS num_complete_checklists,
         sum(c.sp) OVER p AS num_different_species
  FROM fx_loc s JOIN (SELECT hotspot_id, count(DISTINCT checklist_id) AS k, count(DISTINCT species) AS sp FROM fx_obs GROUP BY hotspot_id) c
  ON c.hotspot_id = s.hotspot_id
  WINDOW w AS (PARTITION BY s.lon, s.lat ORDER BY s.loc_key), p AS (PARTITION BY s.lon, s.lat)) t
WHERE rk = 1""", "lon lat", "num_complete_checklists num_different_species")
def merge_duplicate_coords(d):
    entries = encounter.hotspot_entries(d.obs, ["lat", "lon", "loc_key"], min_checklists=0)
    return (duplicates.merge_by_coordinates(entries, "loc_key", sums=["num_complete_checklists", "num_different_species"])
            .select("lon", "lat", "hotspot_id", "num_complete_checklists", "num_different_species"))


@query("duplicate_groups", """
SELECT lon, lat, survivor_id, member_id FROM (
  SELECT lon, lat, hotspot_id AS member_id, count(*) OVER (PARTITION BY lon, lat) AS n,
         first_value(hotspot_id) OVER (PARTITION BY lon, lat ORDER BY site_key) AS survivor_id FROM fx_site) t
WHERE n > 1""", "lon lat")
def duplicate_groups(d):
    return duplicates.groups(d.site, "hotspot_id", "site_key").select(
        "lon", "lat", "survivor_id", F.col("hotspot_id").alias("member_id"))


SUSPICIOUS_CTE = """
WITH occ AS (SELECT hotspot_id, CASE WHEN place % 3 = 0 THEN place % 50 ELSE o_custkey % 7 END AS observer,
   CASE WHEN place % 3 = 0 THEN DATE '2000-01-01' ELSE CAST(o_orderdate AS DATE) END AS d
   FROM (SELECT *, CASE WHEN site_key % 10 = 0 AND site_key > 0 THEN site_key - 1 ELSE site_key END AS place FROM fx_site) k JOIN orders ON o_custkey = site_key),
 g AS (SELECT lon, lat, hotspot_id, site_key, count(*) OVER (PARTITION BY lon, lat) AS n FROM fx_site),
 obs_sets AS (SELECT hotspot_id, array_to_string(list_sort(list(DISTINCT observer)), ',') AS os, min(d) AS d0, max(d) AS d1 FROM occ GROUP BY hotspot_id),
 bad AS (SELECT g.lon, g.lat FROM g JOIN obs_sets o ON o.hotspot_id = g.hotspot_id WHERE n > 1
         GROUP BY g.lon, g.lat HAVING count(DISTINCT os) = 1 AND min(d0) = max(d1))"""


@query("suspicious_groups", SUSPICIOUS_CTE + """
SELECT g.hotspot_id FROM g JOIN bad ON g.lon = bad.lon AND g.lat = bad.lat""")
def suspicious_groups(d):
    place = F.when((F.col("site_key") % 10 == 0) & (F.col("site_key") > 0), F.col("site_key") - 1).otherwise(F.col("site_key"))
    lone = place % 3 == 0
    log = d.table("orders").join(d.site, F.col("o_custkey") == F.col("site_key")).select(
        "hotspot_id", F.when(lone, place % 50).otherwise(F.col("o_custkey") % 7).alias("observer_id"),
        F.when(lone, F.lit("2000-01-01").cast("date")).otherwise(F.to_date("o_orderdate")).alias("obs_date"))
    return duplicates.suspicious(duplicates.groups(d.site, "hotspot_id", "site_key"), log)


@query("merge_map", SUSPICIOUS_CTE + """,
 alive AS (SELECT lon, lat, hotspot_id, site_key, (site_key % 4 <> 1) AS ok FROM g WHERE n > 1),
 surv AS (SELECT lon, lat, max(site_key) AS sk FROM alive WHERE ok GROUP BY lon, lat)
SELECT concat('C', CAST(sk AS VARCHAR)) AS survivor_id, a.hotspot_id AS member_id
FROM alive a JOIN surv s ON a.lon = s.lon AND a.lat = s.lat WHERE NOT a.ok""")
def merge_map(d):
    groups = duplicates.groups(d.site, "hotspot_id", "site_key")
    alive = d.site.filter(F.col("site_key") % 4 != 1).select("hotspot_id")
    return duplicates.merge_map(groups, alive, "site_key")
