"""Projections, filters, de-duplication."""

from pyspark.sql import functions as F

from fieldmark.operators import distribution, duplicates, filters, species
from fieldmark.plans.catalog import query

OBS = "hotspot_id, checklist_id, obs_date, species"


@query("complete_season_rows", f"""
SELECT global_id, {OBS} FROM fx_obs WHERE complete = 1 AND year(obs_date) BETWEEN 1996 AND 1999 AND month(obs_date) IN (1, 6, 7, 12)""")
def complete_season_rows(d):
    return filters.complete_season_rows(d.obs, 1996, 1999).select("global_id", "hotspot_id", "checklist_id", "obs_date", "species")


@query("complete_season_text", f"""
SELECT global_id, {OBS} FROM fx_obs WHERE complete = 1 AND year(obs_date) BETWEEN 1996 AND 1999 AND month(obs_date) IN (1, 6, 7, 12)""")
def complete_season_text(d):
    return filters.complete_season_text(d.obs, r"199[6-9]-(01|06|07|12)-").select("global_id", "hotspot_id", "checklist_id", "obs_date", "species")


@query("checklist_filter", f"""
SELECT {OBS}, state FROM fx_obs WHERE country = 'AMERICA' AND complete = 1 AND state NOT IN ('NATION_3', 'NATION_7') AND year(obs_date) >= 1996""")
def checklist_filter(d):
    kept = filters.checklist_rows(d.obs, "AMERICA", ["NATION_3", "NATION_7"], first_year=1996)
    return kept.select("hotspot_id", "checklist_id", "obs_date", "species", "state")


@query("season_split", """
SELECT global_id, CASE WHEN month(obs_date) IN (6, 7) THEN 'summer' ELSE 'winter' END AS season
FROM fx_obs WHERE month(obs_date) IN (6, 7, 12, 1)""")
def season_split(d):
    return filters.with_season(d.obs).select("global_id", "season")


@query("row_filter_targets", f"""
SELECT {OBS} FROM fx_obs WHERE complete = 1 AND year(obs_date) >= 1998 AND month(obs_date) IN (6, 7, 12, 1)""")
def row_filter_targets(d):
    return filters.target_rows(d.obs, 1998).select("hotspot_id", "checklist_id", "obs_date", "species")


@query("drop_hotspots_any_state", """
SELECT hotspot_id, count(*) AS n FROM fx_occ WHERE hotspot_id NOT IN (
  SELECT hotspot_id FROM fx_occ WHERE state IN ('NATION_3', 'NATION_7', 'NATION_11', 'NATION_19')) GROUP BY hotspot_id""", bigints="n")
def drop_hotspots_any_state(d):
    kept = filters.drop_hotspots_with(d.occ, F.col("state").isin("NATION_3", "NATION_7", "NATION_11", "NATION_19"))
    return kept.groupBy("hotspot_id").agg(F.count("*").alias("n"))


@query("country_year_filter", """
SELECT occurrence_id, country_code, occ_date FROM fx_occ WHERE country_code = 'US' AND year(occ_date) >= 2010""")
def country_year_filter(d):
    return d.occ.filter((F.col("country_code") == "US") & (F.year("occ_date") >= 2010)).select("occurrence_id", "country_code", "occ_date")


@query("state_exclusion_rows", """
SELECT occurrence_id, state FROM fx_occ WHERE state IS NULL OR state NOT IN ('NATION_3', 'NATION_7')""")
def state_exclusion_rows(d):
    return filters.exclude_states(d.occ, ["NATION_3", "NATION_7"]).select("occurrence_id", "state")


@query("project_checklist", """
SELECT hotspot_id, state, country, lat, lon, checklist_id, obs_date FROM fx_obs""", "lat lon")
def project_checklist(d):
    return d.obs.select("hotspot_id", "state", "country", "lat", "lon", "checklist_id", "obs_date")


@query("drop_by_pattern", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer", "c_acctbal", "c_nationkey")
def drop_by_pattern(d):
    renamed = d.table("customer").withColumnRenamed("c_mktsegment", "Unnamed: 0")
    return filters.drop_columns_like(renamed, "Unnamed")


@query("dedupe_rows_and_headers", """
SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag <> 'R'""", bigints="l_linenumber")
def dedupe_rows_and_headers(d):
    rows = d.table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return filters.dedupe_rows_and_headers(rows, "l_returnflag", "R")


@query("dedupe_keep_first", """
SELECT hotspot_id, occurrence_id, event_id, lat FROM (
  SELECT *, row_number() OVER (PARTITION BY hotspot_id ORDER BY occurrence_id) AS rk FROM fx_occ) t WHERE rk = 1""", "lat")
def dedupe_keep_first(d):
    return duplicates.keep_first(d.occ.select("hotspot_id", "occurrence_id", "event_id", "lat"), "hotspot_id", "occurrence_id")


@query("year_month_range", """
SELECT occurrence_id, occ_date FROM fx_occ WHERE year(occ_date) > 2000 AND year(occ_date) < 2025 AND month(occ_date) = 1 AND country_code = 'US'""")
def year_month_range(d):
    y = F.year("occ_date")
    return d.occ.filter((y > 2000) & (y < 2025) & (F.month("occ_date") == 1) & (F.col("country_code") == "US")).select("occurrence_id", "occ_date")


@query("threshold_filter", """
SELECT species, count(*) AS n FROM fx_occ WHERE species IS NOT NULL GROUP BY species HAVING count(*) >= 100""", bigints="n")
def threshold_filter(d):
    return distribution.value_counts(d.occ, "species").filter(F.col("n") >= 100)


@query("image_min_size", """
SELECT patch_key, 100 + patch_key % 60 AS h, 100 + patch_key % 45 AS w FROM (SELECT vec_id AS patch_key FROM embeddings) e
WHERE 100 + patch_key % 60 >= 128 AND 100 + patch_key % 45 >= 128""", bigints="h w")
def image_min_size(d):
    from fieldmark.functions import arrays
    from fieldmark.operators import samples
    key = F.col("patch_key")
    sized = d.image.select("patch_key", arrays.patch(F.col("img.data"), F.lit(4), 100 + key % 60, 100 + key % 45).alias("img"))
    return samples.min_size(sized, 128).select("patch_key", "img.h", "img.w")


@query("distance_filter", """
SELECT occurrence_id, d FROM (SELECT occurrence_id, 2e0 * 63567523e-4 * asin(sqrt(
   power(sin(radians(s.lat - o.lat) / 2e0), 2) + cos(radians(o.lat)) * cos(radians(s.lat)) * power(sin(radians(s.lon - o.lon) / 2e0), 2))) AS d
  FROM fx_occ o JOIN fx_site s ON s.site_key = o.site_key) t WHERE d < 1""", "d")
def distance_filter(d):
    from fieldmark.functions import geo
    pairs = d.occ.alias("o").join(d.site.alias("s"), F.col("o.site_key") == F.col("s.site_key"))
    dist = geo.haversine_km(F.col("o.lat"), F.col("o.lon"), F.col("s.lat"), F.col("s.lon"))
    return pairs.select("occurrence_id", dist.alias("d")).filter(F.col("d") < 1)


@query("top_n_species", """
SELECT 'most' AS side, species_idx, m AS mean_rate FROM (SELECT species_idx, avg(y) AS m FROM fx_rate GROUP BY species_idx ORDER BY round(avg(y), 9) DESC, species_idx LIMIT 10) a
UNION ALL SELECT 'least', species_idx, m FROM (SELECT species_idx, avg(y) AS m FROM fx_rate GROUP BY species_idx ORDER BY round(avg(y), 9), species_idx LIMIT 10) b""",
       "mean_rate", "species_idx")
def top_n_species(d):
    return species.extremes(d.targets, 10)


@query("sort_by_count", "SELECT hotspot_id, count(*) AS n FROM fx_obs GROUP BY hotspot_id ORDER BY n DESC, hotspot_id", bigints="n")
def sort_by_count(d):
    return d.obs.groupBy("hotspot_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hotspot_id")


@query("rename_columns", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS county FROM customer")
def rename_columns(d):
    return d.table("customer").withColumnsRenamed({"c_custkey": "id", "c_name": "name", "c_mktsegment": "county"}).drop("c_acctbal", "c_nationkey")
