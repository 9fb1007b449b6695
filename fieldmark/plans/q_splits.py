"""Splits and imputation."""

from pyspark.sql import functions as F

from fieldmark.functions import arrays
from fieldmark.operators import spatial, splits
from fieldmark.plans.catalog import query
from fieldmark.plans.inputs import split_of
from fieldmark.plans.q_spatial import components

SPLIT = "CASE WHEN {k} % 10 < 7 THEN 'train' WHEN {k} % 10 = 7 THEN 'valid' ELSE 'test' END"


def quota_split(sized, seed):
    return f"""
 sizes AS (SELECT cluster_id, count(*) AS size FROM {sized} GROUP BY cluster_id),
 q AS (SELECT CAST(floor(count(*) * 15e-2) AS BIGINT) AS qv, count(*) - CAST(floor(count(*) * 7e-1) AS BIGINT) - CAST(floor(count(*) * 15e-2) AS BIGINT) AS qt FROM {sized}),
 o AS (SELECT *, sum(size) OVER (ORDER BY (cluster_id * 7919 + {seed} * 104729) % 1000003, cluster_id ROWS UNBOUNDED PRECEDING) - size AS before FROM sizes),
 v AS (SELECT sum(size) AS v FROM o, q WHERE before < qv OR before = 0),
 named AS (SELECT cluster_id, CASE WHEN before < qv OR before = 0 THEN 'valid' WHEN before - v < qt OR before = v THEN 'test' ELSE 'train' END AS split FROM o, q, v)"""


@query("cluster_split", components(5) + "," + quota_split("sized", 0) + """
SELECT s.site_key, s.cluster_id, n.split FROM sized s JOIN named n ON n.cluster_id = s.cluster_id""")
def cluster_split(d):
    members = spatial.clusters(d.site, "site_key", 5.0).select("site_key", "cluster_id")
    return splits.cluster_split(members, seed=0).select("site_key", "cluster_id", "split")


FRESH = "(SELECT * FROM fx_site WHERE site_key % 3 = 0)"


@query("inherit_then_split", components(5, FRESH) + "," + quota_split("sized", 1) + f"""
SELECT f.site_key, coalesce(CASE WHEN f.site_key % 3 <> 0 THEN {SPLIT.format(k='f.site_key')} END, n.split) AS split
FROM fx_site f LEFT JOIN sized s ON s.site_key = f.site_key LEFT JOIN named n ON n.cluster_id = s.cluster_id""")
def inherit_then_split(d):
    parent = d.site.filter(F.col("site_key") % 3 != 0).select("hotspot_id", split_of(F.col("site_key")).alias("split"))
    rows = splits.inherit_split(d.site, parent)
    fresh = rows.filter(F.col("split").isNull()).drop("split")
    computed = splits.cluster_split(spatial.clusters(fresh, "site_key", 5.0), seed=1)
    return splits.coalesce_split(rows, computed).select("site_key", "split")


@query("split_from_lists", f"SELECT hotspot_id, CASE WHEN site_key % 11 <> 0 THEN {SPLIT.format(k='site_key')} END AS split FROM fx_site")
def split_from_lists(d):
    listed = d.site.filter(F.col("site_key") % 11 != 0).withColumn("s", split_of(F.col("site_key")))
    lists = {name: listed.filter(F.col("s") == name).select("hotspot_id") for name in ("train", "valid", "test")}
    return splits.from_lists(d.site.select("hotspot_id"), lists)


@query("impute_train_mean", """
SELECT env_key, e.layer, coalesce(value, m) AS value FROM fx_env e
JOIN (SELECT layer, avg(value) AS m FROM fx_env WHERE env_key % 10 < 7 GROUP BY layer) t ON t.layer = e.layer""", "value", "layer")
def impute_train_mean(d):
    rows = d.env_wide.withColumn("split", split_of(F.col("env_key")))
    filled = splits.impute_train_mean(rows, "env", 27)
    return filled.select("env_key", arrays.unrolled("env", "layer", "value"))


@query("impute_own_mean", f"""
SELECT env_key, layer, coalesce(value, avg(value) OVER (PARTITION BY split, layer)) AS value
FROM (SELECT *, {SPLIT.format(k='env_key')} AS split FROM fx_env) e""", "value", "layer")
def impute_own_mean(d):
    rows = d.env_wide.withColumn("split", split_of(F.col("env_key")))
    return splits.impute_own_mean(rows, "env", 27).select("env_key", arrays.unrolled("env", "layer", "value"))


@query("split_max", f"""
SELECT split, max(n) AS max_n FROM (SELECT {SPLIT.format(k='site_key')} AS split, count(*) AS n FROM fx_occ GROUP BY site_key) t GROUP BY split""", bigints="max_n")
def split_max(d):
    counts = d.occ.groupBy("site_key").agg(F.count("*").alias("n")).withColumn("split", split_of(F.col("site_key")))
    return splits.split_max(counts, "n")
