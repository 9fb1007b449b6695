"""Evaluation metrics."""

from pyspark.sql import functions as F

from fieldmark.functions import scores
from fieldmark.operators import metrics
from fieldmark.plans.catalog import query

INNER = "(SELECT *, greatest(1e-3, least(999e-3, p)) AS q FROM fx_pred)"


def inner(d):
    """Predictions kept off 0 and 1, where the unsmoothed entropies are infinite (the limits are unit-tested)."""
    return d.predictions.withColumn("p", F.transform("p", lambda p: F.greatest(F.lit(1e-3), F.least(F.lit(0.999), p))))


@query("mae", "SELECT split, avg(abs(y - p)) AS mae FROM fx_pred GROUP BY split", "mae")
def mae(d):
    return metrics.evaluate(d.predictions, {"mae": metrics.mae()}, by=["split"])


@query("mse", "SELECT split, avg((y - p) * (y - p)) AS mse FROM fx_pred GROUP BY split", "mse")
def mse(d):
    return metrics.evaluate(d.predictions, {"mse": metrics.mse()}, by=["split"])


def ranked(k_pred, k_targ, denom, tail=""):
    return f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY hotspot_id ORDER BY p DESC, species_idx) AS rp,
   row_number() OVER (PARTITION BY hotspot_id ORDER BY y DESC, species_idx) AS ry,
   count(CASE WHEN y <> 0 THEN 1 END) OVER (PARTITION BY hotspot_id) AS k FROM fx_pred),
 s AS (SELECT hotspot_id, split, max(k) AS k, count(CASE WHEN rp <= {k_pred} AND ry <= {k_targ} THEN 1 END) / CAST(max({denom}) AS DOUBLE) AS score
   FROM r WHERE k > 0 GROUP BY hotspot_id, split)
{tail}"""


MEAN = "SELECT split, avg(score) AS score FROM s GROUP BY split"


@query("topk_adaptive", ranked("k", "k", "k", MEAN), "score")
def topk_adaptive(d):
    return metrics.ranking(d.predictions, {"score": scores.top_overlap(F.col("y"), F.col("p"))}, by=["split"])


@query("top10", ranked("10", "least(k, 10)", "least(k, 10)", MEAN), "score")
def top10(d):
    return metrics.ranking(d.predictions, {"score": scores.top_overlap(F.col("y"), F.col("p"), 10)}, by=["split"])


@query("top30", ranked("30", "least(k, 30)", "least(k, 30)", MEAN), "score")
def top30(d):
    return metrics.ranking(d.predictions, {"score": scores.top_overlap(F.col("y"), F.col("p"), 30)}, by=["split"])


@query("topk_baseline", ranked("least(k, 10)", "least(k, 10)", "least(k, 10)", MEAN), "score")
def topk_baseline(d):
    return metrics.ranking(d.predictions, {"score": scores.top_overlap(F.col("y"), F.col("p"), 10, both=True)}, by=["split"])


@query("topk_curve", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY hotspot_id ORDER BY p DESC, species_idx) AS rp,
   row_number() OVER (PARTITION BY hotspot_id ORDER BY y DESC, species_idx) AS ry FROM fx_pred)
SELECT k, count(CASE WHEN rp <= k AND ry <= k THEN 1 END) / (k * CAST(count(DISTINCT hotspot_id) AS DOUBLE)) AS score
FROM r CROSS JOIN (SELECT unnest(range(1, 300, 5)) AS k) ks GROUP BY k""", "score", "k")
def topk_curve(d):
    return metrics.topk_curve(d.predictions, list(range(1, 300, 5)))


@query("kl_bernoulli", f"""
SELECT split, avg(CASE WHEN y = 0 THEN 0 ELSE y * ln(y / q) END + CASE WHEN y = 1 THEN 0 ELSE (1 - y) * ln((1 - y) / (1 - q)) END) AS kl FROM {INNER} t GROUP BY split""", "kl")
def kl_bernoulli(d):
    return metrics.evaluate(inner(d), {"kl": metrics.kl()}, by=["split"])


@query("ce_metric", f"""
SELECT split, avg(-2e0 * y * ln(q) - 5e-1 * (1 - y) * ln(1 - q)) AS ce FROM {INNER} t GROUP BY split""", "ce")
def ce_metric(d):
    return metrics.evaluate(inner(d), {"ce": metrics.cross_entropy(2.0, 0.5)}, by=["split"])


@query("ce_metric_swapped", """
SELECT avg(-1e0 * y * ln(q) - (1 - y) * ln(1 - q)) AS ce FROM (
  SELECT p AS y, greatest(1e-3, least(999e-3, y)) AS q FROM fx_pred) t""", "ce")
def ce_metric_swapped(d):
    bounded = d.predictions.withColumn("y", F.transform("y", lambda y: F.greatest(F.lit(1e-3), F.least(F.lit(0.999), y))))
    return metrics.evaluate(bounded, {"ce": metrics.swapped_cross_entropy()})


@query("ce_loss", """
SELECT split, avg(-y * ln(p + 1e-7) - (1 - y) * ln(1 - p + 1e-7)) AS ce_mean, sum(-y * ln(p + 1e-7) - (1 - y) * ln(1 - p + 1e-7)) AS ce_sum
FROM fx_pred GROUP BY split""", "ce_mean ce_sum")
def ce_loss(d):
    return metrics.evaluate(d.predictions, {"ce_mean": metrics.cross_entropy(eps=scores.EPSILON), "ce_sum": metrics.cross_entropy(eps=scores.EPSILON, reduction="sum")}, by=["split"])


CE = "(-y * ln(p + 1e-7) - (1 - y) * ln(1 - p + 1e-7))"


@query("weighted_ce", f"""
SELECT avg(sqrt(n) * {CE}) AS by_sqrt, avg(ln(n) * {CE}) AS by_log, avg(n * {CE}) AS by_count FROM fx_pred""", "by_sqrt by_log by_count")
def weighted_ce(d):
    return metrics.evaluate(d.predictions, {"by_sqrt": metrics.weighted_cross_entropy("sqrt"), "by_log": metrics.weighted_cross_entropy("log"),
                                            "by_count": metrics.weighted_cross_entropy("nchklists")}, keep=["n"])


@query("rmsle", "SELECT split, sqrt(avg(power(ln(p + 1) - ln(y + 1), 2))) AS rmsle FROM fx_pred GROUP BY split", "rmsle")
def rmsle(d):
    return metrics.evaluate(d.predictions, {"rmsle": metrics.rmsle()}, by=["split"])


@query("focal", f"SELECT split, power(1 - exp(-avg({CE})), 2) * avg({CE}) AS focal FROM fx_pred GROUP BY split", "focal")
def focal(d):
    return metrics.evaluate(d.predictions, {"focal": metrics.focal()}, by=["split"])


@query("explained_variance", """
SELECT sum(CASE WHEN den > 0 THEN den - num END) / sum(den) AS explained_variance
FROM (SELECT species_idx, var_pop(y - p) AS num, var_pop(y) AS den FROM fx_pred GROUP BY species_idx) t""", "explained_variance")
def explained_variance(d):
    return metrics.explained_variance(d.predictions)


@query("accuracy", "SELECT split, avg(CASE WHEN (p > 5e-1) = (y > 5e-1) THEN 1e0 ELSE 0e0 END) AS accuracy FROM fx_pred GROUP BY split", "accuracy")
def accuracy(d):
    return metrics.evaluate(d.predictions, {"accuracy": metrics.presence(0.5)}, by=["split"])


@query("presence_k", "SELECT split, avg(CASE WHEN (p > 1e-1) = (y > 1e-1) THEN 1e0 ELSE 0e0 END) AS presence FROM fx_pred GROUP BY split", "presence")
def presence_k(d):
    return metrics.evaluate(d.predictions, {"presence": metrics.presence(0.1)}, by=["split"])


@query("subset_errors", """
WITH m AS (SELECT species_idx, round(avg(y), 9) AS m FROM fx_rate GROUP BY species_idx),
 c AS (SELECT * FROM (SELECT 'most' AS side, species_idx FROM m ORDER BY m DESC, species_idx LIMIT 6) a
       UNION ALL SELECT * FROM (SELECT 'least' AS side, species_idx FROM m ORDER BY m, species_idx LIMIT 6) b)
SELECT side, avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS mse FROM fx_pred f JOIN c ON c.species_idx = f.species_idx GROUP BY side""", "mae mse")
def subset_errors(d):
    return metrics.subset_errors(d.predictions, d.targets, 6)


@query("zero_baseline_mse", "SELECT split, avg(y * y) AS mse FROM fx_pred GROUP BY split", "mse")
def zero_baseline_mse(d):
    return metrics.evaluate(d.predictions, {"mse": metrics.zero_baseline_mse()}, by=["split"])


@query("error_by_target_bin", """
WITH b AS (SELECT min(y) AS lo, (max(y) - min(y)) / 18e0 AS step FROM fx_pred)
SELECT CAST(floor((y - lo) / step) + 1 AS BIGINT) AS bin, count(*) AS n, avg((p - y) * (p - y)) AS mean_sq, min((p - y) * (p - y)) AS min_sq,
       max((p - y) * (p - y)) AS max_sq, avg(p - y) AS mean_err FROM fx_pred CROSS JOIN b GROUP BY 1""", "mean_sq min_sq max_sq mean_err", "bin n")
def error_by_target_bin(d):
    return metrics.error_by_target_bin(d.predictions)


@query("per_hotspot_scores", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY hotspot_id ORDER BY p DESC, species_idx) AS rp,
   count(CASE WHEN y <> 0 THEN 1 END) OVER (PARTITION BY hotspot_id) AS k FROM fx_pred),
 s AS (SELECT hotspot_id, sum(abs(p - y)) AS mae, sum((p - y) * (p - y)) AS mse, max(k) AS non_zero,
   CASE WHEN max(k) > 0 THEN count(CASE WHEN rp <= k AND y <> 0 THEN 1 END) / CAST(max(k) AS DOUBLE) ELSE -1e0 END AS topk FROM r GROUP BY hotspot_id)
SELECT *, CASE WHEN topk = 0 THEN 1 WHEN topk = -1 THEN 0 WHEN topk < 45e-2 THEN 2 WHEN topk < 55e-2 THEN 3 WHEN topk < 65e-2 THEN 4
  WHEN topk < 75e-2 THEN 5 WHEN topk < 85e-2 THEN 6 ELSE 7 END AS band FROM s""", "mae mse topk", "non_zero band")
def per_hotspot_scores(d):
    return metrics.per_hotspot(d.predictions)


@query("exact_match_hamming", """
SELECT avg(CASE WHEN (y > 0) = (p > 5e-1) THEN 1e0 ELSE 0e0 END) AS exact_match, sum(CASE WHEN (y > 0) <> (p > 5e-1) THEN 1e0 ELSE 0e0 END) / count(DISTINCT hotspot_id) AS hamming,
       avg(CASE WHEN (y > 0) <> (p > 5e-1) THEN 1e0 ELSE 0e0 END) AS mae FROM fx_pred""", "exact_match hamming mae")
def exact_match_hamming(d):
    return metrics.label_agreement(d.predictions)


@query("clipped_ce_sum", """
SELECT split, sum(CASE WHEN q > 0 THEN -y * ln(q) - (1 - y) * ln(1 - q) END) AS ce FROM (
  SELECT split, y, greatest(0e0, CASE WHEN y = 0 THEN least(99e-2, p) - 1e-2 ELSE greatest(2e-2, least(99e-2, p)) END) AS q FROM fx_pred) t GROUP BY split""", "ce")
def clipped_ce_sum(d):
    """Predictions of absent species shifted down so that some are negative; present ones stay off 0 and 1."""
    low = F.least(F.lit(0.99), F.col("p"))
    shifted = metrics.cells(d.predictions, "split").withColumn(
        "p", F.when(F.col("y") == 0, low - F.lit(0.01)).otherwise(F.greatest(F.lit(0.02), low)))
    return shifted.groupBy("split").agg(metrics.clipped_ce_sum().alias("ce"))


@query("binary_log_loss", """
SELECT split, avg(CASE WHEN y > 0 THEN -ln(q) ELSE -ln(1 - q) END) AS loss FROM (SELECT split, y, CASE WHEN p >= 5e-1 THEN 999e-3 ELSE 1e-3 END AS q FROM fx_pred) t GROUP BY split""", "loss")
def binary_log_loss(d):
    return metrics.evaluate(d.predictions, {"loss": metrics.log_loss()}, by=["split"])


@query("r2_multi", """
SELECT avg(CASE WHEN sst > 0 THEN 1 - sse / sst WHEN sse = 0 THEN 1e0 ELSE 0e0 END) AS r2 FROM (
  SELECT species_idx, sum((y - p) * (y - p)) AS sse, var_pop(y) * count(*) AS sst FROM fx_pred GROUP BY species_idx) t""", "r2")
def r2_multi(d):
    return metrics.r2_multi(d.predictions)


@query("metric_suite", """
SELECT split, avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS mse, avg(-y * ln(p + 1e-7) - (1 - y) * ln(1 - p + 1e-7)) AS ce FROM fx_pred GROUP BY split""", "mae mse ce")
def metric_suite(d):
    """Several metrics in one pass."""
    return metrics.evaluate(d.predictions, {"mae": metrics.mae(), "mse": metrics.mse(), "ce": metrics.cross_entropy(eps=scores.EPSILON)}, by=["split"])
