"""Baselines and species statistics."""

from pyspark.sql import functions as F

from fieldmark.functions import arrays
from fieldmark.operators import baselines, distribution, encounter, metrics, species, splits, trees
from fieldmark.plans.catalog import query
from fieldmark.plans.inputs import WINTER
from fieldmark.plans.oracle import uniform
from fieldmark.session import materialize


MEANS = """
WITH f AS (SELECT f.*, m, round(m, 9) AS q FROM fx_pred f
   JOIN (SELECT species_idx, avg(y) AS m FROM fx_pred WHERE split = 'train' GROUP BY species_idx) t ON t.species_idx = f.species_idx WHERE split <> 'train'),
 r AS (SELECT *, row_number() OVER (PARTITION BY hotspot_id ORDER BY q DESC, species_idx) AS rp,
   row_number() OVER (PARTITION BY hotspot_id ORDER BY y DESC, species_idx) AS ry,
   count(CASE WHEN y <> 0 THEN 1 END) OVER (PARTITION BY hotspot_id) AS k FROM f),
 s AS (SELECT hotspot_id, split, count(CASE WHEN rp <= k AND ry <= k THEN 1 END) / CAST(max(k) AS DOUBLE) AS topk,
   count(CASE WHEN rp <= least(k, 10) AND ry <= least(k, 10) THEN 1 END) / CAST(max(least(k, 10)) AS DOUBLE) AS top10,
   count(CASE WHEN rp <= least(k, 30) AND ry <= least(k, 30) THEN 1 END) / CAST(max(least(k, 30)) AS DOUBLE) AS top30
   FROM r WHERE k > 0 GROUP BY hotspot_id, split),
 e AS (SELECT split, avg(abs(y - m)) AS mae, avg((y - m) * (y - m)) AS mse FROM f GROUP BY split)
SELECT e.split, mae, mse, topk, top10, top30 FROM e LEFT JOIN (SELECT split, avg(topk) AS topk, avg(top10) AS top10, avg(top30) AS top30 FROM s GROUP BY split) t
ON t.split = e.split"""


def scored_by(scored, by):
    """Errors over all cells and the three top-k scores over rows, for each group."""
    errors = metrics.evaluate(scored, {"mae": metrics.mae(), "mse": metrics.mse()}, by=by)
    # means of equal species differ in their last digits with the order of rows; ranks must not
    level = scored.withColumn("p", F.transform("p", lambda p: F.round(p, 9)))
    return errors.join(metrics.ranking(level, metrics.top_variants(both=True), by=by), by, "left")


@query("mean_encounter_baseline", MEANS, "mae mse topk top10 top30")
def mean_encounter_baseline(d):
    stored = materialize(d.predictions, "predictions")
    return scored_by(baselines.mean_encounter(stored).filter(F.col("split") != "train"), ["split"])


def features(d):
    """Predictions beside imputed features; hotspots meet feature rows by their number."""
    env = d.env_wide.select(F.col("env_key").alias("loc_key"), F.col("env").alias("x"))
    return splits.impute_train_mean(d.predictions.join(env, "loc_key"), "x", 27)


def learning(scored, by):
    """Counts and the mean target for each species, and whether the error on train stays within the variance of the targets."""
    table = metrics.cells(scored, "split", *by)
    train = F.col("split") == "train"
    y, e = F.when(train, F.col("y")), F.when(train, F.col("y") - F.col("p"))
    within = F.avg(e * e) <= F.var_pop(y) + 1e-12
    known = F.count_if(F.col("p").isNull() | F.isnan("p")) == 0
    return table.groupBy(*by, "species_idx").agg(
        F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_other"), F.avg(y).alias("mean_target"), (within & known).alias("learned"))


LEARNED = """
SELECT seed, species_idx, count(CASE WHEN split = 'train' THEN 1 END) AS n_train, count(CASE WHEN split <> 'train' THEN 1 END) AS n_other,
       avg(CASE WHEN split = 'train' THEN y END) AS mean_target, TRUE AS learned
FROM fx_pred CROSS JOIN (SELECT unnest(range({seeds})) AS seed) s WHERE loc_key IN (SELECT vec_id FROM embeddings) GROUP BY seed, species_idx"""


def boosted(d, seeds, **params):
    """Every species of the list and every seed: vectors ``p`` for all rows."""
    rows = materialize(features(d).select("hotspot_id", "split", "x", "y"), "features")
    size = rows.agg(F.max(F.size("y"))).first()[0] or 0
    return trees.boost(rows, size, "x", "y", "hotspot_id", seeds, **params)


_FITTED: dict = {}


def fitted(d, name, fit):
    """The predictions of a fit, written once for each session and folder and read by the queries that judge them."""
    key = (d.spark.sparkContext.applicationId, d.folder, name)
    if key not in _FITTED:
        _FITTED[key] = materialize(fit(), name)
    return _FITTED[key]


def regressor(d):
    """Least squares, 100 rounds of depth 3, a tenth of each step."""
    return fitted(d, "gbt", lambda: boosted(d, [0, 1], rounds=100, depth=3, rate=0.1))


def penalised(d):
    """50 rounds of depth 6 with penalised leaves; negative predictions are lifted to 0."""
    scored = fitted(d, "xgb", lambda: boosted(d, [0, 1, 2], rounds=50, depth=6, rate=0.3, penalty=1.0))
    return scored.withColumn("p", F.transform("p", lambda p: F.greatest(p, F.lit(0.0))))


def presence_forest(d):
    """Shares of 100 trees for presence of each species."""
    def fit():
        rows = materialize(features(d).select("hotspot_id", "split", "x", "y"), "features")
        size = rows.agg(F.max(F.size("y"))).first()[0] or 0
        return trees.forest(rows, size, "x", "y", "hotspot_id", trees=100, seed=1, depth=30)

    return fitted(d, "forest", fit)


@query("gbt_baseline", LEARNED.format(seeds=2), "mean_target", "seed species_idx n_train n_other")
def gbt_baseline(d):
    return learning(regressor(d), ["seed"])


@query("gbt_scores")
def gbt_scores(d):
    """Errors and top-k of each seed on validation and test."""
    return scored_by(regressor(d).filter(F.col("split") != "train"), ["seed", "split"])


@query("xgb_baseline", LEARNED.format(seeds=3), "mean_target", "seed species_idx n_train n_other")
def xgb_baseline(d):
    return learning(penalised(d), ["seed"])


@query("xgb_scores")
def xgb_scores(d):
    """Cross-entropy, squared and absolute error of each seed outside train."""
    outside = penalised(d).filter(F.col("split") != "train")
    return metrics.evaluate(outside, {"ce": metrics.clipped_ce_sum(), "mse": metrics.mse(), "mae": metrics.mae()}, by=["seed", "split"])


def ridge_fit(d):
    rows = materialize(features(d).select("hotspot_id", "split", "x", "y"), "features")
    return rows, baselines.ridge_weights(rows.filter(F.col("split") == "train"), "x", "y")


@query("ridge_baseline", """
SELECT feature, species_idx, 0e0 AS residual, TRUE AS bounded FROM (SELECT unnest(range(28)) AS feature) g CROSS JOIN fx_list
WHERE EXISTS (SELECT 1 FROM fx_pred WHERE split = 'train' AND loc_key IN (SELECT vec_id FROM embeddings))""", "residual", "feature species_idx")
def ridge_baseline(d):
    """The normal equations over all train rows: X'(Xw - y) + w is zero for each feature (0 the unpenalised intercept) and species."""
    rows, weights = ridge_fit(d)
    return baselines.ridge_residuals(rows.filter(F.col("split") == "train"), "x", "y", weights)


@query("ridge_predictions")
def ridge_predictions(d):
    rows, weights = ridge_fit(d)
    scored = baselines.ridge_predict(rows, "x", weights)
    return scored.select("hotspot_id", "split", arrays.unrolled("p", "species_idx", "p"))


@query("rf_presence", """
SELECT species_idx, count(CASE WHEN split = 'train' THEN 1 END) AS n_train, count(CASE WHEN split <> 'train' THEN 1 END) AS n_other,
       count(CASE WHEN split = 'train' AND y > 0 THEN 1 END) AS n_present, TRUE AS learned
FROM fx_pred WHERE loc_key IN (SELECT vec_id FROM embeddings) GROUP BY species_idx""", bigints="species_idx n_train n_other n_present")
def rf_presence(d):
    """100 trees for each species; on train they agree with presence at least as often as the commoner answer does."""
    voted = presence_forest(d)
    train, present = F.col("split") == "train", F.col("y") > 0
    right = F.count_if(train & (present == (F.col("p") > 0.5)))
    usual = F.greatest(F.count_if(train & present), F.count_if(train & ~present))
    return metrics.cells(voted, "split").groupBy("species_idx").agg(
        F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_other"), F.count_if(train & present).alias("n_present"), (right >= usual).alias("learned"))


@query("rf_scores")
def rf_scores(d):
    """Agreement of labels and absolute error of the shares outside train, as the classifier is judged."""
    voted = presence_forest(d)
    return metrics.label_agreement(voted.filter(F.col("split") != "train"))


@query("bias_from_means", """
SELECT species_idx, ln(m / (1 - m)) AS bias FROM (SELECT species_idx, greatest(1e-10, least(1 - 1e-10, avg(y))) AS m FROM fx_rate GROUP BY species_idx) t""", "bias", "species_idx")
def bias_from_means(d):
    return baselines.logit_bias(species.mean_rates(d.targets))


@query("subset_targets", "SELECT hotspot_id, species_idx // 5 AS place, y AS rate FROM fx_rate WHERE species_idx % 5 = 0", "rate", "place")
def subset_targets(d):
    indices = F.sequence(F.lit(0), F.size("probs") - 1, F.lit(5))
    kept = d.targets.select("hotspot_id", baselines.subset_vector("probs", indices).alias("probs"))
    return encounter.long_targets(kept).withColumnRenamed("species_idx", "place")


@query("species_frequencies", "SELECT species_idx, sum(y * n) AS frequency FROM fx_rate GROUP BY species_idx", "frequency", "species_idx")
def species_frequencies(d):
    return species.frequencies(d.targets)


@query("most_least_common", """
WITH f AS (SELECT species_idx, round(sum(y * n), 9) AS f FROM fx_rate GROUP BY species_idx)
SELECT (SELECT species_idx FROM f ORDER BY f DESC, species_idx LIMIT 1) AS most_common,
       (SELECT species_idx FROM f WHERE f > 0 ORDER BY f, species_idx LIMIT 1) AS least_common""", bigints="most_common least_common")
def most_least_common(d):
    return species.most_least_common(species.frequencies(d.targets))


@query("random_subset", f"""
WITH f AS (SELECT species_idx, round(sum(y * n), 9) AS f FROM fx_rate GROUP BY species_idx),
 e AS (SELECT species_idx FROM (SELECT species_idx FROM f ORDER BY f DESC, species_idx LIMIT 1) a
       UNION SELECT species_idx FROM (SELECT species_idx FROM f WHERE f > 0 ORDER BY f, species_idx LIMIT 1) b)
SELECT species_idx FROM e UNION ALL
SELECT species_idx FROM (SELECT species_idx FROM f WHERE f > 0 AND species_idx NOT IN (SELECT species_idx FROM e)
  ORDER BY {uniform(3, "species_idx")}, species_idx LIMIT 8) r""", bigints="species_idx")
def random_subset(d):
    return species.random_subset(species.frequencies(d.targets), 10, seed=3)


@query("zero_in_both", """
WITH w AS (SELECT species FROM fx_obs WHERE complete = 1 AND month(obs_date) IN (12, 1) AND year(obs_date) >= 1996)
SELECT species_idx FROM fx_rate GROUP BY species_idx, species HAVING max(y) = 0 AND species NOT IN (SELECT species FROM w)""", bigints="species_idx")
def zero_in_both(d):
    winter = d.obs.filter((F.col("complete") == 1) & F.month("obs_date").isin(WINTER) & (F.year("obs_date") >= 1996))
    cold = encounter.encounter_targets(winter, d.species_list, 0)
    return species.zero_in_both(species.frequencies(d.targets), species.frequencies(cold))


@query("species_occurrence", "SELECT species_idx, count(CASE WHEN y > 0 THEN 1 END) AS hotspots FROM fx_rate GROUP BY species_idx", bigints="species_idx hotspots")
def species_occurrence(d):
    return species.occurrence_counts(d.targets)


@query("never_present", "SELECT species_idx FROM fx_pred WHERE split = 'test' GROUP BY species_idx HAVING max(y) = 0", bigints="species_idx")
def never_present(d):
    return species.never_present(d.predictions.filter(F.col("split") == "test").select(F.col("y").alias("probs")))


@query("where_is_species", """
SELECT state, count(*) AS hotspots FROM fx_rate r JOIN fx_loc l ON l.hotspot_id = r.hotspot_id WHERE species_idx = 4 AND y > 0 GROUP BY state""", bigints="hotspots")
def where_is_species(d):
    return species.places_of(d.targets, d.loc, F.lit(4), "state")


@query("sparse_binarize", "SELECT hotspot_id, species_idx, 1 AS present FROM fx_rate WHERE y > 0", bigints="species_idx present")
def sparse_binarize(d):
    return species.presence_pairs(d.targets)


RATE_HISTOGRAM = """
WITH m AS (SELECT species_idx, avg(y) AS m FROM fx_rate GROUP BY species_idx {having}),
 b AS (SELECT min(m) AS lo, (max(m) - min(m)) / 1e1 AS step FROM m)
SELECT CAST(least(floor((m - lo) / step), 9) AS BIGINT) AS bin, min(lo + least(floor((m - lo) / step), 9) * step) AS lower_edge, count(*) AS n FROM m CROSS JOIN b GROUP BY 1"""


@query("mean_rate_histogram", RATE_HISTOGRAM.format(having=""), "lower_edge", "n")
def mean_rate_histogram(d):
    return distribution.histogram(species.mean_rates(d.targets), "mean_rate", 10)


@query("mean_rate_histogram_low", RATE_HISTOGRAM.format(having="HAVING avg(y) <= 2e-1"), "lower_edge", "n")
def mean_rate_histogram_low(d):
    return distribution.histogram(species.mean_rates(d.targets).filter(F.col("mean_rate") <= 0.2), "mean_rate", 10)
