"""Evaluation metrics over rows of vectors ``y`` (targets) and ``p`` (predictions).

Cell metrics explode inside the scan stage and keep only (sum, count) states; ranking metrics sort inside the row.
Neither moves the matrices over the network.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions import arrays, scores
from fieldmark.operators import distribution, species

def cells(pred: DataFrame, *keep: str) -> DataFrame:
    """(keep..., species_idx, y, p)."""
    return pred.select(*keep, arrays.unrolled(F.arrays_zip("y", "p"), "species_idx", "c")).select(*keep, "species_idx", "c.y", "c.p")


def _y() -> Column:
    return F.col("y")


def _p() -> Column:
    return F.col("p")


def mae() -> Column:
    return F.avg(F.abs(_y() - _p()))


def mse() -> Column:
    return F.avg((_y() - _p()) * (_y() - _p()))


def kl() -> Column:
    return F.sum(scores.skip_nan(scores.kl_bernoulli(_y(), _p()))) / F.count("*")


def cross_entropy(present: float = 1.0, absent: float = 1.0, eps: float = 0.0, reduction: str = "mean") -> Column:
    cell = scores.cross_entropy(_y(), _p(), present, absent, eps)
    return F.sum(cell) if reduction == "sum" else F.avg(cell)


def swapped_cross_entropy(present: float = 1.0, absent: float = 1.0) -> Column:
    """The evaluation loop hands (target, prediction) to a metric expecting (prediction, target); kept as a variant."""
    return F.avg(scores.cross_entropy(_p(), _y(), present, absent))


def weighted_cross_entropy(weight: str, eps: float = scores.EPSILON) -> Column:
    """Needs the checklist count ``n`` beside the cells."""
    return F.avg(scores.checklist_weight(F.col("n"), weight) * scores.cross_entropy(_y(), _p(), eps=eps))


def rmsle() -> Column:
    return F.sqrt(F.avg(scores.squared_log_error(_y(), _p())))


def focal(alpha: float = 1.0, gamma: float = 2.0) -> Column:
    return scores.focal(cross_entropy(eps=scores.EPSILON), alpha, gamma)


def presence(threshold: float) -> Column:
    return F.avg(scores.agreement(_y(), _p(), threshold))


def zero_baseline_mse() -> Column:
    return F.avg(_y() * _y())


def clipped_ce_sum() -> Column:
    return F.sum(scores.clipped_cross_entropy(_y(), _p()))


def log_loss() -> Column:
    return F.avg(scores.binary_log_loss(_y(), _p()))


def evaluate(pred: DataFrame, aggregates: dict[str, Column], by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Any number of cell metrics in one pass over the data."""
    table = cells(pred, *by, *keep)
    return table.groupBy(*by).agg(*[c.alias(name) for name, c in aggregates.items()])


def ranking(pred: DataFrame, variants: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Means of row-level ranking scores; rows without a score are passed over."""
    rows = pred.select(*by, *[c.alias(name) for name, c in variants.items()])
    return rows.groupBy(*by).agg(*[F.avg(name).alias(name) for name in variants])


def top_variants(both: bool = False) -> dict[str, Column]:
    return {"topk": scores.top_overlap(_y(), _p()), "top10": scores.top_overlap(_y(), _p(), 10, both),
            "top30": scores.top_overlap(_y(), _p(), 30, both)}


def topk_curve(pred: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Mean overlap / k for several k: a species joins both top-k sets from k = the worse of its two ranks on.

    One count per such rank replaces one comparison per k; what is left is as long as the species list.
    """
    worst = F.zip_with(scores.ranks(_y()), scores.ranks(_p()), lambda a, b: F.greatest(a, b))
    # rank 0 marks the row itself and counts for every k, so the number of rows comes out of the same pass
    ranks = F.concat(F.array(F.lit(0)), worst)
    by_rank = pred.select(F.explode_outer(ranks).alias("rank")).groupBy("rank").agg(F.count("*").alias("c"))
    reached = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rank"))
    points = by_rank.select("rank", "c", F.explode(reached).alias("k"))
    shared = F.coalesce(F.sum(F.when(F.col("rank") > 0, F.col("c"))), F.lit(0))
    n = F.sum(F.when(F.col("rank") == 0, F.col("c")))
    return points.groupBy("k").agg((shared / (F.col("k") * n)).alias("score"))


def explained_variance(pred: DataFrame) -> DataFrame:
    """Variance-weighted over species; species with a constant target are left out of both sums."""
    per = cells(pred).groupBy("species_idx").agg(F.var_pop(_y() - _p()).alias("num"), F.var_pop("y").alias("den"))
    varied = F.col("den") > 0
    return per.agg((F.sum(F.when(varied, F.col("den") - F.col("num"))) / F.sum("den")).alias("explained_variance"))


def r2_multi(pred: DataFrame) -> DataFrame:
    """Uniform mean of per-species R2; a constant target scores 1 when hit exactly, else 0."""
    per = cells(pred).groupBy("species_idx").agg(
        F.sum((_y() - _p()) * (_y() - _p())).alias("sse"), (F.var_pop("y") * F.count("*")).alias("sst"))
    r2 = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.when(F.col("sst") > 0, F.col("sst"))).when(F.col("sse") == 0, 1.0).otherwise(0.0)
    return per.agg(F.avg(r2).alias("r2"))


def subset_errors(pred: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """MAE and MSE on the most and the least frequent species."""
    chosen = species.extremes(targets, n).select("side", "species_idx")
    return cells(pred).join(chosen, "species_idx").groupBy("side").agg(mae().alias("mae"), mse().alias("mse"))


def error_by_target_bin(pred: DataFrame, edges: int = 19) -> DataFrame:
    """Squared and signed error per target bin; the edges are evenly spaced from min to max, the max has its own bin."""
    table = cells(pred)
    b = distribution.bounds(pred.select(F.explode_outer("y").alias("y")), "y")
    step = (b["hi"] - b["lo"]) / F.lit(float(edges - 1))
    slot = F.when(step > 0, F.floor((_y() - b["lo"]) / F.when(step > 0, step)) + 1).otherwise(F.lit(edges))
    e = _p() - _y()
    return table.groupBy(slot.cast("bigint").alias("bin")).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mean_sq"), F.min(e * e).alias("min_sq"), F.max(e * e).alias("max_sq"),
        F.avg(e).alias("mean_err"))


def per_hotspot(pred: DataFrame) -> DataFrame:
    diff = F.zip_with("y", "p", lambda y, p: p - y)
    rows = pred.select("hotspot_id", diff.alias("e"), arrays.nonzero_count(_y()).alias("non_zero"), scores.hits_in_present(_y(), _p()).alias("topk"))
    return rows.select(
        "hotspot_id", arrays.total(F.transform("e", lambda e: F.abs(e))).alias("mae"), arrays.total(F.transform("e", lambda e: e * e)).alias("mse"),
        "non_zero", "topk", scores.display_band(F.col("topk")).alias("band"))


def label_agreement(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Presence labels against thresholded predictions: share of equal cells, mean mismatches per row, MAE."""
    t = F.lit(float(threshold))
    rows = pred.select(F.size("y").alias("s"), F.size(F.filter(F.zip_with("y", "p", lambda y, p: (y > 0) != (p > t)), lambda x: x)).alias("wrong"))
    return rows.agg((1 - F.sum("wrong") / F.sum("s")).alias("exact_match"), F.avg("wrong").alias("hamming"), (F.sum("wrong") / F.sum("s")).alias("mae"))
