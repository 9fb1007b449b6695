"""Classical baselines on point features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.operators import species


def mean_vector(train: DataFrame, vector: str = "y") -> Column:
    """Train means over the species list as one scalar array (one partial row per species and task)."""
    means = species.mean_rates(train, vector)
    return means.agg(F.transform(F.sort_array(F.collect_list(F.struct("species_idx", "mean_rate"))), lambda s: s["mean_rate"]).alias("m")).select("m").scalar()


def mean_encounter(rows: DataFrame, split: str = "split") -> DataFrame:
    """Every row predicted by the train mean: ``p`` replaced."""
    return rows.withColumn("p", mean_vector(rows.filter(F.col(split) == "train")))


def logit_bias(means: DataFrame, eps: float = 1e-10) -> DataFrame:
    """Bias per species: logit of the mean rate, clamped to [eps, 1 - eps]."""
    m = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("mean_rate")))
    return means.select("species_idx", F.ln(m / (1 - m)).alias("bias"))


def subset_vector(vector: str, indices: Column) -> Column:
    source = F.col(vector)
    return F.transform(indices, lambda i: F.get(source, i))


def gram_sums(train: DataFrame, features: str, target: str) -> DataFrame:
    """(i, j, value): sums of the outer product of [1, x] with [1, x, y] over all rows.

    Each task adds up its own batches with a matrix product and ships one small matrix; Spark adds the matrices.
    """

    def partial(batches):
        import numpy as np
        import pandas as pd

        total = None
        for b in batches:
            if not len(b):
                continue
            x = np.column_stack([np.ones(len(b)), np.stack(b["x"].to_list())])
            z = np.column_stack([x, np.stack(b["y"].to_list())])
            total = x.T @ z if total is None else total + x.T @ z
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "value": total.ravel()})

    rows = train.select(F.col(features).alias("x"), F.col(target).alias("y"))
    return rows.mapInPandas(partial, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def ridge_weights(train: DataFrame, features: str, target: str, alpha: float = 1.0):
    """(1 + features) x species weights; the first row is the intercept, which is not penalised.

    Only the summed matrix reaches the driver: its size is features x (features + species), whatever the row count.
    """
    import numpy as np

    cells = gram_sums(train, features, target).toPandas()
    m = np.zeros((cells["i"].max() + 1, cells["j"].max() + 1))
    m[cells["i"], cells["j"]] = cells["value"]
    k = m.shape[0]
    penalty = alpha * np.eye(k)
    penalty[0, 0] = 0.0
    return np.linalg.solve(m[:, :k] + penalty, m[:, k:])


def ridge_predict(rows: DataFrame, features: str, weights) -> DataFrame:
    """Adds ``p``: one matrix product per Arrow batch."""
    from pyspark.sql.functions import pandas_udf

    table = weights.copy()

    @pandas_udf("array<double>")
    def predict(x):
        import numpy as np
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype=object)
        design = np.column_stack([np.ones(len(x)), np.stack(x.to_list())])
        return pd.Series(list(design @ table))

    return rows.withColumn("p", predict(F.col(features)))


def ridge_residuals(train: DataFrame, features: str, target: str, weights, alpha: float = 1.0) -> DataFrame:
    """(feature, species_idx, residual, bounded): what is left of the normal equations, summed over the rows one by one.

    ``residual`` is relative to the sum of the absolute terms; ``bounded`` says that the weight is a finite number.
    """
    table = weights.copy()
    flat = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in table])
    design = F.concat(F.array(F.lit(1.0)), F.col("x"))
    rows = ridge_predict(train.select(F.col(features).alias("x"), F.col(target).alias("y")), "x", weights)
    errors = rows.select(F.posexplode(F.zip_with("p", "y", lambda p, y: p - y)).alias("species_idx", "e"), design.alias("d"))
    terms = errors.select("species_idx", "e", F.posexplode("d").alias("feature", "v"))
    sums = terms.groupBy("feature", "species_idx").agg(F.sum(F.col("v") * F.col("e")).alias("s"), F.sum(F.abs(F.col("v") * F.col("e"))).alias("scale"))
    weight = F.get(F.get(flat, F.col("feature")), F.col("species_idx"))
    penalty = F.when(F.col("feature") > 0, F.lit(alpha) * weight).otherwise(0.0)
    left = F.abs(F.col("s") + penalty) / (F.col("scale") + F.abs(penalty) + F.lit(1e-9))
    return sums.select("feature", "species_idx", F.when(left > 1e-6, left).otherwise(0.0).alias("residual"), (F.abs(weight) < 1e12).alias("bounded"))
