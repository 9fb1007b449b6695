"""Leak-free dataset splits and train-based imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.operators import distribution

# Fixed value: modulus of the reproducible cluster order.
ORDER_SPAN = 1_000_003


def cluster_order(label: Column, seed: int, numeric: bool = True) -> Column:
    """Reproducible position of a cluster in [0, ORDER_SPAN)."""
    number = label * 7919 + seed * 104729 if numeric else F.xxhash64(label, F.lit(seed))
    return F.pmod(number, F.lit(ORDER_SPAN))


def cluster_split(members: DataFrame, seed: int = 0, valid: float = 0.15, train: float = 0.70, label: str = "cluster_id") -> DataFrame:
    """Adds ``split``: whole clusters in seeded order fill valid, then test, and the rest is train.

    A split takes clusters until its size reaches the quota, so it always gets at least one. Sizes are accumulated
    over the cluster table by :func:`distribution.running_sum`; points are never sorted.
    """
    sizes = members.groupBy(label).agg(F.count("*").alias("size"))
    total = members.agg(F.count("*").alias("n"))
    quota = total.select(F.struct(
        F.floor(F.col("n") * F.lit(valid)).alias("valid"),
        (F.col("n") - F.floor(F.col("n") * F.lit(train)) - F.floor(F.col("n") * F.lit(valid))).alias("test")).alias("q")).select("q").scalar()
    numeric = isinstance(sizes.schema[label].dataType, T.NumericType)
    ordered = distribution.running_sum(sizes, cluster_order(F.col(label), seed, numeric), label, "size")
    in_valid = (F.col("before") < quota["valid"]) | (F.col("before") == 0)
    taken = ordered.filter(in_valid).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("v")).select("v").scalar()
    past = F.col("before") - taken
    choice = F.when(in_valid, "valid").when((past < quota["test"]) | (past == 0), "test").otherwise("train")
    return members.join(ordered.select(label, choice.alias("split")), label)


def inherit_split(rows: DataFrame, parent: DataFrame, key: str = "hotspot_id") -> DataFrame:
    return rows.join(parent.select(key, "split"), key, "left")


def coalesce_split(rows: DataFrame, computed: DataFrame, key: str = "hotspot_id") -> DataFrame:
    """Fill missing splits of ``rows`` with computed ones."""
    found = computed.select(key, F.col("split").alias("_new"))
    return rows.join(found, key, "left").withColumn("split", F.coalesce("split", "_new")).drop("_new")


def from_lists(rows: DataFrame, lists: dict[str, DataFrame], key: str = "hotspot_id") -> DataFrame:
    """Label rows from one id list per split."""
    labelled = None
    for name, ids in lists.items():
        part = ids.select(key, F.lit(name).alias("split"))
        labelled = part if labelled is None else labelled.unionByName(part)
    return rows.join(labelled, key, "left")


def means_vector(df: DataFrame, vector: str, size: int) -> Column:
    """NULL-skipping mean per position as one scalar array: a single aggregate of ``size`` averages."""
    means = df.agg(*[F.avg(F.get(F.col(vector), F.lit(i))).alias(f"m{i}") for i in range(size)])
    return means.select(F.array(*[F.col(f"m{i}") for i in range(size)]).alias("m")).select("m").scalar()


def impute(df: DataFrame, vector: str, means: Column) -> DataFrame:
    filled = df.withColumn("_means", means)  # a subquery may not sit inside a lambda function's arguments
    return filled.withColumn(vector, F.zip_with(vector, "_means", lambda v, m: F.coalesce(v, m))).drop("_means")


def impute_train_mean(df: DataFrame, vector: str, size: int, split: str = "split") -> DataFrame:
    return impute(df, vector, means_vector(df.filter(F.col(split) == "train"), vector, size))


def impute_own_mean(df: DataFrame, vector: str, size: int, split: str = "split") -> DataFrame:
    """Each split filled with its own means: one small row per split, joined back."""
    means = df.groupBy(split).agg(*[F.avg(F.get(F.col(vector), F.lit(i))).alias(f"m{i}") for i in range(size)])
    means = means.select(split, F.array(*[F.col(f"m{i}") for i in range(size)]).alias("_m"))
    return impute(df.join(means, split), vector, F.col("_m")).drop("_m")


def impute_columns(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """Wide form: train means of all columns in one aggregate, filled in every split."""
    means = df.filter(F.col(split) == "train").agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("m")).select("m").scalar()
    return df.withColumns({c: F.coalesce(F.col(c), means[c]) for c in columns})


def split_max(df: DataFrame, value: str, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.max(value).alias(f"max_{value}"))


