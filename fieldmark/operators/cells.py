"""Equi-joins on grid cells whose crowds are measured first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.session import materialize

#: A cell is crowded beyond one row in SHARE of a side, and beyond LEAST rows; so fewer than SHARE cells are.
SHARE, LEAST = 2000, 20_000
#: A side of a join is broadcast only below this measured size.
BROADCAST_BYTES = 32 << 20


def if_small(df: DataFrame, size: Column) -> DataFrame:
    """Mark a written table for broadcasting when its rows, of ``size`` bytes each, fit."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def crowded(side: DataFrame, keys: Sequence[str], least: int = LEAST) -> DataFrame:
    """(keys as ``_k0``..., _parts): the cells of ``side`` that hold too many rows for one task, and into how many parts they go."""
    counts = materialize(side.groupBy(*keys).agg(F.count("*").alias("_n")), "cells")
    limit = F.greatest(F.lit(least), F.floor(counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("t")).select("t").scalar() / SHARE))
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    return counts.filter(F.col("_n") > limit).select(*named, F.ceil(F.col("_n") / limit).cast("bigint").alias("_parts"))


def join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Column, least: int = LEAST) -> DataFrame:
    """Inner join on ``keys``: rows of ``left`` in crowded cells are dealt out by ``spread``, those of ``right`` repeated there only.

    The crowded cells, fewer than :data:`SHARE`, are broadcast. Both sides should be written tables.
    """
    hot = F.broadcast(materialize(crowded(left, keys, least), "crowds"))
    same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    drop = [f"_k{i}" for i in range(len(keys))] + ["_parts"]
    parts = F.coalesce("_parts", F.lit(1).cast("bigint"))
    a = left.join(hot, same, "left").withColumn("_part", F.pmod(spread, parts)).drop(*drop)
    b = right.join(hot, same, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop(*drop)
    return a.join(b, [*keys, "_part"]).drop("_part")
