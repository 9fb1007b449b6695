"""Exact quantiles, running sums and histograms that never gather a whole column in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.session import materialize


#: Distinct values of one group that a single task puts in order.
BOUND = 100_000


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), splitters: int = 1024, bound: int = BOUND) -> DataFrame:
    """Exact linear-interpolation quantiles per group: (keys..., q, quantile).

    Equal values are counted first. While a group has more than ``bound`` of them, a mergeable sketch proposes splitters, counts
    between splitters locate each wanted rank, and only the located intervals go on, each a group of its own; so no task
    ever orders more than ``bound`` values, whatever the group. The answer does not depend on how good the sketch is.
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    by = keys or ["_all"]
    counted = materialize(counted if keys else counted.withColumn("_all", F.lit(0)), "counted")
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("q"), F.lit(float(p)).alias("p")) for p in probs])
    ranks = counted.groupBy(*by).agg(F.sum("c").alias("n")).select(*by, "n", F.inline(wanted))
    ranks = ranks.withColumn("pos", F.col("p") * (F.col("n") - 1)).select(
        *by, "q", "pos", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))).alias("rank"))
    ranks = ranks.withColumn("left", F.col("rank"))  # rank inside the interval
    rows = counted
    while (rows.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0) > bound:
        rows, ranks, by = _narrowed(rows, ranks, by, splitters)
    within = Window.partitionBy(*by)  # at most ``bound`` rows each
    upto = rows.withColumn("upto", F.sum("c").over(within.orderBy("v")))
    hit = (F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("c"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"w.{k}")) for k in by]
    hits = ranks.alias("w").join(upto.alias("r"), reduce(lambda x, y: x & y, [*same, hit]))
    weight = F.lit(1.0) - F.abs(F.col("pos") - F.col("rank"))
    return hits.select(*[F.col(f"w.{k}").alias(k) for k in keys], "q", (F.col("v") * weight).alias("part")).groupBy(*keys, "q").agg(F.sum("part").alias("quantile"))


def _narrowed(rows: DataFrame, ranks: DataFrame, by: list[str], splitters: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Only the intervals between splitters that hold a wanted rank: their values, the ranks inside them, and the columns that name them."""
    slot = f"_slot{len(by)}"
    marks = F.array(*[F.lit(i / splitters) for i in range(1, splitters)])
    cuts = rows.groupBy(*by).agg(F.array_distinct(F.percentile_approx("v", marks, F.lit(10_000))).alias("cuts"))
    named = cuts.select(*[F.col(k).alias(f"_of_{k}") for k in by], "cuts")
    joined = rows.join(named, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by])).drop(*[f"_of_{k}" for k in by])
    # place of the interval = number of splitters below the value, by binary search
    placed = joined.withColumn(slot, lower_bound(F.col("cuts"), F.col("v"), splitters)).drop("cuts")
    slots = placed.groupBy(*by, slot).agg(F.sum("c").alias("c"))
    order = Window.partitionBy(*by).orderBy(slot)  # at most ``splitters`` rows each
    slots = slots.withColumn("before", F.sum("c").over(order) - F.col("c"))
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"s.{k}")) for k in by]
    held = (F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("c"))
    found = ranks.alias("w").join(slots.alias("s"), reduce(lambda x, y: x & y, [*same, held]))
    ranks = materialize(found.select("w.*", F.col(f"s.{slot}").alias(slot), "before").withColumn("left", F.col("left") - F.col("before")).drop("before"), "ranks")
    kept = ranks.select(*[F.col(k).alias(f"_of_{k}") for k in [*by, slot]]).distinct()
    rows = placed.join(kept, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*by, slot]]), "left_semi")
    return materialize(rows, "intervals"), ranks, [*by, slot]


def counted_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact median per key for values from a bounded set (digital numbers): equal values are counted before the
    shuffle, so a group is never longer than the number of distinct values."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    by = Window.partitionBy(*keys)
    placed = counted.withColumn("upto", F.sum("c").over(by.orderBy("v"))).withColumn("n", F.sum("c").over(by))
    before = F.col("upto") - F.col("c")

    def holds(rank: Column) -> Column:
        return ((rank >= before) & (rank < F.col("upto"))).cast("int")

    weight = holds(F.floor((F.col("n") - 1) / 2)) + holds(F.floor(F.col("n") / 2))
    return placed.groupBy(*keys).agg((F.sum(F.col("v") * weight) / 2).alias("median"))


def lower_bound(sorted_values: Column, v: Column, limit: int) -> Column:
    """Number of elements below ``v`` in a sorted array of at most ``limit`` elements."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(limit.bit_length()))])

    def advance(pos: Column, step: Column) -> Column:
        candidate = F.get(sorted_values, pos + step - 1)
        return F.when(candidate < v, pos + step).otherwise(pos)

    return F.aggregate(steps, F.lit(0), advance)


def running_sum(df: DataFrame, order: Column, tie: str, value: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over all rows ordered earlier by ``order``, then ``tie``.

    Rows are dealt into ranges, as many as a shuffle makes of them; one sum for each range is accumulated, then each range
    accumulates its own rows in parallel.
    """
    ranges = df.withColumn("_ord", order).repartitionByRange("_ord", tie).withColumn("_piece", F.spark_partition_id())
    ranges = materialize(ranges, "ranges")  # the pieces must not be dealt anew
    sums = ranges.groupBy("_piece").agg(F.sum(value).alias("_s"))  # one row for each range
    sums = sums.select("_piece", (F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy("_piece")) - F.col("_s")).alias("_base"))
    inside = Window.partitionBy("_piece").orderBy("_ord", tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (ranges.withColumn("_in", F.sum(value).over(inside) - F.col(value)).join(F.broadcast(sums), "_piece")
            .withColumn("before", F.col("_base") + F.col("_in")).drop("_ord", "_piece", "_in", "_base"))


def bounds(df: DataFrame, value: str) -> Column:
    """STRUCT<lo, hi> of a column as a scalar subquery: one row, one partial aggregate."""
    return df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("b")).select("b").scalar()


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Fixed-width bins over [min, max], the last one closed: (bin, lower_edge, n), empty bins left out."""
    b = bounds(df, value)
    step = (b["hi"] - b["lo"]) / F.lit(float(bins))
    slot = F.when(step > 0, F.least(F.floor((F.col(value) - b["lo"]) / F.when(step > 0, step)), F.lit(bins - 1))).otherwise(F.lit(0))
    counted = df.filter(F.col(value).isNotNull()).groupBy(slot.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    return counted.select("bin", (b["lo"] + F.col("bin") * step).alias("lower_edge"), "n")


def value_counts(df: DataFrame, column: str, as_: str = "n") -> DataFrame:
    """Counts per value, NULL left out, most frequent first."""
    return (df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(as_))
            .orderBy(F.desc(as_), column))


def shares(df: DataFrame, key: str) -> DataFrame:
    counted = df.groupBy(key).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("t")).select("t").scalar()
    return counted.withColumn("share", F.col("n") / total)


def many_value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for several columns in one pass; every row emits one pair per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return (df.select(F.inline(pairs)).filter(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count("*").alias("n")))
