"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts, repeated epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import WORD, materialize, table

#: Weights of the sources in code point order, repeating; no source is repeated more often than EPOCHS.
WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: Rows in one range of the random order, about; ranges are added up DIGITS hexadecimal digits at a time.
RANGE_ROWS = 256
DIGITS = 3


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, share: float = 1.0, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(_source, source_size, target) from one row a source.

    Sources share ``share`` of all words by weight; a target stops at ``epochs`` times its source's size and the excess is
    shared again among the others. Sources are capped in the order of size over weight, so the level at which
    sharing stops is found with running sums over the sources, one row each.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("_weight", weight).withColumn("_cap", F.lit(epochs) * F.col("source_size"))
    by_level = Window.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("_source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(share)
    left = budget - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    rest = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    # the level if every source before this one is capped and this one isn't; the first that stays below its cap counts
    levelled = ranked.withColumn("_left", left).withColumn("_rest", rest)
    fits = F.col("_left") * F.col("_weight") <= F.col("_cap") * F.col("_rest")
    first = F.min(F.when(fits, F.struct((F.col("_cap") / F.col("_weight")).alias("r"), "_left", "_rest"))).over(everything)
    capped = ~fits & (first.isNull() | (F.col("_cap") / F.col("_weight") < first["r"]))
    target = F.when(capped, F.col("_cap").cast("double")).otherwise(F.col("_weight") * first["_left"] / first["_rest"])
    return levelled.withColumn("_target", target).select("_source", "source_size", F.col("_target").alias("target"))


def _before(sums: DataFrame, digits: int) -> DataFrame:
    """Adds ``_before``: the words of the source in earlier ranges. No window holds more than 16 ** DIGITS rows."""
    if digits <= DIGITS:
        window = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        return sums.withColumn("_before", F.coalesce(F.sum("_words").over(window), F.lit(0)))
    split = sums.withColumn("_coarse", F.substring("_range", 1, digits - DIGITS))
    coarse = _before(split.groupBy("_source", F.col("_coarse").alias("_range")).agg(F.sum("_words").alias("_words")), digits - DIGITS)
    window = Window.partitionBy("_source", "_coarse").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = split.withColumn("_inside", F.coalesce(F.sum("_words").over(window), F.lit(0)))
    start = coarse.select(F.col("_source").alias("_s"), F.col("_range").alias("_r"), F.col("_before").alias("_start"))
    joined = inside.join(start, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_coarse") == F.col("_r")))
    return joined.select("_source", "_range", "_words", (F.col("_inside") + F.col("_start")).alias("_before"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, share: float = 1.0) -> DataFrame:
    """One row for each row of ``df``: the id column, size, source_size, target and taken.

    Whole epochs of a source come first; the rest of its target is cut from the source in a random order that only
    depends on the ids and the seed, and the row at the cut gives only part of its words. Null text has no words, null
    is a source of its own (the last), rows that repeat an id are taken one after the other, and an empty table gives no
    rows. Taken words of a source add up to its target, rounded down.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), words(F.col(text_col)).alias("size"), key.alias("_key"))
    rows = materialize(rows, "sizes")
    ranges = max(1, rows.count() // RANGE_ROWS)
    digits = 1
    while 16 ** digits < ranges:
        digits += 1
    rows = rows.withColumn("_range", F.substring("_key", 1, digits))
    sums = rows.groupBy("_source", "_range").agg(F.sum("size").alias("_words"))
    goal = targets(sums.groupBy("_source").agg(F.sum("_words").alias("source_size")), share)
    goal = goal.select(F.col("_source").alias("_s"), "source_size", "target")
    starts = _before(sums, digits).join(goal, F.col("_source").eqNullSafe(F.col("_s"))).select(
        F.col("_source").alias("_from"), F.col("_range").alias("_at"), "_before", "source_size", "target")
    order = Window.partitionBy("_source", "_range").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum("size").over(order), F.lit(0)))
    placed = placed.join(starts, F.col("_source").eqNullSafe(F.col("_from")) & (F.col("_range") == F.col("_at")))
    goal_words = F.floor("target")
    full = F.when(F.col("source_size") > 0, F.floor(goal_words / F.col("source_size"))).otherwise(0)
    rest = goal_words - full * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before") - F.col("_inside")))
    return placed.select(F.col("_id").alias(id_col), "size", "source_size", "target", (full * F.col("size") + cut).cast("bigint").alias("taken"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def mix_sql(documents: str) -> str:
    """DuckDB text for :func:`mix` over the relation ``documents``, as common table expressions ending in ``mixed``."""
    return rf"""
sized AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
          md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS rnd FROM {documents}),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM per_source),
running AS (SELECT *, 3 * source_size AS cap, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS DOUBLE) AS left_,
            CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS rest_, 3 * source_size / w AS r
            FROM weighted WINDOW b AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level_ AS (SELECT r, left_, rest_ FROM running WHERE left_ * w <= cap * rest_ ORDER BY r, left_, rest_ LIMIT 1),
goals AS (SELECT source, source_size, CASE WHEN NOT (left_ * w <= cap * rest_) AND r < coalesce((SELECT r FROM level_), r + 1) THEN CAST(cap AS DOUBLE)
          ELSE w * (SELECT left_ FROM level_) / (SELECT rest_ FROM level_) END AS target FROM running),
parts AS (SELECT s.*, g.source_size, g.target, floor(g.target) AS goal,
          CASE WHEN g.source_size > 0 THEN floor(floor(g.target) / g.source_size) ELSE 0 END AS full_,
          coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY rnd, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_
          FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
mixed AS (SELECT *, CAST(full_ * size + greatest(0, least(size, goal - full_ * source_size - before_)) AS BIGINT) AS taken FROM parts)"""


QUERIES = {"op2_mixing": op2}
ORACLE = {"op2_mixing": f"WITH {mix_sql('documents')} SELECT doc_id, size, source_size, target, taken FROM mixed"}
