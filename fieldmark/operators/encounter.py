"""Checklists to encounter rates.

The whole path needs one scan and no join of large inputs: each log row is expanded into a species mark and a
checklist mark, both are made distinct together, and one count per (hotspot, species) then carries numerator and
denominator. Dense vectors are built inside a row, after the shuffles, so only non-zero cells travel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions import arrays


def whole_list():
    """Frame over a species list: one row per taxon, thousands at most; never used on observations."""
    return Window.partitionBy(F.lit(0))


def species_dimension(names: DataFrame) -> DataFrame:
    """(species, species_idx) in name order from any column of names; duplicates and NULL vanish first."""
    distinct = names.select("species").filter(F.col("species").isNotNull()).distinct()
    return distinct.withColumn("species_idx", F.row_number().over(whole_list().orderBy("species")) - 1)


def marks(log: DataFrame, hotspot: str = "hotspot_id", checklist: str = "checklist_id", species: str = "species",
          drop_if: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Counts per (hotspot, kind, species): kind 0 = checklists with the species, 1 = checklists, 2 = unwanted rows.

    Attributes in ``carry`` ride on the marks of checklists, and come out as the least value of the hotspot.
    """
    def mark(kind: int, name: Column) -> Column:
        carried = [(F.col(a) if kind == 1 else F.lit(None).cast(log.schema[a].dataType)).alias(a) for a in carry]
        return F.struct(F.lit(kind).alias("kind"), name.alias("species"), *carried)

    items = F.array(mark(0, F.col(species)), mark(1, F.lit(None).cast("string")))
    if drop_if is not None:
        flag = F.array(mark(2, F.lit(None).cast("string")))
        items = F.when(F.coalesce(drop_if, F.lit(False)), F.concat(items, flag)).otherwise(items)
    expanded = (log.select(F.col(hotspot).alias("hotspot_id"), F.col(checklist).alias("checklist_id"),
                           F.inline(items))
                .filter((F.col("kind") > 0) | F.col("species").isNotNull()))
    once = expanded.groupBy("hotspot_id", "checklist_id", "kind", "species").agg(*[F.min(a).alias(a) for a in carry]) if carry else expanded.distinct()
    return once.groupBy("hotspot_id", "kind", "species").agg(F.count("*").alias("checklists"), *[F.min(a).alias(a) for a in carry])


def encounter_rates(log: DataFrame, min_checklists: int = 5, **columns) -> DataFrame:
    """Sparse long form: (hotspot_id, species, rate, num_complete_checklists) for reported species."""
    counts = marks(log, **columns)
    per_hotspot = counts.groupBy("hotspot_id").agg(
        F.max(F.when(F.col("kind") == 1, F.col("checklists"))).alias("num_complete_checklists"),
        F.collect_list(F.when(F.col("kind") == 0, F.struct("species", "checklists"))).alias("cells"))
    return (per_hotspot.filter(F.col("num_complete_checklists") > min_checklists)
            .select("hotspot_id", "num_complete_checklists", F.inline("cells"))
            .select("hotspot_id", "species", (F.col("checklists") / F.col("num_complete_checklists")).alias("rate"),
                    "num_complete_checklists"))


def encounter_targets(log: DataFrame, species_list: DataFrame, min_checklists: int = 5, drop_if: Column | None = None,
                      **columns) -> DataFrame:
    """One row per hotspot: (hotspot_id, probs, num_complete_checklists, num_different_species).

    ``probs`` follows the list order; unlisted species count in ``num_different_species`` only. Hotspots with
    ``min_checklists`` checklists or fewer, or with any row satisfying ``drop_if``, are left out.
    """
    counts = marks(log, drop_if=drop_if, **columns)
    listed = counts.join(species_list.select("species", F.col("species_idx").alias("idx")), "species", "left")
    size = species_list.agg(F.count("*").alias("n")).select("n").scalar()
    cell = F.struct(F.col("idx").cast("int").alias("idx"), F.col("checklists").cast("double").alias("value"))
    per_hotspot = listed.groupBy("hotspot_id").agg(
        F.max(F.when(F.col("kind") == 1, F.col("checklists"))).alias("num_complete_checklists"),
        F.count(F.when(F.col("kind") == 0, 1)).alias("num_different_species"),
        F.max(F.when(F.col("kind") == 2, 1).otherwise(0)).alias("unwanted"),
        F.sort_array(F.collect_list(F.when(F.col("idx").isNotNull(), cell))).alias("cells"))
    kept = per_hotspot.filter((F.col("num_complete_checklists") > min_checklists) & (F.col("unwanted") == 0))
    share = F.transform("cells", lambda c: F.struct(c["idx"].alias("idx"), (c["value"] / F.col("num_complete_checklists")).alias("value")))
    return (kept.withColumn("cells", share).withColumn("size", size)
            .select("hotspot_id", arrays.scatter(F.col("cells"), F.col("size")).alias("probs"), "num_complete_checklists",
                    "num_different_species"))


def long_targets(targets: DataFrame, vector: str = "probs", value: str = "rate") -> DataFrame:
    keep = [c for c in targets.columns if c != vector]
    return targets.select(*keep, arrays.unrolled(vector, "species_idx", value))


def checklist_counts(log: DataFrame, min_checklists: int = 5) -> DataFrame:
    """Distinct checklists per hotspot."""
    return (log.select("hotspot_id", "checklist_id").distinct().groupBy("hotspot_id")
            .agg(F.count("checklist_id").alias("num_complete_checklists"))
            .filter(F.col("num_complete_checklists") > min_checklists))


def hotspot_entries(log: DataFrame, attributes: Sequence[str], min_checklists: int = 5) -> DataFrame:
    """Attributes, checklist count and species count per hotspot, from one scan of the log."""
    counts = marks(log, carry=attributes).groupBy("hotspot_id").agg(
        *[F.min(a).alias(a) for a in attributes],
        F.max(F.when(F.col("kind") == 1, F.col("checklists"))).alias("num_complete_checklists"),
        F.count(F.when(F.col("kind") == 0, 1)).alias("num_different_species"))
    return counts.filter(F.col("num_complete_checklists") > min_checklists)


def attribute_conflicts(log: DataFrame, attributes: Sequence[str], key: str = "hotspot_id") -> DataFrame:
    """Hotspots where an attribute has more than one value, NULL counting as a value."""
    aggs = []
    for a in attributes:
        mixed = (F.min(a) != F.max(a)) | ((F.count(a) > 0) & (F.count(a) < F.count("*")))
        aggs.append(F.coalesce(mixed, F.lit(False)).alias(f"{a}_conflict"))
    flagged = log.groupBy(key).agg(*aggs)
    any_conflict = F.array_contains(F.array(*[F.col(f"{a}_conflict") for a in attributes]), True)
    return flagged.filter(any_conflict)


def merge_targets(targets: DataFrame, merge_map: DataFrame) -> DataFrame:
    """Weighted re-merge: rate = sum(rate * n) / sum(n) over each survivor and its members.

    ``merge_map`` holds (survivor_id, member_id), one row per member, the survivor included. Members without a
    target are passed over; groups without any checklist are dropped. A member ships its non-zero cells, one weight and the
    length of its vector; they are summed per (survivor, species) with partial aggregation, so a survivor with many members
    stays spread over tasks, and vectors are widened after the last shuffle.
    """
    named = merge_map.join(targets, merge_map["member_id"] == targets["hotspot_id"])
    n = F.col("num_complete_checklists").cast("double")

    def entry(idx: Column, value: Column) -> Column:
        return F.struct(idx.cast("int").alias("idx"), value.cast("double").alias("value"))

    cells = F.filter(F.transform("probs", lambda rate, i: entry(i, rate * n)), lambda c: c["value"] != 0)
    entries = F.concat(cells, F.array(entry(F.lit(-1), n), entry(F.lit(-2), F.size("probs"))))
    sums = named.select("survivor_id", F.inline(entries)).groupBy("survivor_id", "idx").agg(F.sum("value").alias("value"), F.max("value").alias("most"))
    wide = sums.groupBy("survivor_id").agg(
        F.max(F.when(F.col("idx") == -1, F.col("value"))).alias("n"), F.max(F.when(F.col("idx") == -2, F.col("most"))).alias("size"),
        F.sort_array(F.collect_list(F.when(F.col("idx") >= 0, F.struct("idx", "value")))).alias("cells")).filter(F.col("n") > 0)
    rates = F.transform("cells", lambda c: F.struct(c["idx"].alias("idx"), (c["value"] / F.col("n")).alias("value")))
    dense = wide.select(F.col("survivor_id").alias("hotspot_id"), F.col("n").cast("bigint").alias("num_complete_checklists"), rates.alias("cells"), "size")
    dense = dense.withColumn("probs", arrays.scatter(F.col("cells"), F.col("size").cast("int")))
    return dense.select("hotspot_id", arrays.unrolled("probs", "species_idx", "rate"), "num_complete_checklists")


def distinct_with_null(column: str) -> Column:
    """Number of distinct values, NULL counting as one more."""
    return F.count_distinct(F.col(column)) + F.max(F.col(column).isNull().cast("int"))
