"""Encounter rates over event-time windows of a stream, with mergeable distinct-count sketches as state.

Every log row marks its checklist twice, for the species and for the hotspot as a whole (species NULL). The state keeps one
sketch for each window, hotspot and species: its size is bounded, whatever the number of checklists. Sketches of
windows merge, so months roll up to seasons without the log. The watermark decides how long a window takes late rows and when its
state is left alone. Where exact counts are wanted, distinct marks are the state instead, which grows with the checklists of open windows.

State is what earlier batches have written, never held in an executor's memory: a batch adds its own sketches, which are merged when they
are read, and its own marks but those that an earlier batch wrote for a window still open. Watermarks lie beside the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.streaming import ingest

#: Base-two logarithm of the slots of a sketch: 4,096 slots, a standard error of about 1.6 %; small counts are exact.
SKETCH_BITS = 12


def marks(log: DataFrame, time: str, window: str, delay: str, hotspot: str = "hotspot_id", checklist: str = "checklist_id", species: str = "species") -> DataFrame:
    """(window, hotspot_id, species, checklist_id) of a stream or table; tumbling windows, species NULL for the checklist itself.

    Rows without a time, hotspot or checklist mark nothing; rows without a species still mark their checklist.
    """
    return _marked(_placed(log, time, window, delay, hotspot, checklist, species))


def _placed(log: DataFrame, time: str, window: str, delay: str, hotspot: str = "hotspot_id", checklist: str = "checklist_id", species: str = "species") -> DataFrame:
    """(window, hotspot_id, species, checklist_id) of the rows that mark something, one for each row."""
    known = log.filter(F.col(time).isNotNull() & F.col(hotspot).isNotNull() & F.col(checklist).isNotNull()).withWatermark(time, delay)
    return known.select(F.window(time, window).alias("window"), F.col(hotspot).alias("hotspot_id"), F.col(species).cast("string").alias("species"),
                        F.col(checklist).alias("checklist_id"))


def _marked(placed: DataFrame) -> DataFrame:
    whole = F.lit(None).cast("string")
    named = F.when(F.col("species").isNotNull(), F.array(whole, "species")).otherwise(F.array(whole))
    return placed.select("window", "hotspot_id", F.explode(named).alias("species"), "checklist_id")


def sketch_windows(marked: DataFrame) -> DataFrame:
    """(window, hotspot_id, species, sketch, seen_rows): one distinct-count sketch of checklists each."""
    return marked.groupBy("window", "hotspot_id", "species").agg(
        F.hll_sketch_agg("checklist_id", F.lit(SKETCH_BITS)).alias("sketch"), F.count("*").alias("seen_rows"))


def _run(log: DataFrame, time: str, window: str, delay: str, path: str, checkpoint: str, made: Callable) -> None:
    """Write ``made(rows, latest, earlier)`` for each batch: its rows in time dealt by window and hotspot, the latest time of earlier batches, and
    what those wrote for windows still open; both None if no row came earlier.
    """
    lateness = F.expr(f"INTERVAL '{delay}'")

    def step(batch: DataFrame, batch_id: int) -> None:
        # a repeated batch overwrites its own folders, so a retry after a failure adds nothing twice
        spark, times = batch.sparkSession, f"{checkpoint}/fieldmark-times"
        batch.agg(F.max(time).alias("latest")).write.mode("overwrite").parquet(f"{times}/batch={batch_id}")
        past = spark.read.parquet(times).filter(F.col("batch") < batch_id).agg(F.max("latest").alias("latest"))
        passed, latest = past.select(F.col("latest") - lateness, "latest").first()
        rows, earlier = _placed(batch, time, window, delay), None
        if passed is not None:
            rows = rows.filter(F.col("window.end") > F.lit(passed))
            earlier = spark.read.parquet(path).filter((F.col("batch") < batch_id) & (F.col("window.end") > F.lit(passed)))
        made(rows.repartition("window", "hotspot_id"), latest, earlier).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    ingest._finish(log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_sketches(log: DataFrame, time: str, window: str, delay: str, path: str, checkpoint: str) -> None:
    """Run what has arrived: every batch writes sketches of its rows, without rows of windows behind the watermark."""
    _run(log, time, window, delay, path, checkpoint, lambda rows, latest, earlier: sketch_windows(_marked(rows)))


def latest_windows(spark: SparkSession, path: str) -> DataFrame:
    """Each window, hotspot and species that :func:`stream_sketches` has written, the sketches of all batches merged."""
    return merged(spark.read.parquet(path).drop("batch").repartition("window", "hotspot_id"), F.col("window"))


def stream_distinct(log: DataFrame, time: str, window: str, delay: str, path: str, checkpoint: str) -> None:
    """Exact form: each mark is written once, when it first arrives, unless its window is behind the watermark."""

    def fresh(rows: DataFrame, latest, earlier: DataFrame | None) -> DataFrame:
        found = _marked(rows).distinct()
        if earlier is None:
            return found
        # windows that begin after all that came before hold no earlier mark
        new = F.col("window.start") > F.lit(latest)
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in found.columns]
        return found.filter(new).unionByName(found.filter(~new).alias("a").join(earlier.select(*found.columns).alias("b"), reduce(Column.__and__, same), "left_anti"))

    _run(log, time, window, delay, path, checkpoint, fresh)


def merged(windows: DataFrame, period: Column) -> DataFrame:
    """Sketches of several windows merged: (window, hotspot_id, species, sketch), ``window`` replaced by ``period``."""
    return windows.groupBy(period.alias("window"), "hotspot_id", "species").agg(
        F.hll_union_agg("sketch").alias("sketch"), F.sum("seen_rows").alias("seen_rows"))


def _rates(counts: DataFrame, least: int) -> DataFrame:
    """Counts by species beside the total of their hotspot and window; one shuffle by window and hotspot."""
    each = F.filter(F.collect_list(F.struct("species", "reports")), lambda c: c["species"].isNotNull())  # one entry a species
    total = F.max(F.when(F.col("species").isNull(), F.col("reports")))
    by_hotspot = counts.groupBy("window", "hotspot_id").agg(total.alias("checklists"), each.alias("each")).filter(F.col("checklists") > least)
    rows = by_hotspot.select("window", "hotspot_id", "checklists", F.explode("each").alias("c"))
    return rows.select("window", "hotspot_id", "c.species", "c.reports", "checklists", (F.col("c.reports") / F.col("checklists")).alias("rate"))


def approximate_rates(windows: DataFrame, least: int = 0) -> DataFrame:
    """(window, hotspot_id, species, reports, checklists, rate) from sketches, for hotspots with more than ``least`` checklists."""
    return _rates(windows.select("window", "hotspot_id", "species", F.hll_sketch_estimate("sketch").alias("reports")), least)


def exact_rates(distinct: DataFrame, least: int = 0) -> DataFrame:
    """The same from distinct marks."""
    dealt = distinct.select("window", "hotspot_id", "species").repartition("window", "hotspot_id")
    return _rates(dealt.groupBy("window", "hotspot_id", "species").agg(F.count("*").alias("reports")), least)
