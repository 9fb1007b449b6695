"""Quality checks and incremental runs."""

from pyspark.sql import functions as F

from fieldmark import session
from fieldmark.operators import filters, metrics, quality, samples
from fieldmark.plans.catalog import query
from fieldmark.streaming import encounters, ingest


@query("modality_completeness", """
SELECT hotspot_id, 'env' AS modality FROM fx_site WHERE site_key NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT hotspot_id, 'occurrences' FROM fx_site WHERE hotspot_id NOT IN (SELECT hotspot_id FROM fx_occ)
UNION ALL SELECT hotspot_id, 'orders' FROM fx_site WHERE site_key NOT IN (SELECT o_custkey FROM orders)""")
def modality_completeness(d):
    def ids(table, column):
        return d.table(table).select(F.concat(F.lit("C"), F.col(column).cast("string")).alias("hotspot_id"))

    return quality.incomplete_modalities(d.site, {"env": ids("embeddings", "vec_id"), "occurrences": d.occ, "orders": ids("orders", "o_custkey")})


@query("nan_images", "SELECT patch_key, count(*) AS missing FROM fx_patch WHERE value IS NULL GROUP BY patch_key", bigints="missing")
def nan_images(d):
    return samples.with_gaps(d.patch.unionByName(d.image)).select("patch_key", F.size(F.filter("img.data", lambda v: v.isNull())).alias("missing"))


@query("expected_lengths", """
SELECT hotspot_id, 24 AS targets, 24 - (loc_key % 2) AS predictions FROM (SELECT DISTINCT hotspot_id, loc_key FROM fx_rate) t WHERE loc_key % 2 = 1""",
       bigints="targets predictions")
def expected_lengths(d):
    cut = d.predictions.withColumn("p", F.expr("slice(p, 1, size(p) - cast(loc_key % 2 as int))"))
    return quality.wrong_lengths(cut, 24, {"targets": "y", "predictions": "p"})


@query("incremental_ingest", """
SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (6, 7) THEN 'summer' ELSE 'winter' END AS season FROM orders
WHERE o_orderstatus <> 'P' AND month(o_orderdate) IN (6, 7, 12, 1)""")
def incremental_ingest(d):
    """The checklist log read as a stream; equal to the batch filter."""
    log = ingest.table_files(d.spark, f"{d.folder}/orders.parquet", d.table("orders").schema)
    rows = log.select("o_orderkey", F.to_date("o_orderdate").alias("obs_date"), "o_orderstatus").filter(F.col("o_orderstatus") != "P")
    path = session.scratch_path(d.spark, "ingest")
    ingest.append_partitioned(filters.with_season(rows).select("o_orderkey", "season"), path, path + "-checkpoint", ["season"])
    return d.spark.read.parquet(path).select("o_orderkey", "season")


@query("resume_skip_done", "SELECT DISTINCT o_custkey FROM orders")
def resume_skip_done(d):
    """Two runs over the same folder; the second finds everything done."""
    path = session.scratch_path(d.spark, "resume")
    for run in ("first", "second"):
        stream = ingest.table_files(d.spark, f"{d.folder}/orders.parquet", d.table("orders").schema).select("o_custkey")
        ingest.append_new(stream, f"{path}/run={run}", f"{path}-{run}-checkpoint", "o_custkey",
                          work=None if run == "first" else lambda b: b.join(d.spark.read.parquet(f"{path}/run=first").select("o_custkey"), "o_custkey", "left_anti"))
    return d.spark.read.parquet(path).select("o_custkey")


@query("running_metrics", "SELECT split, sum(abs(y - p)) AS total, count(*) AS n FROM fx_pred GROUP BY split", "total", "n")
def running_metrics(d):
    """Prediction rows arrive as files; the state after the last file equals the batch sums."""
    source, path = session.scratch_path(d.spark, "predictions"), session.scratch_path(d.spark, "state")
    d.predictions.repartition(3).write.parquet(source)
    stream = ingest.files(d.spark, source, d.spark.read.parquet(source).schema, per_trigger=1)
    errors = metrics.cells(stream, "split").select("split", F.abs(F.col("y") - F.col("p")).alias("error"))
    ingest.running_state(errors, path, path + "-checkpoint", ["split"], "error")
    return ingest.latest_state(d.spark, path)


def _arrivals(d, rows, path):
    """The stream of ``rows`` in four deliveries, two years each, one row in twenty a delivery late: yields it after every delivery.

    The rows are written once, in a folder for each delivery; each delivery is as many files as its rows fill.
    """
    chunk = F.floor((F.year("obs_date") - 1992) / 2) + F.when(F.crc32("checklist_id") % 20 == 0, 1).otherwise(0)
    chunks = session.materialize(rows.withColumn("chunk", F.greatest(F.lit(0), F.least(F.lit(3), chunk))), "arrivals", ("chunk",))
    for k in range(4):
        chunks.filter(F.col("chunk") == k).drop("chunk").write.mode("append").parquet(path)
        yield ingest.files(d.spark, path, rows.schema)


@query("streaming_encounter", """
WITH m AS (SELECT hotspot_id, checklist_id, species, DATE '1970-01-01' + CAST((obs_date - DATE '1970-01-01') // 30 * 30 AS INT) AS window_start
           FROM fx_obs WHERE complete = 1),
 t AS (SELECT window_start, hotspot_id, count(DISTINCT checklist_id) AS checklists FROM m GROUP BY 1, 2),
 r AS (SELECT window_start, hotspot_id, species, count(DISTINCT checklist_id) AS reports FROM m WHERE species IS NOT NULL GROUP BY 1, 2, 3)
SELECT r.window_start, r.hotspot_id, r.species, reports, checklists, CAST(reports AS DOUBLE) / checklists AS rate, TRUE AS sketch_is_close
FROM r JOIN t ON t.window_start = r.window_start AND t.hotspot_id = r.hotspot_id""", "rate", "reports checklists")
def streaming_encounter(d):
    """Windows of 30 days over the log as a stream, late rows included: exact rates, and whether the sketches come within 5 %."""
    rows = d.obs.filter(F.col("complete") == 1).select("hotspot_id", "checklist_id", "species", "obs_date", F.col("obs_date").cast("timestamp").alias("at"))
    path = session.scratch_path(d.spark, "encounters")
    for log in _arrivals(d, rows, f"{path}/log"):
        encounters.stream_sketches(log, "at", "30 days", "800 days", f"{path}/sketches", f"{path}/sketches-checkpoint")
        encounters.stream_distinct(log, "at", "30 days", "800 days", f"{path}/distinct", f"{path}/distinct-checkpoint")
    exact = encounters.exact_rates(d.spark.read.parquet(f"{path}/distinct"))
    near = encounters.approximate_rates(encounters.latest_windows(d.spark, f"{path}/sketches")).select(
        "window", "hotspot_id", "species", F.col("reports").alias("about"), F.col("checklists").alias("about_all"))
    close = (F.abs(F.col("about") - F.col("reports")) <= 0.05 * F.col("reports")) & (F.abs(F.col("about_all") - F.col("checklists")) <= 0.05 * F.col("checklists"))
    both = exact.join(near, ["window", "hotspot_id", "species"], "left")
    judged = both.select(F.to_date("window.start").alias("window_start"), "hotspot_id", "species", "reports", "checklists", "rate",
                         F.coalesce(close, F.lit(False)).alias("sketch_is_close"))
    # both sides are dealt by window and hotspot already
    with session.settings(d.spark, {session.ALL_KEYS: "false"}):
        return session.materialize(judged, "encounter-rates")
