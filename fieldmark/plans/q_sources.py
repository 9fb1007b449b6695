"""Sources and sinks; files go to the session's shared scratch folder and are read back."""

from pyspark.sql import functions as F

from fieldmark import session
from fieldmark.functions import arrays
from fieldmark.operators import encounter
from fieldmark.plans.catalog import query
from fieldmark.plans.inputs import split_of
from fieldmark.sources import array_files, readers, writers

OBS_COLUMNS = ["global_id", "hotspot_id", "lat", "lon", "state", "country", "checklist_id", "observer_id", "obs_date", "species", "complete"]
SPLIT = "CASE WHEN site_key % 10 < 7 THEN 'train' WHEN site_key % 10 = 7 THEN 'valid' ELSE 'test' END"


@query("scan_observations", f"SELECT {', '.join(OBS_COLUMNS)} FROM fx_obs", "lat lon", "complete")
def scan_observations(d):
    path = session.scratch_path(d.spark, "observations")
    writers.delimited(d.obs.select(*OBS_COLUMNS), path)
    return readers.observations(d.spark, path)


@query("scan_checklists", """
SELECT DISTINCT checklist_id, hotspot_id, lat, lon, state, country, obs_date, CAST(obs_date + INTERVAL 30 DAY AS DATE) AS edited_date,
       complete FROM fx_obs""", "lat lon", "complete")
def scan_checklists(d):
    path = session.scratch_path(d.spark, "checklists")
    rows = d.obs.select("checklist_id", "hotspot_id", "lat", "lon", "state", "country", "obs_date",
                        F.date_add("obs_date", 30).alias("edited_date"), "complete")
    # the rows of one checklist meet in one task, and tasks grow in number, not in size, with the log
    rows = d.dealt(rows, "checklist_id").distinct()
    writers.delimited(rows, path)
    return readers.checklists(d.spark, path)


@query("scan_occurrences", """
SELECT occurrence_id, event_id, species, lat, lon, country_code, state, occ_date FROM fx_occ""", "lat lon")
def scan_occurrences(d):
    path = session.scratch_path(d.spark, "occurrences")
    writers.delimited(d.occ.select("occurrence_id", "event_id", "species", "lat", "lon", "country_code", "state", "occ_date"), path)
    return readers.occurrences(d.spark, path)


@query("bucket_by_locality", """
SELECT loc_key % 1000 AS bucket, count(*) AS n, count(DISTINCT hotspot_id) AS hotspots FROM fx_obs GROUP BY loc_key % 1000""",
       bigints="bucket n hotspots")
def bucket_by_locality(d):
    path = session.scratch_path(d.spark, "buckets")
    writers.by_bucket(d.obs.select("hotspot_id", "checklist_id", "species"), path)
    back = d.spark.read.parquet(path)
    return back.groupBy("bucket", "hotspot_id").agg(F.count("*").alias("n")).groupBy("bucket").agg(
        F.sum("n").alias("n"), F.count("*").alias("hotspots"))


@query("group_and_append", """
SELECT hotspot_id, count(*) AS n FROM fx_obs GROUP BY hotspot_id""", bigints="n")
def group_and_append(d):
    path = session.scratch_path(d.spark, "append")
    rows = d.obs.select("hotspot_id", "checklist_id", "complete")
    for chunk in (rows.filter("complete = 1"), rows.filter("complete = 0")):
        writers.by_bucket(chunk, path)
    return d.spark.read.parquet(path).groupBy("hotspot_id").agg(F.count("*").alias("n"))


@query("species_dim", "SELECT species, species_idx FROM fx_list", bigints="species_idx")
def species_dim(d):
    path = session.scratch_path(d.spark, "species")
    ordered = d.species_list.agg(F.array_sort(F.collect_list("species")).alias("names"))
    # a list file ends with a blank line; the reader drops it
    ordered.select(F.concat(F.array_join("names", "\n"), F.lit("\n"))).coalesce(1).write.text(path)
    return readers.species_list(d.spark, path).select("species", "species_idx")


@query("targets_json_roundtrip", "SELECT hotspot_id, species_idx, y AS rate, n AS num_complete_checklists FROM fx_rate",
       "rate", "species_idx num_complete_checklists")
def targets_json_roundtrip(d):
    path = session.scratch_path(d.spark, "targets")
    writers.targets_json(d.targets, path)
    return encounter.long_targets(readers.targets_json(d.spark, path))


@query("target_documents", "SELECT hotspot_id, species_idx, y AS rate FROM fx_rate", "rate", "species_idx")
def target_documents(d):
    docs = d.targets.select(writers.target_document().alias("doc"))
    parsed = docs.select(readers.parse_target(F.col("doc")).alias("t")).select("t.hotspot_id", "t.probs")
    return encounter.long_targets(parsed)


@query("write_splits", f"SELECT {SPLIT} AS split, hotspot_id FROM fx_site")
def write_splits(d):
    path = session.scratch_path(d.spark, "splits")
    writers.by_columns(d.site.select("hotspot_id", split_of(F.col("site_key")).alias("split")), path, ["split"])
    return d.spark.read.parquet(path).select("split", "hotspot_id")


@query("load_array_files", """
SELECT concat('P', CAST(patch_key AS STRING)) AS hotspot_id, 4 AS bands, 4 AS h, 4 AS w, band * 16 + y * 4 + x AS pos, value FROM fx_image""", "value", "bands h w pos")
def load_array_files(d):
    """Array files written by the tasks of a committed write and decoded again."""
    path = session.scratch_path(d.spark, "arrays")
    images = d.image.select(F.concat(F.lit("P"), F.col("patch_key").cast("string")).alias("name"), "img.*")
    array_files.save(images, path)
    return readers.array_files(d.spark, path).select("hotspot_id", "bands", "h", "w", arrays.unrolled("data", "pos", "value"))


@query("append_results", """
SELECT split, avg(abs(y - p)) AS mae FROM fx_pred GROUP BY split""", "mae")
def append_results(d):
    path = session.scratch_path(d.spark, "results")
    cells = d.predictions.select("split", F.inline(F.arrays_zip("y", "p")))
    for split in ("train", "valid", "test"):
        writers.append_results(cells.filter(F.col("split") == split).groupBy("split").agg(
            F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae")), path)
    return d.spark.read.parquet(path)


@query("xy_matrices", """
SELECT p.hotspot_id, split, 'x' AS part, layer AS pos, coalesce(value, 0e0) AS value
FROM (SELECT DISTINCT hotspot_id, loc_key, split FROM fx_pred) p JOIN fx_env e ON e.env_key = p.loc_key
UNION ALL SELECT p.hotspot_id, split, 'y', species_idx, y FROM fx_pred p
WHERE loc_key IN (SELECT vec_id FROM embeddings)""", "value", "pos")
def xy_matrices(d):
    path = session.scratch_path(d.spark, "matrices")
    x = d.env_wide.select(F.concat(F.lit("L"), F.col("env_key").cast("string")).alias("hotspot_id"),
                          F.transform("env", lambda v: F.coalesce(v, F.lit(0.0))).alias("x"))
    writers.matrices(x, d.predictions.select("hotspot_id", "split", "y"), path)
    back = d.spark.read.parquet(path)
    parts = F.array(*[F.struct(F.lit(n).alias("part"), F.col(n).alias("vector")) for n in ("x", "y")])
    return back.select("hotspot_id", "split", F.inline(parts)).select(
        "hotspot_id", "split", "part", arrays.unrolled("vector", "pos", "value"))


@query("parse_wkt", """
SELECT hotspot_id, pos, CASE WHEN pos IN (0, 1) THEN lon - 5e-1 ELSE lon + 5e-1 END AS x,
       CASE WHEN pos IN (0, 3) THEN lat - 5e-1 ELSE lat + 5e-1 END AS y
FROM fx_site CROSS JOIN (SELECT unnest(range(4)) AS pos) g""", "x y", "pos")
def parse_wkt(d):
    def corner(dx, dy):
        return F.format_string("%s %s", (F.col("lon") + dx).cast("string"), (F.col("lat") + dy).cast("string"))

    text = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", corner(-0.5, -0.5), corner(-0.5, 0.5), corner(0.5, 0.5), corner(0.5, -0.5)), F.lit("))"))
    rings = d.site.select("hotspot_id", text.alias("geometry")).select("hotspot_id", F.posexplode(readers.wkt_ring(F.col("geometry"))).alias("pos", "p"))
    return rings.select("hotspot_id", "pos", F.col("p.lon").alias("x"), F.col("p.lat").alias("y"))


@query("collect_predictions", """
SELECT hotspot_id, loc_key AS place, species_idx, p FROM fx_pred WHERE split = 'test'""", "p", "place species_idx")
def collect_predictions(d):
    order = d.loc.filter(F.col("loc_key") % 10 >= 8).select("hotspot_id", F.col("loc_key").alias("place"))
    stored = d.predictions.select("hotspot_id", "p")
    return order.join(stored, "hotspot_id").select("hotspot_id", "place", arrays.unrolled("p", "species_idx", "p"))


@query("date_from_filename", """
SELECT scene_id, date_trunc('month', acquired) - INTERVAL 1 MICROSECOND AS mint,
       date_trunc('month', acquired) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND AS maxt FROM fx_scene WHERE scene_id % 50 <> 0""")
def date_from_filename(d):
    """Scenes stored in folders named after their month, and some in a folder without a date, read back with the dates of the listing."""
    path = session.scratch_path(d.spark, "tiles")
    dated = F.concat(F.lit("S2_"), F.date_format("acquired", "yyyyMM"), F.lit("_B02"))
    name = F.when(F.col("scene_id") % 50 == 0, "overview").otherwise(dated)
    writers.by_columns(d.scene.select("scene_id", name.alias("tile")), path, ["tile"])
    found = readers.dated_files(d.spark.read.parquet(path), r"S2_(?<date>\d{6})_B\d\d", "%Y%m")
    return found.select("scene_id", "mint", "maxt")
