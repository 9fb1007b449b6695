"""Windowed encounter rates of a stream: late rows, dropped rows, sketches against exact counts, merged windows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldmark.streaming import encounters, ingest

SCHEMA = "at timestamp, hotspot_id string, checklist_id string, species string"


def _at(day):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=day)


def _arrive(spark, path, *batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return ingest.files(spark, path, spark.read.parquet(path).schema, per_trigger=1)


def _exact(rows, days):
    seen = {}
    for at, hotspot, checklist, species in rows:
        if None in (at, hotspot, checklist):
            continue
        start = (at - dt.datetime(1970, 1, 1)).days // days * days
        for s in (None, species):
            seen.setdefault((start, hotspot), {}).setdefault(s, set()).add(checklist)
    return {(start, hotspot, s): (len(c), len(by[None])) for (start, hotspot), by in seen.items() for s, c in by.items() if s is not None}


def _rates(df):
    return {((r.window.start - dt.datetime(1970, 1, 1)).days, r.hotspot_id, r.species): (round(r.reports), round(r.checklists)) for r in df.collect()}


@pytest.fixture()
def batches():
    first = [(_at(k % 40), f"L{k % 3}", f"S{k % 50}", f"sp{k % 7}") for k in range(600)]
    first += [(None, "L1", "S1", "sp1"), (_at(1), None, "S1", "sp1"), (_at(1), "L1", None, "sp1"), (_at(1), "L1", "S900", None)]
    late = [(_at(5), "L2", "S901", "sp9"), (_at(5), "L2", "S901", "sp9")]  # late, but inside the delay
    second = [(_at(60 + k % 20), f"L{k % 3}", f"S{k % 90}", f"sp{k % 5}") for k in range(300)]
    return first, second + late


def test_stream_equals_batch_with_late_rows(spark, tmp_path, batches):
    log = _arrive(spark, f"{tmp_path}/log", *batches)
    encounters.stream_distinct(log, "at", "10 days", "100 days", f"{tmp_path}/distinct", f"{tmp_path}/c1")
    encounters.stream_sketches(log, "at", "10 days", "100 days", f"{tmp_path}/sketch", f"{tmp_path}/c2")
    want = _exact([r for b in batches for r in b], 10)
    assert _rates(encounters.exact_rates(spark.read.parquet(f"{tmp_path}/distinct"))) == want
    windows = encounters.latest_windows(spark, f"{tmp_path}/sketch")
    assert _rates(encounters.approximate_rates(windows)) == want  # small sketches are exact
    assert spark.read.parquet(f"{tmp_path}/sketch").select("batch").distinct().count() >= 2


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path, batches):
    first, second = batches
    third = [(_at(0), "L0", "S999", "sp0"), (_at(75), "L0", "S998", "sp0")]  # 75 days behind with a delay of 20; in time
    log = _arrive(spark, f"{tmp_path}/log", first, second[:300], [(_at(79), "L0", "S997", "sp0")], third)
    encounters.stream_distinct(log, "at", "10 days", "20 days", f"{tmp_path}/distinct", f"{tmp_path}/c")
    kept = {r.checklist_id for r in spark.read.parquet(f"{tmp_path}/distinct").select("checklist_id").collect()}
    assert "S998" in kept and "S999" not in kept


def test_a_second_run_goes_on_where_the_first_stopped(spark, tmp_path, batches):
    first, second = batches
    for rows in (first, second):
        log = _arrive(spark, f"{tmp_path}/log", rows)
        encounters.stream_sketches(log, "at", "10 days", "100 days", f"{tmp_path}/sketch", f"{tmp_path}/c")
    assert _rates(encounters.approximate_rates(encounters.latest_windows(spark, f"{tmp_path}/sketch"))) == _exact(first + second, 10)


def test_sketches_stay_close_and_merge(spark):
    rows = spark.range(60_000).selectExpr("timestamp'2020-01-01' + make_dt_interval(cast(id % 90 as int)) AS at", "'L1' AS hotspot_id",
                                          "concat('S', id % 20000) AS checklist_id", "concat('sp', id % 2) AS species")
    windows = encounters.sketch_windows(encounters.marks(rows, "at", "30 days", "1 day"))
    whole = encounters.merged(windows, F.struct(F.lit("all").alias("start")))
    got = {r.species: r for r in encounters.approximate_rates(whole).collect()}
    for s in ("sp0", "sp1"):
        assert abs(got[s].reports - 10_000) < 500 and abs(got[s].checklists - 20_000) < 1000
    exact = encounters.exact_rates(encounters.marks(rows, "at", "30 days", "1 day").distinct()).select("window", "species", F.col("reports").alias("exact"))
    near = encounters.approximate_rates(windows).join(exact, ["window", "species"])
    assert near.filter("abs(reports - exact) > 0.05 * exact").count() == 0 and near.count() >= 6
