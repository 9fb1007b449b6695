"""Readers and sinks: missing numbers, array files, dates of a listing."""

import math

import pytest
from pyspark.sql import functions as F

from fieldmark import schemas
from fieldmark.sources import array_files, readers, writers


def test_nan_is_missing_at_every_depth(spark):
    nan = math.nan
    rows = [(1, nan, [nan, 1.0, None], {"h": 2, "data": [[nan], None, [2.0]]}), (2, 3.0, None, None)]
    schema = "k int, v double, a array<double>, s struct<h:int,data:array<array<double>>>"
    got = schemas.null_for_nan(spark.createDataFrame(rows, schema))
    assert got.schema == spark.createDataFrame(rows, schema).schema
    first, second = got.orderBy("k").collect()
    assert (first.v, first.a, first.s.h, first.s.data) == (None, [None, 1.0, None], 2, [[None], None, [2.0]])
    assert (second.v, second.a, second.s) == (3.0, None, None)


def test_array_files_are_committed_whole(spark, tmp_path):
    path = f"{tmp_path}/arrays"
    rows = [(f"P{k}", 1, 2, 2, [float(k), None, 2.0, 3.0]) for k in range(20)]
    array_files.save(spark.createDataFrame(rows, array_files.SCHEMA).repartition(3), path)
    array_files.save(spark.createDataFrame([("Q", 1, 1, 1, [7.0])], array_files.SCHEMA), path)
    got = {r.hotspot_id: (r.bands, r.h, r.w, r.data) for r in readers.array_files(spark, path).collect()}
    assert got == {n: (b, h, w, d) for n, b, h, w, d in rows} | {"Q": (1, 1, 1, [7.0])}
    assert not list(tmp_path.glob("arrays/_staging*"))
    broken = spark.createDataFrame([(f"X{k}", 1, 1, 1, [1.0] if k else [1.0, 2.0]) for k in range(5)], array_files.SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="reshape"):
        array_files.save(broken, path)
    assert {r.hotspot_id for r in readers.array_files(spark, path).collect()} == set(got)
    assert not list(tmp_path.glob("arrays/_staging*"))


def test_dates_of_a_listing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a_20200131_x"), (2, "a_20200131_x"), (3, "notes"), (4, "a_20209931_x")], "k int, tile string")
    writers.by_columns(rows, f"{tmp_path}/tiles", ["tile"])
    got = readers.dated_files(spark.read.parquet(f"{tmp_path}/tiles"), r"(a|b)_(?<date>\d{8})_x", "%Y%m%d").collect()
    assert {r.k for r in got} == {1, 2} and {str(r.maxt) for r in got} == {"2020-01-31 23:59:59.999999"}


def test_buckets_get_files_by_their_rows(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("L"), (F.col("id") % 3 * 1000 + 7).cast("string")).alias("hotspot_id"), "id").union(
        spark.createDataFrame([("L8", 0)], "hotspot_id string, id bigint"))
    writers.by_bucket(rows, f"{tmp_path}/b", rows_per_file=1000)
    assert len(list(tmp_path.glob("b/bucket=7/*.parquet"))) > 1 and len(list(tmp_path.glob("b/bucket=8/*.parquet"))) == 1
    assert spark.read.parquet(f"{tmp_path}/b").count() == 5001
