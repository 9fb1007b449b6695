"""Streams over tables stored as one file and as a folder of part files."""

from fieldmark.plans import registered
from fieldmark.streaming import ingest


def test_file_and_folder_tables_give_the_batch_result(spark, tmp_path):
    queries = registered.queries()
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    orders.repartition(5).write.parquet(str(tmp_path / "orders.parquet"))
    for folder in ("/root/testdata/sf0.001", str(tmp_path)):
        got = queries["resume_skip_done"](spark, folder)
        assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in orders.select("o_custkey").distinct().collect())


def test_several_batches(spark, tmp_path):
    rows = spark.range(100).selectExpr("id % 40 AS k")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = ingest.table_files(spark, str(tmp_path / "in"), rows.schema, per_trigger=2)
    ingest.append_new(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "k")
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["k"] for r in out.collect()) == list(range(40))
    assert out.select("batch").distinct().count() > 1
