"""The number of tasks follows the length of the log."""

from pyspark.sql import functions as F

from fieldmark.plans import inputs, q_quality


def test_a_long_log_is_joined_and_made_distinct_by_more_tasks(spark, monkeypatch):
    from conftest import SMALL
    usual = inputs.Inputs(spark, SMALL)
    assert usual.tasks == 8
    before = sorted(map(str, usual.obs.collect()))
    monkeypatch.setattr(inputs, "ROWS_PER_TASK", 300)
    d = inputs.Inputs(spark, SMALL)
    assert d.tasks == -(-usual.table("lineitem").count() // 300) > 8
    assert d.dealt(d.table("orders"), "o_orderkey").rdd.getNumPartitions() == d.tasks
    assert sorted(map(str, d.obs.collect())) == before
    first = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    inputs.widen(spark, 1)
    assert int(first) == d.tasks and spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "8"


def test_deliveries_are_written_by_several_tasks_in_their_order(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 4).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("checklist_id"),
                                             F.date_add(F.lit("1992-01-01").cast("date"), (F.col("id") % 2900).cast("int")).alias("obs_date"))

    class Folder:
        pass

    folder, path, seen = Folder(), str(tmp_path / "log"), []
    folder.spark = spark
    for log in q_quality._arrivals(folder, rows, path):
        assert log.isStreaming
        now = spark.read.parquet(path)
        seen.append((now.count(), len(now.inputFiles()), now.agg(F.max(F.year("obs_date"))).first()[0]))
    assert seen[-1][0] == 4000 and [y for *_, y in seen] == [1993, 1995, 1997, 1999]
    assert all(files >= 2 * (k + 1) for k, (_, files, _) in enumerate(seen))
