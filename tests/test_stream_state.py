"""What a stream of encounter windows remembers lies in files: no state store, and the results of one across restarts."""

from pyspark.sql import functions as F

from fieldmark.streaming import encounters
from test_encounter_streams import _arrive, _at, _exact, _rates


def _deliveries():
    first = [(_at(k % 40), f"L{k % 3}", f"S{k % 50}", f"sp{k % 7}") for k in range(300)] + [(_at(1), "L1", "S900", None), (None, "L1", "S1", "sp1")]
    second = [(_at(50 + k % 20), f"L{k % 3}", f"S{k % 90}", f"sp{k % 5}") for k in range(200)] + first[:40] + [(_at(3), "L2", "S901", None)]
    third = [(_at(100 + k % 20), f"L{k % 2}", f"S{k}", "sp1") for k in range(50)] + first[250:] + second[:60]
    return first, second, third


def test_marks_are_written_once_across_restarts_without_a_state_store(spark, tmp_path):
    seen = []
    for rows in _deliveries():
        seen += rows
        log = _arrive(spark, f"{tmp_path}/log", rows)
        encounters.stream_distinct(log, "at", "10 days", "300 days", f"{tmp_path}/distinct", f"{tmp_path}/c1")
        encounters.stream_sketches(log, "at", "10 days", "300 days", f"{tmp_path}/sketch", f"{tmp_path}/c2")
        marks = spark.read.parquet(f"{tmp_path}/distinct").drop("batch")
        assert marks.count() == marks.distinct().count()
        assert _rates(encounters.exact_rates(marks)) == _exact(seen, 10)
        windows = encounters.latest_windows(spark, f"{tmp_path}/sketch")
        assert _rates(encounters.approximate_rates(windows)) == _exact(seen, 10)
        assert windows.filter("species IS NULL").agg(F.sum("seen_rows")).first()[0] == sum(None not in r[:3] for r in seen)
    assert not (tmp_path / "c1" / "state").exists() and not (tmp_path / "c2" / "state").exists()


def test_sketches_leave_out_rows_behind_the_watermark(spark, tmp_path):
    late = [(_at(0), "L0", "S999", "sp0"), (_at(62), "L0", "S998", "sp0")]
    log = _arrive(spark, f"{tmp_path}/log", [(_at(0), "L0", "S1", "sp0"), (_at(70), "L0", "S2", "sp0")], late)
    encounters.stream_sketches(log, "at", "10 days", "20 days", f"{tmp_path}/sketch", f"{tmp_path}/c")
    encounters.stream_distinct(log, "at", "10 days", "20 days", f"{tmp_path}/distinct", f"{tmp_path}/d")
    want = {(18260, "L0", "sp0"): (1, 1), (18330, "L0", "sp0"): (1, 1), (18320, "L0", "sp0"): (1, 1)}
    for got in (encounters.approximate_rates(encounters.latest_windows(spark, f"{tmp_path}/sketch")), encounters.exact_rates(spark.read.parquet(f"{tmp_path}/distinct"))):
        assert sorted(_rates(got).values()) == sorted(want.values()) and len(_rates(got)) == 3


def test_a_stream_without_rows(spark, tmp_path):
    log = _arrive(spark, f"{tmp_path}/log", [(None, "L0", "S1", "sp0")], [(None, None, None, None)])
    encounters.stream_distinct(log, "at", "10 days", "20 days", f"{tmp_path}/distinct", f"{tmp_path}/d")
    assert spark.read.parquet(f"{tmp_path}/distinct").count() == 0
