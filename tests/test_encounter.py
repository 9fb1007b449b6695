"""Hand-made frames with known answers for rates, merges, duplicates and splits."""

import pytest
from pyspark.sql import functions as F

from fieldmark.operators import distribution, duplicates, encounter, filters, splits


def log_of(spark, rows):
    return spark.createDataFrame(rows, "hotspot_id string, checklist_id string, species string, state string")


def listing(spark, names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "species string, species_idx int")


def vectors(df):
    return {r["hotspot_id"]: list(r["probs"]) for r in df.collect()}


def test_species_reported_twice_counts_once(spark):
    rows = [("h", f"c{i}", "a", "X") for i in range(6)] + [("h", "c0", "b", "X"), ("h", "c0", "b", "X"), ("h", "c1", "b", "X")]
    t = encounter.encounter_targets(log_of(spark, rows), listing(spark, ["a", "b", "z"]), 5)
    assert vectors(t)["h"] == pytest.approx([1.0, 2 / 6, 0.0])


def test_five_checklists_drop_six_stay(spark):
    rows = [("five", f"c{i}", "a", "X") for i in range(5)] + [("six", f"d{i}", "a", "X") for i in range(6)]
    log = log_of(spark, rows)
    assert set(vectors(encounter.encounter_targets(log, listing(spark, ["a"]), 5))) == {"six"}
    assert [r[0] for r in encounter.checklist_counts(log, 5).collect()] == ["six"]


def test_one_row_in_an_excluded_state_drops_the_hotspot(spark):
    rows = [("bad", f"c{i}", "a", "X") for i in range(6)] + [("bad", "c0", "a", "Y")] + [("good", f"c{i}", "a", None) for i in range(6)]
    log = log_of(spark, rows)
    t = encounter.encounter_targets(log, listing(spark, ["a"]), 5, drop_if=F.col("state").isin("Y"))
    assert set(vectors(t)) == {"good"}
    kept = filters.drop_hotspots_with(log, F.col("state").isin("Y")).select("hotspot_id").distinct().collect()
    assert [r[0] for r in kept] == ["good"]


def test_unlisted_species_count_only_as_different_species(spark):
    rows = [("h", f"c{i}", "a" if i else "unlisted", "X") for i in range(6)]
    row = encounter.encounter_targets(log_of(spark, rows), listing(spark, ["a", "b"]), 5).first()
    assert list(row["probs"]) == pytest.approx([5 / 6, 0.0]) and row["num_different_species"] == 2


def test_events_with_only_unknown_species_count_in_the_denominator(spark):
    rows = [("h", "c0", "a", "X"), ("h", "c1", None, "X")]
    row = encounter.encounter_targets(log_of(spark, rows), listing(spark, ["a"]), 0).first()
    assert list(row["probs"]) == [0.5]


def test_weighted_merge(spark):
    t = spark.createDataFrame([("a", [0.2], 10), ("b", [0.6], 30)], "hotspot_id string, probs array<double>, num_complete_checklists bigint")
    m = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "gone")], "survivor_id string, member_id string")
    row = encounter.merge_targets(t, m).first()
    assert row["rate"] == pytest.approx(0.5) and row["num_complete_checklists"] == 40


def test_attribute_conflicts_treat_null_as_a_value(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "y"), ("b", "y"), ("c", None)], "hotspot_id string, state string")
    assert [r["hotspot_id"] for r in encounter.attribute_conflicts(df, ["state"]).collect()] == ["a"]


def test_suspicious_group_shares_observers_and_date(spark):
    sites = spark.createDataFrame([("a", 1.0, 1.0, 1), ("b", 1.0, 1.0, 2), ("c", 2.0, 2.0, 3), ("d", 2.0, 2.0, 4)], "hotspot_id string, lat double, lon double, seq int")
    log = spark.createDataFrame([("a", 1, "d1"), ("a", 2, "d1"), ("b", 2, "d1"), ("b", 1, "d1"), ("c", 1, "d1"), ("d", 1, "d2")],
                                "hotspot_id string, observer_id int, obs_date string")
    flagged = duplicates.suspicious(duplicates.groups(sites, "hotspot_id", "seq"), log)
    assert sorted(r[0] for r in flagged.collect()) == ["a", "b"]
    assert sorted(r["hotspot_id"] for r in duplicates.drop_suspicious(sites, flagged).collect()) == ["c", "d"]


def greedy(sizes, order, quotas):
    """The plain loop: whole clusters until the quota is met, at least one each."""
    left, out = list(order), {}
    for name in ("valid", "test"):
        got = 0
        while left:
            c = left.pop(0)
            out[c] = name
            got += sizes[c]
            if got >= quotas[name]:
                break
    return {**out, **dict.fromkeys(left, "train")}


@pytest.mark.parametrize("sizes", [{i: 1 for i in range(20)}, {i: 1 + i % 5 for i in range(37)}, {1: 30, 2: 1, 3: 1, 4: 2}])
def test_cluster_split_equals_the_greedy_loop(spark, sizes):
    members = spark.createDataFrame([(c, j) for c, n in sizes.items() for j in range(n)], "cluster_id bigint, member int")
    got = {r["cluster_id"]: r["split"] for r in splits.cluster_split(members, seed=4).select("cluster_id", "split").distinct().collect()}
    n = sum(sizes.values())
    valid = int(0.15 * n)
    quotas = {"valid": valid, "test": n - int(0.7 * n) - valid}
    order = sorted(sizes, key=lambda c: ((c * 7919 + 4 * 104729) % splits.ORDER_SPAN, c))
    assert got == greedy(sizes, order, quotas)
    if len(sizes) == 20:
        assert sorted(got.values()).count("valid") == 3 and sorted(got.values()).count("test") == 3


@pytest.mark.parametrize("bound", [20, 100_000])
def test_exact_quantiles_match_sorting(spark, bound):
    import numpy as np

    rng = np.random.default_rng(5)
    data = {"a": rng.normal(size=500), "b": rng.integers(0, 4, size=333).astype(float), "c": np.array([7.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double")
    got = {(r["k"], r["q"]): r["quantile"] for r in distribution.exact_quantiles(df, "v", [0.02, 0.5, 0.98], ["k"], splitters=16, bound=bound).collect()}
    whole = distribution.exact_quantiles(df, "v", [0.3], splitters=8, bound=bound).first()["quantile"]
    assert whole == pytest.approx(np.quantile(np.concatenate(list(data.values())), 0.3))
    for k, vs in data.items():
        for q in (0.02, 0.5, 0.98):
            assert got[(k, q)] == pytest.approx(np.quantile(vs, q))
    medians = {r["k"]: r["median"] for r in distribution.counted_median(df, ["k"], "v").collect()}
    assert medians["a"] == pytest.approx(np.median(data["a"])) and medians["b"] == np.median(data["b"])


def test_running_sum_over_many_buckets(spark):
    df = spark.range(1000).select(F.col("id"), F.lit(1).alias("one"))
    out = distribution.running_sum(df.repartition(5), F.col("id") % 10, "id", "one")
    assert all(r["before"] == r["id"] % 10 * 100 + r["id"] // 10 for r in out.collect())


def test_cluster_split_accepts_text_labels(spark):
    members = spark.createDataFrame([(f"C{i % 9}", i) for i in range(60)], "cluster_id string, member int")
    rows = splits.cluster_split(members, seed=1)
    per_cluster = rows.groupBy("cluster_id").agg(F.count_distinct("split").alias("n")).collect()
    assert rows.count() == 60 and all(r["n"] == 1 for r in per_cluster)

