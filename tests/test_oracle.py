"""Registered queries against their SQL twins on the smallest tables. FIELDMARK_ALL=1 runs every query."""

import os

import check
import pytest
from conftest import SMALL

from fieldmark.plans import registered

QUERIES, ORACLE = registered.queries(), registered.oracle_sql()
CORE = """encounter_rate hotspot_entry dense_target_vector winter_targets_excluding_states merge_targets_weighted
    duplicate_groups suspicious_groups merge_map season_reconcile bucket_by_locality species_dim date_from_filename
    complete_season_rows season_split dedupe_keep_first month_species_pivot histogram hotspot_size_summary nearest_hotspot
    cluster_5km cluster_split range_membership correct_targets bbox_intersect_join grid_chips sample_point extract_patch
    interpolate_nan image_channel_stds resize_bilinear gaussian_blur transforms_by_mode topk_adaptive per_hotspot_scores
    error_by_target_bin mean_encounter_baseline most_least_common median_mosaic disambiguate_timestamp
    incremental_ingest running_metrics impute_train_mean""".split()


def test_every_query_with_sql_is_registered():
    assert set(ORACLE) <= set(QUERIES)
    assert set(CORE) <= set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("FIELDMARK_ALL") else CORE)
def test_query_matches_sql(spark, name):
    ok, message = check.compare(spark, check.connect(SMALL), name, SMALL, QUERIES, ORACLE)
    assert ok, message


@pytest.mark.parametrize("partitions", ["1", "64"])
def test_results_do_not_depend_on_partitioning(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for name in ("dense_target_vector", "cluster_split", "nearest_hotspot"):
            ok, message = check.compare(spark, check.connect(SMALL), name, SMALL, QUERIES, ORACLE)
            assert ok, message
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
