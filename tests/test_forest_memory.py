"""No process holds all trees of a forest, and the trees are the same however they are grown."""

import numpy as np
import pytest

from fieldmark.operators import trees
from test_trees import _data, _frame


def _voted(df, count=6):
    return {r.hotspot_id: r.p for r in trees.forest(df.repartition(3), 4, "x", "y", "hotspot_id", count, 9, 30, width=5).collect()}


@pytest.fixture()
def frame(spark):
    return _frame(spark, *_data(70))


def test_tasks_grow_whole_trees_that_the_driver_never_holds(frame, monkeypatch):
    def refused(*_):
        raise AssertionError

    monkeypatch.setattr(trees, "_grow_group", refused)
    assert len(_voted(frame)) == 70


@pytest.mark.parametrize("some", [1, 4, 5, 24])
def test_trees_grow_level_by_level_in_groups_with_bounded_nodes(frame, monkeypatch, some):
    want, met, usual = _voted(frame), [], trees._grow_group

    def counted(rows, gradients, grown, models, *rest):
        met.append(grown.models)
        return usual(rows, gradients, grown, models, *rest)

    monkeypatch.setattr(trees, "HELD_BYTES", 0)
    monkeypatch.setattr(trees, "NODES", some * 2 * 49)
    monkeypatch.setattr(trees, "_grow_group", counted)
    got = _voted(frame)
    assert sum(met) == 24 and max(met) == some
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_blocks_parts_and_side_by_side_trees_do_not_matter(frame, monkeypatch):
    want = _voted(frame)
    for name, value in (("PART", 2), ("TOGETHER", 60), ("MOST_WORK", 300), ("LEAST_WORK", 100)):
        monkeypatch.setattr(trees, name, value)
    got = _voted(frame)
    assert all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_repeated_rows_and_rows_without_a_split_get_votes(spark, frame):
    twice = frame.unionByName(frame).unionByName(spark.createDataFrame([("none", None, [0.0] * 5, [0.0] * 4)], frame.schema))
    rows = trees.forest(twice, 4, "x", "y", "hotspot_id", 3, 9, 30, width=5).collect()
    assert len(rows) == 141 and all(len(r.p) == 4 and 0 <= min(r.p) <= max(r.p) <= 1 for r in rows)


def test_a_forest_without_rows_or_train_rows(spark, frame):
    assert trees.forest(frame.limit(0), 0, "x", "y", "hotspot_id", 3, 9, 30, width=5).count() == 0
    assert {tuple(r.p) for r in trees.forest(frame.filter("split = 'test'"), 4, "x", "y", "hotspot_id", 3, 9, 30, width=5).collect()} == {(0.0,) * 4}
