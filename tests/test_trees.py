"""Histogram trees of many models against plain recursive trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.operators import trees


def _data(n=90, species=4, features=5, seed=3):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, features)).round(2)
    x[:, 2] = draw.integers(0, 3, n)  # few values, many ties
    y = np.clip(0.3 * x[:, [0]] + (x[:, [2]] > 1) * np.arange(species) / species + draw.normal(size=(n, species)) * 0.1, 0, 1)
    y[:, 1] = 0.25
    y[:, 3] = (y[:, 3] > 0.5) * 0.5
    split = ["train" if k % 10 < 7 else "test" for k in range(n)]
    return x, y, split


def _frame(spark, x, y, split):
    rows = [(f"L{k}", s, [float(v) for v in a], [float(v) for v in b]) for k, (a, b, s) in enumerate(zip(x, y, split))]
    return spark.createDataFrame(rows, "hotspot_id string, split string, x array<double>, y array<double>")


def _codes(x, cuts):
    return np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)])


def _plain(codes, w, g, rule, depth, order):
    """Leaf values by recursion: a function from codes to values."""
    if depth < rule.depth and w.sum() >= 2 * rule.least_weight:
        best = None
        for f in order:
            for cut in np.unique(codes[w > 0, f])[:-1]:
                left = codes[:, f] <= cut
                wl, wr, gl, gr = w[left].sum(), w[~left].sum(), g[left].sum(), g[~left].sum()
                if min(wl, wr) < rule.least_weight:
                    continue
                whole = g.sum() ** 2 / (w.sum() + rule.penalty)
                gain = gl ** 2 / (wl + rule.penalty) + gr ** 2 / (wr + rule.penalty) - whole
                if gain > 1e-9 * max(abs(whole), 1e-12) and (best is None or gain > best[0] * (1 + 2e-8)):
                    best = (gain, f, cut, left)
        if best:
            _, f, cut, left = best
            a = _plain(codes[left], w[left], g[left], rule, depth + 1, order)
            b = _plain(codes[~left], w[~left], g[~left], rule, depth + 1, order)
            return lambda c: np.where(c[:, f] <= cut, a(c), b(c))
    value = g.sum() / (w.sum() + rule.penalty)
    return lambda c: np.full(len(c), value)


@pytest.mark.parametrize("depth,penalty", [(3, 0.0), (2, 1.0)])
def test_boosting_equals_plain_trees(spark, depth, penalty):
    x, y, split = _data()
    train = np.array([s == "train" for s in split])
    df = _frame(spark, x, y, split)
    cuts = trees.cut_points(df.filter("split = 'train'"), "x", 5)
    codes = _codes(x, cuts)
    for values, c in zip(x[train].T, cuts):
        assert np.allclose(c, (np.unique(values)[1:] + np.unique(values)[:-1]) / 2)  # few values: all kept apart
    rounds, rate, seeds = 12, 0.1, [0, 5]
    got = {(r.hotspot_id, r.seed): r.p for r in trees.boost(df.repartition(5), 4, "x", "y", "hotspot_id", seeds, rounds, depth, rate, penalty, width=5).collect()}
    assert len(got) == len(x) * 2
    rule = trees.Rule(depth, penalty)
    for seed in seeds:
        rank = trees._ranks(np.zeros(1, dtype=np.int64), 5, np.array([seed]))[0]
        for s in range(4):
            f = np.full(len(x), y[train, s].mean())
            for _ in range(rounds):
                grown = _plain(codes[train], np.ones(train.sum()), (y[:, s] - f)[train], rule, 0, np.argsort(rank))
                f = f + rate * grown(codes)
            assert np.allclose([got[f"L{k}", seed][s] for k in range(len(x))], f, atol=1e-9), (seed, s)


def test_boosting_does_not_depend_on_partitions(spark):
    x, y, split = _data(60)
    df = _frame(spark, x, y, split)
    a, b = ({(r.hotspot_id, r.seed): [round(v, 9) for v in r.p] for r in trees.boost(d, 4, "x", "y", "hotspot_id", [1], 11, 2, 0.3, 1.0, width=5).collect()}
            for d in (df.coalesce(1), df.repartition(7)))
    assert a == b


def test_forest_equals_plain_trees_on_the_same_draws(spark):
    x, y, split = _data(70)
    train = np.array([s == "train" for s in split])
    df = _frame(spark, x, y, split)
    cuts = trees.cut_points(df.filter("split = 'train'"), "x", 5)
    codes = _codes(x, cuts)
    rows = {r.hotspot_id: r.h for r in df.select("hotspot_id", F.xxhash64("hotspot_id").alias("h")).collect()}
    keys = np.array([rows[f"L{k}"] for k in range(len(x))])
    count, width = 6, 5
    voted = {r.hotspot_id: r.p for r in trees.forest(df.repartition(3), 4, "x", "y", "hotspot_id", count, 9, 30, width=5).collect()}
    rule = trees.Rule(30, tried=2)
    seeds = np.full(4 * count, 9, dtype=np.int64)

    for s in range(4):
        total = np.zeros(len(x))
        for t in range(count):
            model = s * count + t
            w = trees.poisson_weights(keys, np.array([model]), 9)[:, 0] * train
            g = w * (y[:, s] > 0)
            value, level = {0: (g.sum() / w.sum())}, [(0, np.ones(len(x), bool), 0, 0)]
            where, size = np.zeros(len(x), dtype=int), 1
            while level:
                following, added = [], []
                for node, inside, depth, attempt in level:
                    m = np.array([model])
                    tried = trees._tried(m, np.array([node]), np.array([attempt]), rule, width, seeds)[0]
                    rank = trees._ranks(m, width, seeds)[0]
                    best = None
                    for f in sorted((f for f in tried if f >= 0), key=lambda f: rank[f]):
                        for cut in np.unique(codes[inside & (w > 0), f])[:-1]:
                            left = inside & (codes[:, f] <= cut)
                            right = inside & ~left
                            gain = g[left].sum() ** 2 / w[left].sum() + g[right].sum() ** 2 / w[right].sum() - g[inside].sum() ** 2 / w[inside].sum()
                            if gain > 1e-9 * max(g[inside].sum() ** 2 / w[inside].sum(), 1e-12) and (best is None or gain > best[0] * (1 + 2e-8)):
                                best = (gain, left, right)
                    mixed = 0 < g[inside].sum() < w[inside].sum()
                    if best is None:
                        if mixed and (attempt + 1) * 2 < width:
                            following.append((node, inside, depth, attempt + 1))
                        continue
                    for k, side in enumerate(best[1:]):
                        where[side] = size + k
                        value[size + k] = g[side].sum() / w[side].sum()
                        if depth + 1 < 30 and w[side].sum() >= 2 and 0 < g[side].sum() < w[side].sum():
                            following.append((size + k, side, depth + 1, 0))
                    size += 2
                level = following
            total += np.array([value[k] for k in where])
        assert np.allclose([voted[f"L{k}"][s] for k in range(len(x))], total / count, atol=1e-9), s


def test_odd_tables(spark):
    schema = "hotspot_id string, split string, x array<double>, y array<double>"
    empty = spark.createDataFrame([], schema)
    assert trees.boost(empty, 2, "x", "y", "hotspot_id", [0], 3, 2, 0.1, width=2).count() == 0
    one = spark.createDataFrame([("a", "train", [1.0, 2.0], [0.5, 0.0]), ("b", "test", [1.0, None], [0.1, 0.2])], schema)
    got = {r.hotspot_id: r.p for r in trees.boost(one, 2, "x", "y", "hotspot_id", [0], 3, 2, 0.1, width=2).collect()}
    assert got == {"a": [0.5, 0.0], "b": [0.5, 0.0]}


def test_poisson_draws_have_mean_one():
    w = trees.poisson_weights(np.arange(20_000, dtype=np.int64) * 7919, np.arange(5), 3)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    assert (w[:, 0] != w[:, 1]).mean() > 0.3


def test_one_file_of_rows_is_dealt_over_the_tasks_its_work_is_worth(spark):
    x, y, split = _data(60)
    df = _frame(spark, x, y, split).coalesce(1)
    assert trees.dealt(df, 4, 5).rdd.getNumPartitions() == 1  # little work
    cores = spark.sparkContext.defaultParallelism
    assert trees.dealt(df, 40 * trees.LEAST_WORK, 1).rdd.getNumPartitions() == max(cores, -(-2400 * trees.LEAST_WORK // trees.MOST_WORK))


def test_pairs_walk_alone_as_they_do_together(monkeypatch):
    monkeypatch.setattr(trees, "STRIDE", 7)
    grown = trees.Trees(2)
    at = grown.split(np.array([0, 1]), np.array([0, 0]), np.array([1, 0]), np.array([3, 5]), np.zeros(2), np.zeros(2))
    assert at.tolist() == [1, 1]
    assert grown.split(np.array([0, 0, 1]), np.array([1, 2, 2]), np.array([0, 0, 1]), np.array([2, 6, 1]), np.zeros(3), np.zeros(3)).tolist() == [3, 5, 3]
    bins = np.random.default_rng(1).integers(0, 8, (30, 2)).astype(np.uint8)
    want = [[(5 + (a > 6) if b > 3 else 3 + (a > 2)), (1 if a <= 5 else 3 + (b > 1))] for a, b in bins]
    assert trees.leaves(grown.arrays(), bins, np.arange(2)).tolist() == want
