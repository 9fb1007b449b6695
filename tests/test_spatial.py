"""Nearest neighbours, clusters, boxes and polygons against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldmark.functions import geo
from fieldmark.operators import boxes, ranges, spatial


def km(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.POLAR_RADIUS_KM * math.asin(math.sqrt(min(1, h)))


def frame(spark, points):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "k bigint, lat double, lon double")


def crowd(seed, n, spread=0.01, at=(40.0, -90.0)):
    rng = random.Random(seed)
    return [(at[0] + rng.uniform(-spread, spread), at[1] + rng.uniform(-spread, spread)) for _ in range(n)]


@pytest.mark.parametrize("leaf", [64, 2])
def test_nearest_equals_brute_force(spark, monkeypatch, leaf):
    """The small leaf sends every crowded cube through the splitting path."""
    monkeypatch.setattr(spatial, "LEAF", leaf)
    queries, centres = crowd(1, 40, 0.02) + [(89.999, 10.0), (0.0, 179.999)], crowd(2, 60, 0.008) + [(89.999, -170.0), (0.0, -179.998)]
    got = {r["k"]: (r["near_key"], r["distance_km"]) for r in spatial.nearest(frame(spark, queries), frame(spark, centres), "k", 1.5).collect()}
    for i, q in enumerate(queries):
        d, j = min((round(km(q, c), 9), j) for j, c in enumerate(centres))
        if d <= 1.5:
            assert got[i][0] == j and got[i][1] == pytest.approx(d, abs=1e-6)
        else:
            assert i not in got


def union_find(points, limit):
    parent = list(range(len(points)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if km(points[i], points[j]) <= limit:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(points))]


@pytest.mark.parametrize("leaf", [64, 1])
def test_clusters_equal_union_find(spark, monkeypatch, leaf):
    monkeypatch.setattr(spatial, "LEAF", leaf)
    points = crowd(3, 70, 0.15) + [(40.0 + 0.03 * i, -80.0) for i in range(12)] + [(0.0, 179.99), (0.0, -179.99), (89.99, 0.0), (89.99, 180.0), (5.0, 5.0), (5.0, 5.0)]
    rows = spatial.clusters(frame(spark, points), "k", 5.0).collect()
    got = {r["k"]: r["cluster_id"] for r in rows}
    want = union_find(points, 5.0)
    assert [got[i] for i in range(len(points))] == want
    assert all(r["cluster_size"] == want.count(r["cluster_id"]) for r in rows)


def test_line_of_steps_is_one_cluster_and_twins_count_once_each(spark):
    step = 4 / geo.POLAR_RADIUS_KM * 180 / math.pi
    rows = spatial.clusters(frame(spark, [(10, 10), (10 + step, 10), (10 + 2 * step, 10), (50, 50), (50, 50)]), "k", 5.0).collect()
    assert sorted((r["cluster_id"], r["cluster_size"]) for r in rows) == [(0, 3)] * 3 + [(3, 2)] * 2


def test_long_chain_component(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    labels = spatial.connected_components(edges).collect()
    assert len(labels) == 301 and {r["label"] for r in labels} == {0}


def test_overlap_join_equals_brute_force(spark):
    rng = random.Random(8)

    def make(n, widths):
        out = []
        for i in range(n):
            x, y, t = rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(0, 50)
            w = rng.choice(widths)
            out.append((i, x, x + w, y, y + rng.choice(widths), t, t + rng.choice([0.0, 1.0, 40.0])))
        return out

    left, right = make(60, [0.0, 0.01, 0.5]), make(60, [0.02, 1.0, 9.0])
    schema = "k int, minx double, maxx double, miny double, maxy double, mint double, maxt double"
    axes = [boxes.LON, boxes.LAT, boxes.Axis("mint", "maxt", 1.0)]
    pairs = boxes.overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), axes).select("l.k", "r.k").collect()
    want = sorted((a[0], b[0]) for a in left for b in right if all(a[i] <= b[i + 1] and a[i + 1] >= b[i] for i in (1, 3, 5)))
    assert sorted(tuple(p) for p in pairs) == want


CONCAVE = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
HOLE = [(0.5, 0.2), (1.0, 0.2), (1.0, 0.5), (0.5, 0.5)]


def test_strictly_inside_concave_ring_with_hole_and_edges(spark):
    def ring(points):
        return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points])

    cases = {(1.0, 1.0): True, (2.0, 2.0): False, (3.5, 2.0): True, (0.7, 0.3): False, (4.0, 2.0): False, (0.0, 0.0): False, (1.0, 0.0): False, (5.0, 1.0): False}
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(cases)], "i int, lon double, lat double")
    rows = df.select("i", geo.strictly_inside(F.col("lon"), F.col("lat"), F.array(ring(CONCAVE), ring(HOLE))).alias("inside")).collect()
    assert [r["inside"] for r in sorted(rows)] == list(cases.values())


def test_two_part_species_counts_once(spark):
    square = "array(array(struct(%s as lon, 0D as lat), struct(%s as lon, 0D as lat), struct(%s as lon, 2D as lat), struct(%s as lon, 2D as lat)))"
    parts = spark.range(2).selectExpr("7 as species_idx", f"if(id = 0, {square % ('0D', '2D', '2D', '0D')}, {square % ('1D', '3D', '3D', '1D')}) as rings")
    points = spark.createDataFrame([(1, 1.5, 1.0), (2, 9.0, 9.0)], "k int, lon double, lat double")
    assert [tuple(r) for r in ranges.inside_pairs(points, parts, "k", "species_idx").collect()] == [(1, 7)]


def test_grid_and_random_chips(spark):
    box = spark.createDataFrame([(1, 0.0, 10.0, 0.0, 10.0)], "t int, minx double, maxx double, miny double, maxy double")
    assert boxes.grid_chips(box, 4, 3).count() == 9
    tiles = spark.createDataFrame([(i, i * 20.0, i * 20.0 + 10, 0.0, 10.0) for i in range(5)], "t int, minx double, maxx double, miny double, maxy double")
    draws = spark.range(200).withColumnRenamed("id", "draw")
    chips = boxes.random_chips(tiles, "t", 2.0, draws, seed=1).collect()
    assert len(chips) == 200 and {c["t"] for c in chips} == set(range(5))
    assert all(c["t"] * 20 <= c["minx"] and c["maxx"] <= c["t"] * 20 + 10 and c["maxx"] - c["minx"] == pytest.approx(2) for c in chips)
    assert sorted(chips) == sorted(boxes.random_chips(tiles.repartition(7), "t", 2.0, draws, seed=1).collect())


def test_invalid_boxes(spark):
    box = spark.createDataFrame([(1, 5.0, 1.0)], "t int, minx double, maxx double")
    assert boxes.invalid(box, [boxes.Axis("minx", "maxx")]).count() == 1
    with pytest.raises(Exception, match="invalid box"):
        boxes.validated(box, [boxes.Axis("minx", "maxx")]).collect()


def test_missing_ends_are_open(spark):
    schema = "k int, mint double, maxt double"
    left = spark.createDataFrame([(1, None, None), (2, 5.0, None)], schema)
    right = spark.createDataFrame([(7, 1.0, 2.0), (8, 9.0, 9.0)], schema)
    pairs = boxes.overlap_join(left, right, [boxes.Axis("mint", "maxt", 1.0)]).select("l.k", "r.k").collect()
    assert sorted(tuple(p) for p in pairs) == [(1, 7), (1, 8), (2, 8)]


@pytest.mark.parametrize("metres", [0.5, 3, 20])
def test_short_distances_equal_union_find(spark, metres):
    """Crowds of points a few metres apart: no distance is refused, no cluster lost or joined."""
    rng = random.Random(int(metres * 10))
    spread = metres * 12 / 111_195
    points = [(40.0 + rng.uniform(0, spread), -90.0 + rng.uniform(0, spread)) for _ in range(250)] + [(40.5 + rng.uniform(0, spread) / 30, -90.0) for _ in range(150)]
    top = list(range(len(points)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if km(points[i], points[j]) <= limit:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(points))]


@pytest.mark.parametrize("leaf", [64, 1])
def test_clusters_equal_union_find(spark, monkeypatch, leaf):
    monkeypatch.setattr(spatial, "LEAF", leaf)
    points = crowd(3, 70, 0.15) + [(40.0 + 0.03 * i, -80.0) for i in range(12)] + [(0.0, 179.99), (0.0, -179.99), (89.99, 0.0), (89.99, 180.0), (5.0, 5.0), (5.0, 5.0)]
    rows = spatial.clusters(frame(spark, points), "k", 5.0).collect()
    got = {r["k"]: r["cluster_id"] for r in rows}
    want = union_find(points, 5.0)
    assert [got[i] for i in range(len(points))] == want
    assert all(r["cluster_size"] == want.count(r["cluster_id"]) for r in rows)


def test_line_of_steps_is_one_cluster_and_twins_count_once_each(spark):
    step = 4 / geo.POLAR_RADIUS_KM * 180 / math.pi
    rows = spatial.clusters(frame(spark, [(10, 10), (10 + step, 10), (10 + 2 * step, 10), (50, 50), (50, 50)]), "k", 5.0).collect()
    assert sorted((r["cluster_id"], r["cluster_size"]) for r in rows) == [(0, 3)] * 3 + [(3, 2)] * 2


def test_long_chain_component(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    labels = spatial.connected_components(edges).collect()
    assert len(labels) == 301 and {r["label"] for r in labels} == {0}


def test_overlap_join_equals_brute_force(spark):
    rng = random.Random(8)

    def make(n, widths):
        out = []
        for i in range(n):
            x, y, t = rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(0, 50)
            w = rng.choice(widths)
            out.append((i, x, x + w, y, y + rng.choice(widths), t, t + rng.choice([0.0, 1.0, 40.0])))
        return out

    left, right = make(60, [0.0, 0.01, 0.5]), make(60, [0.02, 1.0, 9.0])
    schema = "k int, minx double, maxx double, miny double, maxy double, mint double, maxt double"
    axes = [boxes.LON, boxes.LAT, boxes.Axis("mint", "maxt", 1.0)]
    pairs = boxes.overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), axes).select("l.k", "r.k").collect()
    want = sorted((a[0], b[0]) for a in left for b in right if all(a[i] <= b[i + 1] and a[i + 1] >= b[i] for i in (1, 3, 5)))
    assert sorted(tuple(p) for p in pairs) == want


CONCAVE = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
HOLE = [(0.5, 0.2), (1.0, 0.2), (1.0, 0.5), (0.5, 0.5)]


def test_strictly_inside_concave_ring_with_hole_and_edges(spark):
    def ring(points):
        return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points])

    cases = {(1.0, 1.0): True, (2.0, 2.0): False, (3.5, 2.0): True, (0.7, 0.3): False, (4.0, 2.0): False, (0.0, 0.0): False, (1.0, 0.0): False, (5.0, 1.0): False}
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(cases)], "i int, lon double, lat double")
    rows = df.select("i", geo.strictly_inside(F.col("lon"), F.col("lat"), F.array(ring(CONCAVE), ring(HOLE))).alias("inside")).collect()
    assert [r["inside"] for r in sorted(rows)] == list(cases.values())


def test_two_part_species_counts_once(spark):
    square = "array(array(struct(%s as lon, 0D as lat), struct(%s as lon, 0D as lat), struct(%s as lon, 2D as lat), struct(%s as lon, 2D as lat)))"
    parts = spark.range(2).selectExpr("7 as species_idx", f"if(id = 0, {square % ('0D', '2D', '2D', '0D')}, {square % ('1D', '3D', '3D', '1D')}) as rings")
    points = spark.createDataFrame([(1, 1.5, 1.0), (2, 9.0, 9.0)], "k int, lon double, lat double")
    assert [tuple(r) for r in ranges.inside_pairs(points, parts, "k", "species_idx").collect()] == [(1, 7)]


def test_grid_and_random_chips(spark):
    box = spark.createDataFrame([(1, 0.0, 10.0, 0.0, 10.0)], "t int, minx double, maxx double, miny double, maxy double")
    assert boxes.grid_chips(box, 4, 3).count() == 9
    tiles = spark.createDataFrame([(i, i * 20.0, i * 20.0 + 10, 0.0, 10.0) for i in range(5)], "t int, minx double, maxx double, miny double, maxy double")
    draws = spark.range(200).withColumnRenamed("id", "draw")
    chips = boxes.random_chips(tiles, "t", 2.0, draws, seed=1).collect()
    assert len(chips) == 200 and {c["t"] for c in chips} == set(range(5))
    assert all(c["t"] * 20 <= c["minx"] and c["maxx"] <= c["t"] * 20 + 10 and c["maxx"] - c["minx"] == pytest.approx(2) for c in chips)
    assert sorted(chips) == sorted(boxes.random_chips(tiles.repartition(7), "t", 2.0, draws, seed=1).collect())


def test_invalid_boxes(spark):
    box = spark.createDataFrame([(1, 5.0, 1.0)], "t int, minx double, maxx double")
    assert boxes.invalid(box, [boxes.Axis("minx", "maxx")]).count() == 1
    with pytest.raises(Exception, match="invalid box"):
        boxes.validated(box, [boxes.Axis("minx", "maxx")]).collect()


def test_missing_ends_are_open(spark):
    schema = "k int, mint double, maxt double"
    left = spark.createDataFrame([(1, None, None), (2, 5.0, None)], schema)
    right = spark.createDataFrame([(7, 1.0, 2.0), (8, 9.0, 9.0)], schema)
    pairs = boxes.overlap_join(left, right, [boxes.Axis("mint", "maxt", 1.0)]).select("l.k", "r.k").collect()
    assert sorted(tuple(p) for p in pairs) == [(1, 7), (1, 8), (2, 8)]


@pytest.mark.parametrize("metres", [0.5, 3, 20])
def test_short_distances_equal_union_find(spark, metres):
    """Crowds of points a few metres apart: no distance is refused, no cluster lost or joined."""
    rng = random.Random(int(metres * 10))
    spread = metres * 12 / 111_195
    points = [(40.0 + rng.uniform(0, spread), -90.0 + rng.uniform(0, spread)) for _ in range(250)] + [(40.5 + rng.uniform(0, spread) / 30, -90.0) for _ in range(150)]
    top = list(range(len(points)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    radius = 6356.7523

    def km(a, b):
        (p, o), (q, u) = [tuple(map(math.radians, v)) for v in (a, b)]
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((u - o) / 2) ** 2
        return 2 * radius * math.asin(math.sqrt(min(1.0, h)))

    for i in range(len(points)):
        for j in range(i):
            if km(points[i], points[j]) <= metres / 1000:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    got = {r["k"]: r["cluster_id"] for r in spatial.clusters(frame(spark, points), "k", metres / 1000).collect()}
    assert got == {i: find(i) for i in range(len(points))}


@pytest.mark.parametrize("metres", [20, 50, 100])
def test_crowded_cubes_at_short_distances_lose_no_edge(spark, metres):
    """600 points in a row, 0.4 m apart, hold hundreds of points in one cube and must stay one cluster."""
    points = [(40.0 + i * 0.4 / 111_195, -90.0) for i in range(600)]
    got = spatial.clusters(frame(spark, points), "k", metres / 1000).collect()
    assert {r["cluster_id"] for r in got} == {0} and {r["cluster_size"] for r in got} == {600}


def test_points_without_coordinates_stay_and_meet_nothing(spark):
    df = spark.createDataFrame([(1, 40.0, -90.0), (2, None, None), (3, 40.0, -90.0), (4, 41.0, None)], "k bigint, lat double, lon double")
    assert {r["k"]: (r["cluster_id"], r["cluster_size"]) for r in spatial.clusters(df, "k", 1.0).collect()} == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}
    wide = spark.createDataFrame([(i, -91.0, -89.0, 39.0, 42.0) for i in range(50)], "b bigint, minx double, maxx double, miny double, maxy double")
    pairs = boxes.overlap_join(boxes.as_point_boxes(df), wide.union(spark.createDataFrame([(99, None, -89.0, 39.0, 42.0)], wide.schema)), [boxes.LON, boxes.LAT])
    assert {(r["l"]["k"], r["r"]["b"]) for r in pairs.collect()} == {(k, b) for k in (1, 3) for b in range(50)}


def _odd_boxes(rows):
    """Boxes that share places: twins, missing ends, empty spans."""
    return [(k, float(k % 3), float(k % 3) + 0.7, None if k % 11 == 0 else float(k % 5), None if k % 13 == 0 else float(k % 5) + (-1.0 if k % 7 == 0 else 2.0))
            for k in range(rows)]


def test_shared_boxes_give_the_pairs_of_the_plain_join_and_are_compared_once(spark, monkeypatch):
    from fieldmark.operators import cells
    schema = "k int, minx double, maxx double, mint double, maxt double"
    axes = [boxes.Axis("minx", "maxx", open_ends=False), boxes.Axis("mint", "maxt", 1.0)]
    left = spark.createDataFrame(_odd_boxes(200) + _odd_boxes(3) + [(None, None, 1.0, 0.0, 1.0)], schema)
    right = spark.createDataFrame(_odd_boxes(40), schema)
    compared, plain = [], cells.join
    monkeypatch.setattr(cells, "join", lambda a, b, keys, spread: (compared.append((a.count(), b.count())), plain(a, b, keys, spread))[1])
    want = sorted(boxes.overlap_join(left, right, axes).select("l.k", "r.k").collect())
    got = sorted(boxes.shared_overlap_join(left, right, axes).select("l.k", "r.k").collect())
    assert got == want and want
    placed = {r[1:] for r in left.collect() if r.minx is not None}
    assert compared[1][1] < compared[0][0] / 2 and len(placed) < 100


def test_spans_of_a_key_cover_the_same_time(spark):
    rows = [("a", 1.0, 3.0), ("a", 3.0, 4.0), ("a", 2.0, 2.5), ("a", 6.0, 5.0), ("a", 7.0, 8.0), ("a", 7.0, 8.0), ("b", None, 1.0), ("b", 0.0, 2.0), (None, 5.0, None)]
    got = boxes.merged_spans(spark.createDataFrame(rows, "k string, mint double, maxt double"), ["k"], boxes.Axis("mint", "maxt", 1.0)).collect()
    assert {tuple(r) for r in got} == {("a", 1.0, 4.0), ("a", 7.0, 8.0), ("b", -1e15, 2.0), (None, 5.0, 1e15)} and len(got) == 4


def test_the_clearest_scene_of_a_footprint_stands_for_it(spark):
    from fieldmark.operators import scenes
    areas = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0), (2, 5.0, 6.0, 0.0, 1.0)], "site_key int, minx double, maxx double, miny double, maxy double")
    rows = [(k, 0.5 + 5 * (k % 2), 0.9 + 5 * (k % 2), 0.0, 1.0, "2020-06-01", float(k // 4)) for k in range(12)]
    catalogue = spark.createDataFrame(rows, "scene_id int, minx double, maxx double, miny double, maxy double, acquired string, cloud double").withColumn(
        "acquired", F.col("acquired").cast("date"))
    asked = ("2020-01-01", "2020-12-31", 2.0)
    all_pairs, best = (scenes.search(areas, catalogue, *asked, clearest=c) for c in (False, True))
    assert all_pairs.count() == 8 and best.count() == 2
    assert sorted(scenes.least_cloudy(best, "site_key").collect()) == sorted(scenes.least_cloudy(all_pairs, "site_key").collect()) == [(1, 0, 0.0), (2, 1, 0.0)]
