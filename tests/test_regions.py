"""Polygons cut into cells against the even-odd test over whole rings."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.operators import boxes, cells, ranges, regions


def _inside(x, y, rings):
    odd = edge = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y):
                odd ^= x < (bx - ax) * (y - ay) / (by - ay) + ax
            edge |= (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by)
    return odd and not edge


def _star(draw, n, x, y, size, snap=None):
    points = []
    for k in range(n):
        r = size * draw.uniform(0.2, 1)
        p = (x + r * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n))
        points.append(tuple(round(v / snap) * snap for v in p) if snap else p)
    return points


def _answers(points, found):
    """Answers from the cells, one for each point."""
    by_cell = {c[:3]: c for c in found}
    levels = {c[0] for c in found}
    out = []
    for x, y in points:
        hits = []
        for level in levels:
            size = 2.0 ** level
            cell = by_cell.get((level, math.floor(x / size), math.floor(y / size)))
            if cell:
                _, _, _, edges, turns, odd = cell
                inside = (odd + regions._crossings(edges, x, y) + int((turns <= y).sum())) % 2 == 1
                on = any((bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by) for ax, ay, bx, by in edges)
                hits.append(inside and not on)
        assert len(hits) <= 1  # cells of one polygon don't overlap
        out.append(any(hits))
    return out


@pytest.mark.parametrize("snap", [None, 0.5, 0.125])
def test_cells_give_the_answers_of_whole_rings(snap):
    draw = random.Random(11)
    for k in range(25):
        x, y, size = draw.uniform(-150, 150), draw.uniform(-60, 60), draw.choice([0.3, 4.0, 30.0])
        rings = [_star(draw, draw.randint(3, 120), x, y, size, snap)]
        if k % 3 == 0:
            rings.append(_star(draw, 7, x, y, size * 0.15, snap))
        if k % 5 == 0:
            rings.append(rings[0][:1] * 2 + rings[0][1:2])  # a ring without an area
        found = regions.cut_rings(rings, coarsest=1.0, most=6)
        points = [(x + draw.uniform(-1.1, 1.1) * size, y + draw.uniform(-1.1, 1.1) * size) for _ in range(150)]
        points += [p for r in rings for p in r] + [(round(a * 8) / 8, round(b * 8) / 8) for a, b in points]
        points += [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(rings[0], rings[0][1:])]
        assert _answers(points, found) == [_inside(a, b, rings) for a, b in points]


def test_no_cell_holds_a_long_ring_and_wide_polygons_have_many_cells():
    ring = _star(random.Random(2), 5000, 10.0, 20.0, 40.0)
    found = regions.cut_rings([ring])
    assert max(len(c[3]) for c in found) <= regions.MOST_EDGES
    circle = [(10 + 20 * math.cos(2 * math.pi * k / 5000), 20 + 20 * math.sin(2 * math.pi * k / 5000)) for k in range(5000)]
    found = regions.cut_rings([circle])
    inner = [c for c in found if not len(c[3])]
    assert len(inner) > 1000  # of 1256 square degrees
    assert max(len(c[3]) for c in found) <= regions.MOST_EDGES and all(2.0 ** c[0] <= regions.COARSEST for c in found)


def test_pairs_on_both_join_paths(spark, monkeypatch):
    draw = random.Random(4)
    shapes = [(k, [_star(draw, 60, draw.uniform(-20, 20), draw.uniform(-20, 20), draw.choice([0.5, 15.0]))]) for k in range(12)]
    shapes += [(3, shapes[0][1]), (98, None), (99, [])]
    points = [(i, draw.uniform(-30, 30), draw.uniform(-30, 30)) for i in range(400)] + [(1000 + i, 0.001 * i, 0.002) for i in range(300)]
    points += [(5000, None, 1.0), (5001, float("nan"), 1.0)]
    want = {(i, k) for i, x, y in points if x is not None and not math.isnan(x) for k, rings in shapes if rings and _inside(x, y, rings)}
    polygons = spark.createDataFrame([(k, None if r is None else [[{"lon": a, "lat": b} for a, b in ring] for ring in r]) for k, r in shapes],
                                     "k int, rings array<array<struct<lon:double,lat:double>>>")
    df = spark.createDataFrame(points, "i int, lon double, lat double")
    assert {tuple(r) for r in ranges.inside_pairs(df, polygons, "i", "k").collect()} == want
    monkeypatch.setattr(cells, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(cells.join, "__defaults__", (50,))  # crowds of 50 points
    assert {tuple(r) for r in ranges.inside_pairs(df, polygons, "i", "k").collect()} == want


def test_crowded_cells_are_dealt_out(spark):
    left = spark.range(30_000).select(F.lit(1).alias("c"), F.col("id")).union(spark.range(10).select((F.col("id") + 2).cast("int"), F.col("id")))
    right = spark.createDataFrame([(1, "a"), (1, "b"), (5, "c")], "c int, name string")
    crowds = cells.crowded(left, ["c"], 1000).collect()
    assert [(r["_k0"], r["_parts"]) for r in crowds] == [(1, 30)]
    joined = cells.join(left, right, ["c"], F.xxhash64("id"), 1000)
    assert joined.count() == 60_001 and joined.select("id", "name").distinct().count() == 60_001


def test_overlap_of_a_crowd(spark):
    points = boxes.as_point_boxes(spark.range(5000).select(F.col("id").alias("k"), F.lit(0.5).alias("lon"), F.lit(0.5).alias("lat")))
    wide = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0), (2, 0.4, 9.0, 0.4, 0.6), (3, 2.0, 3.0, 0.0, 1.0)], "b int, minx double, maxx double, miny double, maxy double")
    got = boxes.overlap_join(points, wide, [boxes.LON, boxes.LAT])
    assert {r["b"]: r["count"] for r in got.groupBy("r.b").count().collect()} == {1: 5000, 2: 5000}


def test_quartering_stops_where_many_edges_meet():
    fan = [p for k in range(60) for p in ((0.0, 0.0), (math.cos(k / 10), math.sin(k / 10)))]
    found = regions.cut_rings([fan], most=4)
    assert len(found) < 40 * len(fan) and np.isfinite([c[0] for c in found]).all()
    doubled = [(k % 2 * 0.7, 0.001 * (k % 2)) for k in range(200)]  # 200 edges on one line
    assert len(regions.cut_rings([doubled])) < 40 * len(doubled)
