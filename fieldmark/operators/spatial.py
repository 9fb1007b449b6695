"""Nearest neighbours, distance clusters and medoids on the sphere.

Points become unit vectors and are binned into cubes, so neither the poles nor the date line need special care and a
straight-line bound on a cube bounds the great-circle distance. Crowded cubes are split further instead of being
paired point by point, which keeps the work near-linear wherever points pile up.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions import geo
from fieldmark.session import materialize

SPLIT = 4          # a cube is split into SPLIT**3 smaller ones
LEAF = 64          # candidates per cube that are compared one by one
_RANGE = 1 << 20   # cubes per axis that fit in one number; finer ones are known by three
_FINEST = 1e-15    # coordinates don't tell places in smaller cubes apart


def chord(km: float, radius: float = geo.POLAR_RADIUS_KM) -> float:
    """Straight-line distance on the unit sphere of a great-circle distance."""
    return 2 * math.sin(min(km / radius, math.pi) / 2)


def coordinates(df: DataFrame, key: str) -> DataFrame:
    """Distinct coordinates with their smallest key, the number of rows and the unit vector."""
    nodes = df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy("lat", "lon").agg(
        F.min(key).alias("key"), F.count("*").alias("n"))
    x, y, z = geo.unit_vector(F.col("lat"), F.col("lon"))
    return nodes.withColumns({"x": x, "y": y, "z": z})


def _fits(side: float) -> bool:
    return 1 / side < _RANGE - 2


def _cube(side: float, x: Column, y: Column, z: Column, wide: bool = False) -> Column:
    """Cube of a point: three 21-bit parts in one whole number where they fit, else a struct of three numbers."""
    parts = [F.floor(v / F.lit(side)).cast("bigint") for v in (x, y, z)]
    if wide or not _fits(side):
        return F.struct(*[p.alias(n) for p, n in zip(parts, "ijk")])
    parts = [p + F.lit(_RANGE) for p in parts]
    return (parts[0] * F.lit(2 * _RANGE) + parts[1]) * F.lit(2 * _RANGE) + parts[2]


def _shifted(cube: Column, d: tuple[int, int, int], side: float, wide: bool = False) -> Column:
    if wide or not _fits(side):
        return F.struct(*[(cube[n] + F.lit(v)).alias(n) for n, v in zip("ijk", d)])
    return cube + F.lit((d[0] * 2 * _RANGE + d[1]) * 2 * _RANGE + d[2])


def _bounds() -> list[Column]:
    return [f(F.col(a)).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]


def _gap2(a: dict, b: dict) -> tuple[Column, Column]:
    """Squared least and greatest straight-line distance of two boxes given as {axis: (lo, hi)}."""
    near, far = [], []
    for ax in "xyz":
        (al, ah), (bl, bh) = a[ax], b[ax]
        gap = F.greatest(F.lit(0.0), bl - ah, al - bh)
        reach = F.greatest(bh - al, ah - bl)
        near.append(gap * gap)
        far.append(reach * reach)
    return reduce(lambda s, t: s + t, near), reduce(lambda s, t: s + t, far)


def _box(prefix: str = "") -> dict:
    return {a: (F.col(f"{prefix}lo{a}"), F.col(f"{prefix}hi{a}")) for a in "xyz"}


def _point(prefix: str = "") -> dict:
    return {a: (F.col(f"{prefix}{a}"), F.col(f"{prefix}{a}")) for a in "xyz"}


def _cells(nodes: DataFrame, side: float, level: int, wide: bool = False) -> DataFrame:
    cube = _cube(side / SPLIT ** level, F.col("x"), F.col("y"), F.col("z"), wide)
    parent = _cube(side / SPLIT ** max(level - 1, 0), F.col("x"), F.col("y"), F.col("z"), wide)
    return nodes.groupBy(cube.alias("cube")).agg(F.min(parent).alias("parent"), F.count("*").alias("members"), *_bounds())


# --------------------------------------------------------------------------- nearest

def nearest(points: DataFrame, centres: DataFrame, centre_key: str, max_km: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each point with its nearest centre within ``max_km`` (inclusive): columns ``near_key``, ``near_lat``,
    ``near_lon``, the ``keep`` columns of the centre and ``distance_km``. Points without one are left out.

    Distances equal to the micrometre tie and go to the smaller key. Points with equal coordinates are looked up once.
    """
    reach = chord(max_km) * (1 + 1e-9)
    centre_nodes = coordinates(centres, centre_key)
    queries = points.select("lat", "lon").filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).distinct()
    x, y, z = geo.unit_vector(F.col("lat"), F.col("lon"))
    queries = queries.withColumns({"x": x, "y": y, "z": z})
    near = _candidates(queries, centre_nodes, reach)
    near = near.withColumn("distance_km", geo.haversine_km(F.col("lat"), F.col("lon"), F.col("near_lat"), F.col("near_lon")))
    best = near.filter(F.col("distance_km") <= max_km).groupBy("lat", "lon").agg(
        F.min_by(F.struct("near_key", "near_lat", "near_lon", "distance_km"), F.struct(F.round("distance_km", 9), "near_key")).alias("b"))
    best = best.select("lat", "lon", "b.*")
    if keep:
        extra = centres.select(F.col(centre_key).alias("near_key"), *keep)
        best = best.join(extra, "near_key")
    return points.join(best, ["lat", "lon"])


def _neighbour_cubes(queries: DataFrame, side: float, wide: bool = False) -> DataFrame:
    cube = _cube(side, F.col("x"), F.col("y"), F.col("z"), wide)
    shifts = [_shifted(cube, (i, j, k), side, wide) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    return queries.withColumn("cube", F.explode(F.array(*shifts)))


def _candidates(queries: DataFrame, centres: DataFrame, reach: float) -> DataFrame:
    """(lat, lon, near_key, near_lat, near_lon): a superset of each query's nearest centre within ``reach``."""
    cells = _cells(centres, reach, 0)
    leaf = centres.select("key", F.col("lat").alias("near_lat"), F.col("lon").alias("near_lon"), "x", "y", "z").withColumnRenamed("key", "near_key")
    crowded = cells.agg(F.max("members")).first()[0] or 0
    if crowded <= LEAF:
        keyed = leaf.withColumn("cube", _cube(reach, F.col("x"), F.col("y"), F.col("z"))).drop("x", "y", "z")
        return _neighbour_cubes(queries, reach).join(keyed, "cube")
    # Crowded cubes: keep, per query, the cubes that can hold its nearest centre and split those again.
    cells = _cells(centres, reach, 0, wide=True)
    pairs = _neighbour_cubes(queries, reach, wide=True).join(cells.drop("parent"), "cube").withColumn("level", F.lit(0))
    level = 0
    while True:
        pairs = materialize(_prune(pairs, reach), "nearest")
        if (pairs.agg(F.max("members")).first()[0] or 0) <= LEAF or reach / SPLIT ** (level + 1) < _FINEST:
            break
        level += 1
        finer = _cells(centres, reach, level, wide=True)
        big = pairs.filter(F.col("members") > LEAF).select("lat", "lon", "x", "y", "z", F.col("cube").alias("parent"))
        split = big.join(finer, "parent").withColumn("level", F.lit(level)).select(*pairs.columns)
        pairs = pairs.filter(F.col("members") <= LEAF).unionByName(split)
    levels = F.array(*[F.struct(F.lit(v).alias("level"), _cube(reach / SPLIT ** v, F.col("x"), F.col("y"), F.col("z"), wide=True).alias("cube"))
                       for v in range(level + 1)])
    keyed = leaf.select("near_key", "near_lat", "near_lon", F.inline(levels))
    return pairs.select("lat", "lon", "level", "cube").join(keyed, ["level", "cube"])


def _prune(pairs: DataFrame, reach: float) -> DataFrame:
    near, far = _gap2(_point(), _box())
    bounded = pairs.withColumns({"_near": near, "_far": far}).filter(F.col("_near") <= reach * reach)
    best = bounded.groupBy("lat", "lon").agg(F.min("_far").alias("_best"))
    # rounding of the bounds must not lose a candidate
    return bounded.join(best, ["lat", "lon"]).filter(F.col("_near") <= F.col("_best") * (1 + 1e-9) + 1e-30).select(*pairs.columns)


def nearest_any(points: DataFrame, centres: DataFrame, centre_key: str, first_km: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nearest centre at any distance: the radius grows for the points still without one."""
    done, rest, km = [], points, first_km
    while True:
        found = materialize(nearest(rest, centres, centre_key, km, keep), "nearest-any")
        done.append(found)
        if km >= math.pi * geo.POLAR_RADIUS_KM:
            break
        rest = rest.join(found.select("lat", "lon").distinct(), ["lat", "lon"], "left_anti")
        if rest.isEmpty():
            break
        km = min(km * 8, math.pi * geo.POLAR_RADIUS_KM)
    return reduce(DataFrame.unionByName, done)


# --------------------------------------------------------------------------- clusters

def clusters(points: DataFrame, key: str, km: float) -> DataFrame:
    """Adds ``cluster_id`` (smallest key of the cluster) and ``cluster_size``.

    Two points share a cluster when a chain of steps of at most ``km`` joins them, which is density clustering with
    two points per core. A point without coordinates is a cluster of its own. Cubes with a diagonal below ``km`` are whole nodes of the graph, so a dense place costs one
    node however many points it holds.
    """
    eps = chord(km)
    side = eps / math.sqrt(3) * (1 - 1e-9)
    nodes = materialize(coordinates(points, key).withColumn("cube", _cube(side, F.col("x"), F.col("y"), F.col("z"))), "nodes")
    cells = materialize(nodes.groupBy("cube").agg(F.min("key").alias("key"), F.count("*").alias("members"), F.sum("n").alias("n"), *_bounds()), "cells")
    labels = connected_components(_cell_edges(nodes, cells, eps, side, km))
    named = cells.select("cube", "key", "n").join(labels.withColumnRenamed("node", "cube"), "cube", "left")
    named = named.withColumn("label", F.coalesce("label", "cube"))
    summary = named.groupBy("label").agg(F.min("key").alias("cluster_id"), F.sum("n").alias("cluster_size"))
    by_cube = named.select("cube", "label").join(summary, "label").drop("label")
    by_place = nodes.select("lat", "lon", "cube").join(by_cube, "cube").drop("cube")
    placed = points.join(by_place, ["lat", "lon"], "left").withColumn("cluster_id", F.coalesce("cluster_id", F.col(key)))
    return placed.withColumn("cluster_size", F.coalesce("cluster_size", F.lit(1).cast("bigint")))


def _cell_edges(nodes: DataFrame, cells: DataFrame, eps: float, side: float, km: float) -> DataFrame:
    """Pairs of cubes (a, b) holding two points at most ``km`` apart."""
    half = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    left = cells.select(*[F.col(c).alias(f"a_{c}") for c in cells.columns])
    left = left.withColumn("cube", F.explode(F.array(*[_shifted(F.col("a_cube"), d, side) for d in half])))
    right = cells.select("cube", *[F.col(c).alias(f"b_{c}") for c in cells.columns])
    pairs = left.join(right, "cube").drop("cube")
    near, far = _gap2(_box("a_"), _box("b_"))
    pairs = materialize(pairs.withColumns({"near": near, "far": far}).filter(F.col("near") <= eps * eps * (1 + 1e-9)), "cell-pairs")
    sure = pairs.filter(F.col("far") <= eps * eps * (1 - 1e-9)).select(F.col("a_cube").alias("a"), F.col("b_cube").alias("b"))
    open_ = pairs.filter(F.col("far") > eps * eps * (1 - 1e-9)).select(
        F.col("a_cube").alias("a"), F.col("b_cube").alias("b"), F.col("a_cube").alias("ca"), F.col("b_cube").alias("cb"),
        (F.col("a_members") * F.col("b_members")).alias("work"))
    edges = [sure]
    level = 0
    while True:
        # pairs of small cubes: compare their points
        small = open_.filter(F.col("work") <= LEAF * LEAF)
        keyed = nodes.select(_cube(side / SPLIT ** level, F.col("x"), F.col("y"), F.col("z")).alias("c"), "lat", "lon")
        pa = keyed.select(F.col("c").alias("ca"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
        pb = keyed.select(F.col("c").alias("cb"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
        close = small.join(pa, "ca").join(pb, "cb").filter(
            geo.haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) <= km)
        edges.append(close.select("a", "b"))
        big = open_.filter(F.col("work") > LEAF * LEAF)
        if big.isEmpty() or side / SPLIT ** (level + 1) < _FINEST:
            if not big.isEmpty():
                # coordinates have no finer places: what is left is compared like the small ones
                last = big.join(pa, "ca").join(pb, "cb").filter(
                    geo.haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) <= km)
                edges.append(last.select("a", "b"))
            break
        # crowded pairs: split both cubes, decide by bounds, carry on with what stays open
        level += 1
        finer = _cells(nodes, side, level)
        fa = finer.select(F.col("parent").alias("ca"), *[F.col(c).alias(f"a_{c}") for c in finer.columns])
        fb = finer.select(F.col("parent").alias("cb"), *[F.col(c).alias(f"b_{c}") for c in finer.columns])
        near, far = _gap2(_box("a_"), _box("b_"))
        split = big.select("a", "b", "ca", "cb").join(fa, "ca").join(fb, "cb").withColumns({"near": near, "far": far})
        split = materialize(split.filter(F.col("near") <= eps * eps * (1 + 1e-9)), "cell-split")
        settled = split.filter(F.col("far") <= eps * eps * (1 - 1e-9)).select("a", "b").distinct()
        edges.append(settled)
        open_ = split.join(settled, ["a", "b"], "left_anti").select(
            "a", "b", F.col("a_cube").alias("ca"), F.col("b_cube").alias("cb"), (F.col("a_members") * F.col("b_members")).alias("work"))
        open_ = materialize(open_, "cell-open")
    return reduce(DataFrame.unionByName, edges).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): label = smallest node of the component, for nodes of the undirected ``edges`` (a, b).

    Each round looks up every label's own label, takes the smallest of those around a node, and hands it both to the
    node and to the node it points at, so distances at least halve and the rounds grow with the logarithm of the
    longest chain. A round is aggregates and equi-joins written once to shared storage: lineage stays short and a lost
    executor costs one round at most. Cube graphs have bounded degree, so the edge join has no hot key; the label
    lookups meet unique keys.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = materialize(both, "edges")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label"))
    labels = materialize(labels, "labels")
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        raised = labels.join(up, "label")
        around = (both.join(raised.select(F.col("node").alias("v"), "top"), "v")
                  .groupBy(F.col("u").alias("node")).agg(F.min("top").alias("near")))
        state = raised.join(around, "node").withColumn("best", F.least("top", "near"))
        handed = state.select(F.col("label").alias("node"), "best").unionByName(state.select("node", "best"))
        proposed = handed.groupBy("node").agg(F.min("best").alias("new"))
        new = labels.join(proposed, "node").select("node", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved"))
        written = materialize(new, "labels")
        labels = written.drop("moved")
        if written.filter("moved").isEmpty():
            return labels


def medoids(members: DataFrame, key: str) -> DataFrame:
    """Per cluster the member closest to the plane centroid: (cluster_id, key, lat, lon, cluster_size)."""
    centre = members.groupBy("cluster_id").agg(F.avg("lat").alias("mid_lat"), F.avg("lon").alias("mid_lon"), F.count("*").alias("cluster_size"))
    placed = members.select("cluster_id", key, "lat", "lon").join(centre, "cluster_id")
    dist = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("mid_lat"), F.col("mid_lon"))
    best = placed.groupBy("cluster_id").agg(
        F.min_by(F.struct(key, "lat", "lon"), F.struct(F.round(dist, 9), key)).alias("b"), F.max("cluster_size").alias("cluster_size"))
    return best.select("cluster_id", f"b.{key}", "b.lat", "b.lon", "cluster_size")
