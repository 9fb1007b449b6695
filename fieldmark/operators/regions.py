"""Polygons cut into grid cells, so that a point meets the few edges near it and never a whole ring.

A cell is known by its power-of-two size and its whole-number place. Cutting starts from the cells that cover a polygon and
quarters them until a cell is no larger than ``coarsest`` and crossed by few edges; where many edges lie on one another,
quartering ends at a number of cells in proportion to the edges. A cell without edges lies inside
or outside as a whole; the outer ones are dropped. A cell with edges also holds what the rest of the ring contributes to
the even-odd count of a ray to the right: a constant, turned round at the latitudes where the ring leaves the held edges to the right of
the cell. All of it follows from the cell it was quartered from, and the edge test of a point stays the one of the whole
ring, so answers are the same to the last bit.
"""

from __future__ import annotations

import heapq
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# tasks get the code of their functions with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Largest cell in degrees, most edges of a cell, and the exponent of the smallest cell.
COARSEST, MOST_EDGES, FINEST = 1.0, 16, -20
#: Quarterings for each edge below the largest size; cells may hold more edges only beyond that, where edges lie on one another.
QUARTERINGS = 4
_EDGE = pa.struct([(c, pa.float64()) for c in ("ax", "ay", "bx", "by")])
_CELL = "level int, cx bigint, cy bigint, edges array<struct<ax:double,ay:double,bx:double,by:double>>, turns array<double>, odd boolean"


def _crossings(edges: np.ndarray, x: float, y: float) -> int:
    """Edges that a ray from (x, y) to the right meets."""
    ax, ay, bx, by = edges.T
    spans = (ay > y) != (by > y)
    e = edges[spans]
    return int((x < (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0]).sum())


def _touching(edges: np.ndarray, x0: float, y0: float, size: float) -> np.ndarray:
    """Which edges may touch the closed cell; a hair more than do."""
    margin = 1e-9 * max(1.0, abs(x0), abs(y0), size)
    x0, y0, x1, y1 = x0 - margin, y0 - margin, x0 + size + margin, y0 + size + margin
    ax, ay, bx, by = edges.T
    near = (np.minimum(ax, bx) <= x1) & (np.maximum(ax, bx) >= x0) & (np.minimum(ay, by) <= y1) & (np.maximum(ay, by) >= y0)
    sides = np.stack([(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (x0, x1) for y in (y0, y1)])
    return near & ~((sides > 0).all(axis=0) | (sides < 0).all(axis=0))


def cut_rings(rings: list[list[tuple[float, float]]], coarsest: float = COARSEST, most: int = MOST_EDGES) -> list[tuple]:
    """(level, cx, cy, edges, turns, odd) of the cells of one polygon; its rings close themselves."""
    edges, following, base = [], [], 0
    for ring in rings:
        ring = [p for k, p in enumerate(ring) if p != ring[k - 1] or len(ring) == 1]
        n = len(ring)
        for i in range(n):
            edges.append((*ring[i], *ring[(i + 1) % n]))
            following.append(base + (i + 1) % n)
        base += n
    edges = np.array(edges, dtype=np.float64).reshape(-1, 4)
    if not len(edges) or not np.isfinite(edges).all():
        return []
    following = np.array(following)
    before = np.empty_like(following)
    before[following] = np.arange(len(following))
    low, high = edges[:, :2].min(axis=0), edges[:, :2].max(axis=0)
    level = max(FINEST, math.ceil(math.log2(max(high - low).clip(2.0 ** FINEST))))
    size = 2.0 ** level
    everything = np.arange(len(edges))
    todo = [(level, cx, cy, everything, np.zeros(0), False)
            for cx in range(math.floor(low[0] / size), math.floor(high[0] / size) + 1) for cy in range(math.floor(low[1] / size), math.floor(high[1] / size) + 1)]
    out, crowded, budget = [], [], QUARTERINGS * len(edges)
    while todo or crowded:
        if todo:
            level, cx, cy, held, turns, odd = todo.pop()
        else:
            _, _, (level, cx, cy, held, turns, odd) = heapq.heappop(crowded)
            if budget <= 0 or level <= FINEST:
                out.append((level, cx, cy, edges[held], turns, odd))
                continue
            budget -= 1
        size = 2.0 ** level
        if size <= coarsest and len(held) <= most:  # a polygon that is small to begin with
            if len(held) or odd:
                out.append((level, cx, cy, edges[held], turns, odd))
            continue
        half = size / 2
        for dx in (0, 1):
            for dy in (0, 1):
                x0, y0 = (2 * cx + dx) * half, (2 * cy + dy) * half
                own = held[_touching(edges[held], x0, y0, half)]
                ends = np.concatenate([edges[own[~np.isin(following[own], own)], 2:], edges[own[~np.isin(before[own], own)], :2]])
                right = (ends[:, 0] > x0 + half) & (ends[:, 1] >= y0) & (ends[:, 1] <= y0 + half)
                own_turns = np.sort(ends[right, 1])
                x, y = x0 + half / 2, y0 + half / 2
                inside = (odd + _crossings(edges[held], x, y) + (turns <= y).sum()) % 2 == 1
                own_odd = (inside + _crossings(edges[own], x, y) + (own_turns <= y).sum()) % 2 == 1
                cell = (level - 1, 2 * cx + dx, 2 * cy + dy, own, own_turns, bool(own_odd))
                if half > coarsest:
                    if len(own) or own_odd:
                        todo.append(cell)
                elif len(own) > most:
                    heapq.heappush(crowded, (-len(own), cell[:3], cell))
                elif len(own) or own_odd:
                    out.append((*cell[:3], edges[own], own_turns, cell[5]))
    return out


def cut(polygons: DataFrame, key: str, coarsest: float = COARSEST, most: int = MOST_EDGES) -> DataFrame:
    """(key, level, cx, cy, edges, turns, odd): the cells of every polygon; ``rings`` without a place give none."""
    kind = polygons.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("k")
            for row in range(batch.num_rows):
                rings = batch.column("rings")[row].as_py() or []
                rings = [[(math.nan if p is None or p["lon"] is None else p["lon"], math.nan if p is None or p["lat"] is None else p["lat"]) for p in r or ()] for r in rings]
                cells = cut_rings(rings, coarsest, most)
                for begin in range(0, len(cells), 10_000):
                    yield _batch(keys, row, cells[begin:begin + 10_000])

    return polygons.select(F.col(key).alias("k"), "rings").mapInArrow(run, f"k {kind}, {_CELL}").withColumnRenamed("k", key)


def _batch(keys: pa.Array, row: int, cells: list[tuple]) -> pa.RecordBatch:
    level, cx, cy, edges, turns, odd = zip(*cells)
    flat = np.concatenate(edges)
    edge = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], fields=list(_EDGE))
    edge_lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, edges)]).astype(np.int32)), edge)
    turn_lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, turns)]).astype(np.int32)), pa.array(np.concatenate(turns)))
    columns = [keys.take(pa.array([row] * len(cells))), pa.array(level, pa.int32()), pa.array(cx, pa.int64()), pa.array(cy, pa.int64()), edge_lists, turn_lists, pa.array(odd)]
    return pa.RecordBatch.from_arrays(columns, ["k", "level", "cx", "cy", "edges", "turns", "odd"])


def inside_cell(lon: Column, lat: Column, edges: Column, turns: Column, odd: Column) -> Column:
    """Even-odd test of a point against the cell it falls in; points on an edge are outside."""

    def step(state: Column, e: Column) -> Column:
        ax, ay, bx, by = e["ax"], e["ay"], e["bx"], e["by"]
        spans = (ay > lat) != (by > lat)
        cross = F.when(spans, lon < (bx - ax) * (lat - ay) / F.when(spans, by - ay).otherwise(1.0) + ax).otherwise(False)
        on_edge = (((bx - ax) * (lat - ay) == (by - ay) * (lon - ax))
                   & lon.between(F.least(ax, bx), F.greatest(ax, bx)) & lat.between(F.least(ay, by), F.greatest(ay, by)))
        return F.struct((state["odd"] != cross).alias("odd"), (state["edge"] | on_edge).alias("edge"))

    turned = F.size(F.filter(turns, lambda t: t <= lat)) % 2 == 1
    start = F.struct((odd != turned).alias("odd"), F.lit(False).alias("edge"))
    return F.when(F.size(edges) == 0, odd).otherwise(F.aggregate(edges, start, step, lambda s: s["odd"] & ~s["edge"]))
