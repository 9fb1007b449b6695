"""Decision trees for all species (and seeds, or bootstrap draws) at once, grown level by level on shared histograms.

Features are cut into bins once. For each level, one job adds up the weights and gradients of the rows by model, node,
feature and bin: tasks ship the cells that they meet, one set for each block of models, and a second stage adds up the blocks and
picks the split of each open node. Only splits reach the driver, which holds the trees; rows never leave their partition.
Boosting and forests differ in their row weights, gradients and the features that a node may use.

The trees of a forest don't need each other and grow as large as the rows allow, so no process holds them all. Where the rows fit a task
as bytes, tasks grow whole trees of one species, add up their votes and forget them. Where they don't, a few trees at a time grow level by
level and vote.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.session import materialize, scratch_path

# tasks get the code of their functions with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bins of a feature; features with fewer values keep each value apart.
BINS = 128
#: Models that share one row of histogram cells, and models grown by one job: the cells of a task stay bounded.
BLOCK, GROUP = 8, 4096
#: Rows times models that a task looks at in one go.
CHUNK = 4_000_000
#: Rows times models that walk down their trees together, few enough for a processor's cache.
STRIDE = 1 << 16
#: Rows times models times features that a task adds up at least where cores are idle, and at most.
LEAST_WORK, MOST_WORK = 2_000_000, 64_000_000
#: Boosting rounds between two writes of the predictions so far.
REFRESH = 4
#: Bytes of rows, as bins and bits, with which a task grows whole trees; rows times trees that grow side by side there.
HELD_BYTES, TOGETHER = 64 << 20, 1 << 18
#: Nodes of the trees that grow level by level at a time where the rows are more.
NODES = 4 << 20
#: Base-two logarithm of the rows whose votes travel together.
PART = 11
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poisson_weights(keys: np.ndarray, trees: np.ndarray, seed: int) -> np.ndarray:
    """(rows x trees): how often a bootstrap draw holds a row, Poisson with mean one; the same wherever the row stands."""
    with np.errstate(over="ignore"):
        h = mixed(keys.view(np.uint64)[:, None] + (trees.astype(np.uint64) + np.uint64(1)) * _ODD + np.uint64(seed))
    u = (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    steps = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])
    return np.searchsorted(steps, u).astype(np.float64)


@dataclass
class Trees:
    """Trees of several models: feature (-1 in a leaf), largest bin that goes left, left child (the right one follows), value."""

    models: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    child: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)
    size: np.ndarray = field(init=False)

    def __post_init__(self):
        self.feature = np.full((self.models, 1), -1, dtype=np.int16)
        self.cut = np.zeros((self.models, 1), dtype=np.int16)
        self.child = np.zeros((self.models, 1), dtype=np.int32)
        self.value = np.zeros((self.models, 1))
        self.size = np.ones(self.models, dtype=np.int64)

    def split(self, model: np.ndarray, node: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Make nodes, ascending by model, inner nodes; returns their left children."""
        count = np.bincount(model, minlength=self.models)
        at = self.size[model] + 2 * (np.arange(len(model)) - (np.cumsum(count) - count)[model])
        wide, needed = self.feature.shape[1], int((self.size + 2 * count).max(initial=1))
        if needed > wide:
            more = max(8, wide, needed - wide)
            self.feature = np.pad(self.feature, ((0, 0), (0, more)), constant_values=-1)
            self.cut, self.child, self.value = (np.pad(a, ((0, 0), (0, more))) for a in (self.cut, self.child, self.value))
        self.feature[model, node], self.cut[model, node], self.child[model, node] = feature, cut, at
        self.value[model, at], self.value[model, at + 1] = left, right
        self.size += 2 * count
        return at

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.feature, self.cut, self.child, self.value


def walked(trees: tuple[np.ndarray, ...], bins: np.ndarray, row: np.ndarray, model: np.ndarray) -> np.ndarray:
    """The node that each pair of a row and a model has come to; only pairs at inner nodes take the next step."""
    feature, cut, child, _ = (a.reshape(-1) for a in trees)
    size, flat = trees[0].shape[1], np.ascontiguousarray(bins).reshape(-1)
    out = np.zeros(len(row), dtype=np.int32)
    for begin in range(0, len(row), STRIDE):
        node = out[begin:begin + STRIDE]
        first, place = model[begin:begin + STRIDE].astype(np.int64) * size, row[begin:begin + STRIDE] * bins.shape[1]
        moving, at = np.arange(len(node)), first
        while True:
            asked = feature[at]
            inner = asked >= 0
            if not inner.all():
                moving, at, asked, place, first = (a[inner] for a in (moving, at, asked, place, first))
            if not len(moving):
                break
            following = child[at] + (flat[place + asked] > cut[at])
            node[moving] = following
            at = first + following
    return out


def leaves(trees: tuple[np.ndarray, ...], bins: np.ndarray, models: np.ndarray) -> np.ndarray:
    """(rows x models): the node that each row has come to."""
    row, model = np.repeat(np.arange(len(bins)), len(models)), np.tile(models, len(bins))
    return walked(trees, bins, row, model).reshape(len(bins), len(models))


def predict(trees: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """(rows x models): the value of the leaf of each row."""
    models = np.arange(len(trees[0]))
    return trees[3][models, leaves(trees, bins, models)]


@dataclass(frozen=True)
class Rule:
    """How nodes split: penalty on leaf values, least gain and weight of a child, features tried at a time (None: all), depth."""

    depth: int
    penalty: float = 0.0
    least_weight: float = 1.0
    tried: int | None = None


def cut_points(rows: DataFrame, features: str, count: int, bins: int = BINS) -> list[np.ndarray]:
    """Ascending cuts of each feature, half way between neighbouring quantiles; ``bins`` - 1 at most for each."""
    shares = F.array(*[F.lit(k / (bins - 1)) for k in range(bins)])
    each = rows.select(F.posexplode(features).alias("feature", "v")).filter(F.col("v").isNotNull() & (F.col("feature") < count))
    quantiles = each.groupBy("feature").agg(F.percentile_approx("v", shares, F.lit(20 * bins)).alias("q")).collect()  # one row a feature
    cuts = [np.zeros(0) for _ in range(count)]
    for r in quantiles:
        q = np.unique(np.asarray(r["q"], dtype=np.float64))
        cuts[r["feature"]] = (q[1:] + q[:-1]) / 2
    return cuts


def binned(rows: DataFrame, features: str, vector: str, key: str, cuts: Sequence[np.ndarray]) -> DataFrame:
    """The columns of ``rows`` and ``_row`` (a number made from the key), ``_bins`` (a byte for each feature), ``_y``."""
    known = rows.withColumns({"_row": F.xxhash64(key), "_x": F.col(features).cast("array<double>"), "_y": F.col(vector).cast("array<double>")})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("_x"), len(cuts))
            # NaN, which stands for null here, sorts above all cuts
            codes = np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)]).astype(np.uint8)
            codes = np.ascontiguousarray(codes)
            offsets = np.arange(len(codes) + 1, dtype=np.int32) * len(cuts)
            column = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(offsets), pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), column], [*kept, "_bins"])

    kept = [c for c in known.columns if c != "_x"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema if f.name != "_x") + ", _bins binary"
    return known.mapInArrow(place, schema)


def dealt(rows: DataFrame, models: int, tried: int) -> DataFrame:
    """``rows`` over as many tasks as adding them up for all models is worth, whatever their bytes."""
    work = rows.count() * models * tried
    idle = min(rows.sparkSession.sparkContext.defaultParallelism, work // LEAST_WORK)
    return rows.repartition(max(1, idle, -(-work // MOST_WORK)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` numbers, null as NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), width) if len(column) else np.zeros((0, width))


def _codes(column: pa.Array, width: int) -> np.ndarray:
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, dtype=np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(data, dtype=np.uint8)[first:first + len(column) * width].reshape(len(column), width) if len(column) else np.zeros((0, width), np.uint8)


def _summed(cell: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct cells, sums of each value)."""
    if not len(cell):
        return (cell, *values)
    span = int(cell.max()) + 1
    if span <= 4 * len(cell):
        sums = [np.bincount(cell, v, span) for v in values]
        some = np.flatnonzero(np.bincount(cell, minlength=span))
        return (some, *[s[some] for s in sums])
    distinct, place = np.unique(cell, return_inverse=True)
    return (distinct, *[np.bincount(place, v, len(distinct)) for v in values])


_CELLS = "block int, cell binary, w binary, g binary"
_SPLITS = "slot bigint, w double, g double, feature int, cut int, wl double, gl double"


@dataclass(frozen=True)
class Open:
    """Open nodes, ascending by model; a slot is the place of a node in these arrays. Draws go by the model's number plus ``first``."""

    model: np.ndarray
    node: np.ndarray
    depth: np.ndarray
    attempt: np.ndarray
    first: int = 0

    def block(self, block: int) -> slice:
        return slice(*np.searchsorted(self.model, (block * BLOCK, (block + 1) * BLOCK)))

    def tried(self, where: slice, rule: Rule, width: int, seeds: np.ndarray) -> np.ndarray:
        return _tried(self.model[where] + self.first, self.node[where], self.attempt[where], rule, width, seeds)


def _partial(batches: Iterator[pa.RecordBatch], gradients: Callable, trees: tuple[np.ndarray, ...], opened: Open, models: np.ndarray,
             rule: Rule, seeds: np.ndarray, bins: int, width: int) -> Iterator[pa.RecordBatch]:
    """Sums over the rows of a batch for each (slot, feature tried, bin), one row for each block of models."""
    slots = np.full(trees[0].shape, -1, dtype=np.int32)
    slots[opened.model, opened.node] = np.arange(len(opened.model))
    blocks = np.unique(opened.model // BLOCK)
    step = max(1, CHUNK // max(1, len(models)))
    for batch in batches:
        for begin in range(0, batch.num_rows, step):
            piece = batch.slice(begin, step)
            codes = _codes(piece.column("_bins"), width)
            w, g = gradients(piece, codes, models)
            column, row = np.nonzero(w.T > 0)  # ascending by model
            slot = slots[models[column], walked(trees, codes, row, models[column])]
            still = slot >= 0
            slot, column, row = slot[still], column[still], row[still]
            w, g = w[row, column], g[row, column]
            edges = np.searchsorted(models[column], np.r_[blocks, blocks[-1:] + 1] * BLOCK)
            out = []
            for number, (low, high) in zip(blocks, zip(edges[:-1], np.r_[edges[1:-1], len(column)])):
                if low < high:
                    where = opened.block(number)
                    tried = opened.tried(where, rule, width, seeds)
                    out.append((number, *_cells(slot[low:high] - where.start, row[low:high], w[low:high], g[low:high], codes, tried, bins)))
            if out:
                number, *columns = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number, pa.int32()), *[pa.array([v.tobytes() for v in c], pa.binary()) for c in columns]], ["block", "cell", "w", "g"])


def _cells(slot: np.ndarray, row: np.ndarray, w: np.ndarray, g: np.ndarray, codes: np.ndarray, tried: np.ndarray, bins: int) -> tuple[np.ndarray, ...]:
    """(cells met, weights, gradients) of one block, whose slots count from 0."""
    parts, some = [], len(tried) * bins
    dense = some <= 4 * len(slot)
    for k in range(tried.shape[1]):
        used = tried[slot, k]
        left = used >= 0
        s, r, u, a, b = (slot, row, used, w, g) if left.all() else (v[left] for v in (slot, row, used, w, g))
        cell = s.astype(np.int64) * bins + codes[r, u]
        if dense:
            weight, gradient = np.bincount(cell, a, some), np.bincount(cell, b, some)
            met = np.flatnonzero(weight)
            parts.append((met, weight[met], gradient[met]))
        else:
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            head = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, dtype=np.int64)
            parts.append((cell[head], *[np.add.reduceat(v[order], head) if len(head) else v[:0] for v in (a, b)]))
        met = parts[-1][0]
        parts[-1] = (met // bins * (tried.shape[1] * bins) + k * bins + met % bins, *parts[-1][1:])
    return tuple(np.concatenate(c) for c in zip(*parts))


def _best(group: pa.Table, rule: Rule, opened: Open, width: int, seeds: np.ndarray, bins: int) -> pa.Table:
    """The split of each slot with the largest gain; equal gains go to the feature ranked first for its model, then the smaller bin."""
    where = opened.block(group.column("block")[0].as_py())
    tried = opened.tried(where, rule, width, seeds)
    cell, w, g = _summed(*(np.concatenate([np.frombuffer(v, t) for v in group.column(n).to_pylist()]) for n, t in (("cell", np.int64), ("w", np.float64), ("g", np.float64))))
    found = _choice(cell, w, g, rule, opened.model[where] + opened.first, tried, width, seeds, bins)
    return pa.table(found | {"slot": found["slot"] + where.start, "feature": pa.array(found["feature"], pa.int32()), "cut": pa.array(found["cut"], pa.int32())})


def _choice(cell: np.ndarray, w: np.ndarray, g: np.ndarray, rule: Rule, model: np.ndarray, tried: np.ndarray, width: int, seeds: np.ndarray, bins: int) -> dict[str, np.ndarray]:
    """The split of each slot from its cells, ascending, their weights and gradients; ``model`` has the model of each slot."""
    line, code = cell // bins, cell % bins  # a line is one slot and feature
    slot = line // tried.shape[1]
    head = np.r_[True, line[1:] != line[:-1]]
    begin = np.flatnonzero(head)
    which = np.cumsum(head) - 1
    w_all, g_all = np.add.reduceat(w, begin)[which], np.add.reduceat(g, begin)[which]
    wl, gl = np.cumsum(w), np.cumsum(g)
    wl, gl = wl - (wl - w)[begin][which], gl - (gl - g)[begin][which]
    wr, gr = w_all - wl, g_all - gl
    last = np.r_[head[1:], True]
    fits = ~last & (wl >= rule.least_weight) & (wr >= rule.least_weight)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, gl * gl / (wl + rule.penalty) + gr * gr / (wr + rule.penalty) - g_all * g_all / (w_all + rule.penalty), -1.0)
    # sums differ in their last digits with the order of the tasks, gains that close are equal
    scale = np.maximum(np.abs(g_all * g_all / (w_all + rule.penalty)), 1e-12)
    gain = np.where(gain > 1e-9 * scale, gain, -1.0)
    gains = np.flatnonzero(gain > 0)
    size = np.full(len(gain), -np.inf)
    size[gains] = np.round(np.log(np.maximum(gain[gains], 1e-300)) * 1e8)
    edge = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    largest = np.repeat(np.maximum.reduceat(size, edge), np.diff(np.r_[edge, len(slot)]))
    equal = np.flatnonzero((size == largest) & ((size > -np.inf) | np.r_[True, slot[1:] != slot[:-1]]))
    feature = tried.reshape(-1)[line[equal]]
    models, at = np.unique(model, return_inverse=True)
    rank = _ranks(models, width, seeds)[at[slot[equal]], feature]
    order = np.lexsort((code[equal], rank, slot[equal]))
    order = order[np.r_[True, slot[equal][order][1:] != slot[equal][order][:-1]]]
    first, feature = equal[order], feature[order]
    split = gain[first] > 0
    return {"slot": slot[first], "w": w_all[first], "g": g_all[first], "feature": np.where(split, feature, -1), "cut": code[first], "wl": wl[first], "gl": gl[first]}


def grow(rows: DataFrame, gradients: Callable, models: int, width: int, rule: Rule, seeds: np.ndarray, bins: int = BINS) -> Trees:
    """Trees of all models. ``rows`` is a written table of :func:`binned`; ``gradients(batch, bins, models)`` gives row weights and gradients.

    ``seeds`` has a seed for each model: it orders the features of equal gain, and those that a node tries when a rule tries few.
    A node that finds no split among the features tried goes on to the next ones.
    """
    trees = Trees(models)
    for begin in range(0, models, GROUP):
        _grow_group(rows, gradients, trees, np.arange(begin, min(begin + GROUP, models)), width, rule, seeds, bins)
    return trees


def _tried(model: np.ndarray, node: np.ndarray, attempt: np.ndarray, rule: Rule, width: int, seeds: np.ndarray) -> np.ndarray:
    """(nodes x features tried): drawn without replacement by hash, -1 where none are left."""
    if rule.tried is None:
        return np.broadcast_to(np.arange(width), (len(model), width))
    with np.errstate(over="ignore"):
        h = mixed(seeds[model].astype(np.uint64)[:, None] * _ODD + mixed(model.astype(np.uint64) * _ODD + node.astype(np.uint64))[:, None] + np.arange(width, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    order = np.argsort(mixed(h), axis=1)
    place = attempt[:, None] * rule.tried + np.arange(rule.tried)
    return np.where(place < width, np.take_along_axis(order, np.minimum(place, width - 1), axis=1), -1)


def _ranks(model: np.ndarray, width: int, seeds: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mixed(mixed(seeds[model].astype(np.uint64))[:, None] + np.arange(1, width + 1, dtype=np.uint64) * _ODD)
    return np.argsort(np.argsort(h, axis=1), axis=1)


def _adder(shared, gradients: Callable, models: np.ndarray, rule: Rule, seeds: np.ndarray, bins: int, width: int) -> Callable:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, opened = shared.value
        return _partial(batches, gradients, trees, Open(*opened), models, rule, seeds, bins, width)

    return add


def _picker(shared, rule: Rule, seeds: np.ndarray, bins: int, width: int) -> Callable:
    def pick(group: pa.Table) -> pa.Table:
        return _best(group, rule, Open(*shared.value[1]), width, seeds, bins)

    return pick


def _grow_group(rows: DataFrame, gradients: Callable, trees: Trees, models: np.ndarray, width: int, rule: Rule, seeds: np.ndarray, bins: int, first: int = 0) -> None:
    spark = rows.sparkSession
    none = np.zeros(len(models), dtype=np.int64)
    opened = Open(models.astype(np.int64), none, none, none, first)
    while len(opened.model):
        # the trees themselves, which the driver holds anyway; of the open nodes, what tells their features apart
        shared = spark.sparkContext.broadcast((trees.arrays(), (opened.model, opened.node, opened.depth, opened.attempt, first)))
        cells = rows.mapInArrow(_adder(shared, gradients, models, rule, seeds, bins, width), _CELLS)
        found = cells.groupBy("block").applyInArrow(_picker(shared, rule, seeds, bins, width), _SPLITS).toArrow()  # one row for each open node
        shared.unpersist()
        opened = _advance(trees, opened, {n: found.column(n).to_numpy() for n in found.column_names}, width, rule)


def _advance(trees: Trees, opened: Open, found: dict[str, np.ndarray], width: int, rule: Rule) -> Open:
    """Enter the splits found into the trees; the nodes that are open then."""
    order = np.argsort(found["slot"])
    slot, w, g, feature, cut, wl, gl = (found[n][order] for n in ("slot", "w", "g", "feature", "cut", "wl", "gl"))
    model, node, depth, attempt = (a[slot] for a in (opened.model, opened.node, opened.depth, opened.attempt))
    root = node == 0
    trees.value[model[root], 0] = g[root] / (w[root] + rule.penalty)
    again = np.zeros(len(slot), dtype=bool)
    if rule.tried is not None:
        again = (feature < 0) & ((attempt + 1) * rule.tried < width) & (0 < g) & (g < w)
    split = np.flatnonzero(feature >= 0)
    wl, gl = wl[split], gl[split]
    wr, gr = w[split] - wl, g[split] - gl
    left = trees.split(model[split], node[split], feature[split], cut[split], gl / (wl + rule.penalty), gr / (wr + rule.penalty))
    parts = [(slot[again] * 2, model[again], node[again], depth[again], attempt[again] + 1)]
    for k, (cw, cg) in enumerate(((wl, gl), (wr, gr))):
        grows = (depth[split] + 1 < rule.depth) & (cw >= 2 * rule.least_weight)
        if rule.tried is not None:
            grows &= (0 < cg) & (cg < cw)
        at = split[grows]
        parts.append((slot[at] * 2 + k, model[at], left[grows] + k, depth[at] + 1, np.zeros(len(at), dtype=np.int64)))
    place, *columns = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(place, kind="stable")
    return Open(*(c[order] for c in columns), opened.first)


def _targets(piece: pa.RecordBatch, species: int) -> np.ndarray:
    return _matrix(piece.column("_y"), species)


def boost(rows: DataFrame, vector_size: int, features: str, vector: str, key: str, seeds: Sequence[int], rounds: int, depth: int, rate: float,
          penalty: float = 0.0, split: str = "split", width: int = 27) -> DataFrame:
    """Least-squares boosting of every species and seed: every row once for each seed, with ``seed`` and ``p``.

    Starts from the train means; every round grows one tree for each species and seed on the residuals. Predictions so far are
    written every :data:`REFRESH` rounds, so that a task never walks more than so many trees.
    """
    models = vector_size * len(seeds)
    train = rows.filter(F.col(split) == "train")
    cuts = cut_points(train, features, width)
    table = materialize(binned(dealt(rows, models, width), features, vector, key, cuts), "bins")
    means = train.select(F.posexplode(vector).alias("s", "v")).groupBy("s").agg(F.avg("v").alias("m")).collect()  # one row a species
    base = np.zeros(vector_size)
    for r in means:
        base[r["s"]] = r["m"]
    start = np.tile(base, len(seeds))
    current = table.withColumn("_f", F.array(*[F.lit(float(v)) for v in start]) if len(means) else F.array().cast("array<double>"))
    if not means:
        return _scored(current, vector_size, seeds, split, vector)
    spark, recent = rows.sparkSession, []
    model_seeds = np.repeat(np.asarray(seeds, dtype=np.int64), vector_size)
    rule = Rule(depth, penalty)

    def ahead(piece: pa.RecordBatch, codes: np.ndarray, done: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        f = _matrix(piece.column("_f"), models)
        for trees in done:
            f = f + rate * predict(trees, codes)
        return f

    for number in range(rounds):
        held = spark.sparkContext.broadcast(list(recent))

        def residuals(piece, codes, chosen, held=held):
            f = ahead(piece, codes, held.value)[:, chosen]
            y = _targets(piece, vector_size)[:, chosen % vector_size]
            return np.ones_like(f), y - f

        learn = current.filter(F.col(split) == "train").select("_row", "_bins", "_y", "_f")
        recent.append(grow(learn, residuals, models, width, rule, model_seeds).arrays())
        held.unpersist()
        if len(recent) == REFRESH or number == rounds - 1:
            current = materialize(_moved(current, recent, ahead, width), f"boost-{number}-{uuid.uuid4().hex[:4]}")
            recent = []
    return _scored(current, vector_size, seeds, split, vector)


def _moved(current: DataFrame, recent: list[tuple[np.ndarray, ...]], ahead: Callable, width: int) -> DataFrame:
    held = current.sparkSession.sparkContext.broadcast(list(recent))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = ahead(batch, _codes(batch.column("_bins"), width), held.value)
            offsets = pa.array(np.arange(len(f) + 1, dtype=np.int32) * f.shape[1])
            moved = pa.ListArray.from_arrays(offsets, pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([moved if n == "_f" else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return current.mapInArrow(move, current.schema)


def _scored(current: DataFrame, species: int, seeds: Sequence[int], split: str, vector: str) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(int(s)).alias("seed"), F.slice("_f", k * species + 1, species).alias("p")) for k, s in enumerate(seeds)])
    return current.withColumn("_each", F.explode(parts)).withColumns({"seed": F.col("_each.seed"), "p": F.col("_each.p")}).drop(
        "_each", "_f", "_row", "_bins", "_y")


def forest(rows: DataFrame, vector_size: int, features: str, vector: str, key: str, trees: int, seed: int, depth: int, split: str = "split",
           width: int = 27) -> DataFrame:
    """``rows`` with ``p``, the share of presence in the leaves of a forest for each species; presence is a rate above 0.

    Every tree sees its own Poisson draw of the train rows and tries the square root of the number of features in a node. Model
    numbers run over species, then trees.
    """
    models = vector_size * trees
    train = rows.filter(F.col(split) == "train")
    rule = Rule(depth, tried=max(1, int(np.sqrt(width))))
    table = binned(dealt(rows, models, rule.tried), features, vector, key, cut_points(train, features, width))
    table = materialize(table.withColumn("_place", F.monotonically_increasing_id()), "bins")
    votes = _voted_whole if table.count() * (width + vector_size // 8 + 18) <= HELD_BYTES else _voted_by_level
    return _with_votes(table, votes(table, vector_size, trees, seed, rule, split, width), vector_size, trees)


_VOTES = "part bigint, species int, block int, at int, total binary"


def _vote_rows(place: np.ndarray, sums: np.ndarray, species: Sequence[int], block: int) -> pa.RecordBatch:
    """Sums of the votes of ascending places by species, one row for each species and run of places in one part."""
    part = place >> PART
    begin = np.flatnonzero(np.r_[True, (np.diff(place) != 1) | (np.diff(part) != 0)]) if len(place) else np.zeros(0, dtype=np.int64)
    runs = list(zip(begin, np.r_[begin[1:], len(place)]))
    columns = [np.repeat(part[begin], len(species)), np.tile(np.asarray(species, dtype=np.int32), len(runs)), np.full(len(runs) * len(species), block, dtype=np.int32),
               np.repeat((place[begin] & ((1 << PART) - 1)).astype(np.int32), len(species))]
    total = [np.ascontiguousarray(sums[a:b, k]).tobytes() for a, b in runs for k in range(len(species))]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(total, pa.binary())], ["part", "species", "block", "at", "total"])


def _with_votes(table: DataFrame, votes: DataFrame, species: int, trees: int) -> DataFrame:
    """``table`` with ``p``, the votes of each row over the number of trees."""
    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        sums = np.zeros((species, 1 << PART))
        for v in sorted(right.to_pylist(), key=lambda v: (v["species"], v["block"])):  # always added up in this order
            total = np.frombuffer(v["total"], np.float64)
            sums[v["species"], v["at"]:v["at"] + len(total)] += total
        p = sums[:, left.column("_place").to_numpy() & ((1 << PART) - 1)].T / trees
        offsets = pa.array(np.arange(len(p) + 1, dtype=np.int32) * species)
        return left.drop_columns(["_part"]).append_column("_p", pa.ListArray.from_arrays(offsets, pa.array(p.ravel())))

    schema = T.StructType([*table.schema.fields, T.StructField("_p", T.ArrayType(T.DoubleType()))])
    by_part = table.withColumn("_part", F.shiftright("_place", PART)).groupBy("_part")
    voted = by_part.cogroup(votes.groupBy("part")).applyInArrow(joined, schema)
    return voted.withColumn("p", F.col("_p")).drop("_p", "_place", "_row", "_bins", "_y")


def _voted_by_level(table: DataFrame, species: int, trees: int, seed: int, rule: Rule, split: str, width: int) -> DataFrame:
    """Votes of a few trees at a time, as many as have :data:`NODES` nodes if each row drawn ends in a leaf of its own."""
    spark, path = table.sparkSession, scratch_path(table.sparkSession, "votes")
    learn = table.filter(F.col(split) == "train").select("_row", "_bins", "_y")
    models, some = species * trees, max(1, NODES // max(1, 2 * learn.count()))
    for begin in range(0, models, some):
        chosen = np.arange(begin, min(begin + some, models))

        def draws(piece: pa.RecordBatch, codes: np.ndarray, own: np.ndarray, begin=begin):
            present = (_targets(piece, species) > 0).astype(np.float64)[:, (begin + own) // trees]
            w = poisson_weights(piece.column("_row").to_numpy(), begin + own, seed)
            return w, w * present

        grown = Trees(len(chosen))
        _grow_group(learn, draws, grown, np.arange(len(chosen)), width, rule, np.full(models, seed, dtype=np.int64), BINS, begin)
        held = spark.sparkContext.broadcast(grown.arrays())
        own, first = np.unique(chosen // trees, return_index=True)

        def vote(batches: Iterator[pa.RecordBatch], held=held, own=own, first=first, begin=begin, step=max(1, CHUNK // len(chosen))) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    piece = batch.slice(at, step)
                    sums = np.add.reduceat(predict(held.value, _codes(piece.column("_bins"), width)), first, axis=1)
                    yield _vote_rows(piece.column("_place").to_numpy(), sums, own, begin)

        table.select("_place", "_bins").mapInArrow(vote, _VOTES).write.mode("append").parquet(path)
        held.unpersist()
    kind = T.StructType([T.StructField(n, t) for n, t in (("part", T.LongType()), *((n, T.IntegerType()) for n in ("species", "block", "at")), ("total", T.BinaryType()))])
    return spark.read.schema(kind).parquet(path) if models else spark.createDataFrame([], kind)


def _voted_whole(table: DataFrame, species: int, trees: int, seed: int, rule: Rule, split: str, width: int) -> DataFrame:
    """Votes of trees that a task grows by itself: all rows reach the tasks as bins, presence as bits; trees stay where they grew."""
    spark = table.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.packbits(_targets(batch, species) > 0, axis=1)
            column = pa.array([r.tobytes() for r in bits], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("_place", "_row", "_learn", "_bins")), column], ["_place", "_row", "_learn", "_bins", "_present"])

    learn = F.coalesce(F.col(split) == "train", F.lit(False)).alias("_learn")
    rows = table.select("_place", "_row", learn, "_bins", "_y").mapInArrow(pack, "_place bigint, _row bigint, _learn boolean, _bins binary, _present binary").toArrow()
    place = rows.column("_place").to_numpy()
    order = np.argsort(place)
    codes, present = (_codes(rows.column(n).combine_chunks(), k)[order] for n, k in (("_bins", width), ("_present", -(-species // 8))))
    chosen = rows.column("_learn").to_numpy()[order].astype(bool)
    held = spark.sparkContext.broadcast((place[order], rows.column("_row").to_numpy()[order], chosen, codes, present))
    # each species is cut into blocks of trees by its work, and by the cores if there are few species
    each, cores = int(chosen.sum()) * trees * rule.tried, spark.sparkContext.defaultParallelism
    blocks = min(trees, max(1, -(-each // MOST_WORK), -(-cores // max(1, species)) if each >= LEAST_WORK else 1))
    tasks = max(1, min(species * blocks, each * species // LEAST_WORK))
    bounds, seeds = [k * trees // blocks for k in range(blocks + 1)], np.full(species * trees, seed, dtype=np.int64)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, keys, chosen, codes, present = held.value
        keys, learned = keys[chosen], codes[chosen]
        side = max(1, TOGETHER // max(1, len(keys)))
        for number in (n for batch in batches for n in batch.column("id").to_pylist()):
            own, block = divmod(number, blocks)
            here = (present[chosen, own // 8] >> (7 - own % 8) & 1).astype(np.int64)
            total = np.zeros(len(place))
            for begin in range(bounds[block], bounds[block + 1], side):
                models = own * trees + np.arange(begin, min(begin + side, bounds[block + 1]))
                grown = _grown(learned, poisson_weights(keys, models, seed), here, models, rule, seeds, width)
                for at in range(0, len(place), TOGETHER):
                    total[at:at + TOGETHER] += predict(grown.arrays(), codes[at:at + TOGETHER]).sum(axis=1)
            step = 256 << PART
            for at in range(0, len(place), step):
                yield _vote_rows(place[at:at + step], total[at:at + step, None], [own], block)

    return materialize(spark.range(0, species * blocks, 1, tasks).mapInArrow(vote, _VOTES), "votes")


def _grown(codes: np.ndarray, weights: np.ndarray, present: np.ndarray, models: np.ndarray, rule: Rule, seeds: np.ndarray, width: int) -> Trees:
    """Trees of some models over rows held here: the same as :func:`grow` makes of them. ``weights`` are small whole numbers, rows x models."""
    trees, none = Trees(len(models)), np.zeros(len(models), dtype=np.int64)
    opened = Open(np.arange(len(models)), none, none, none, int(models[0]))
    slot, row = np.nonzero(weights.T > 0)
    w = weights[row, slot].astype(np.int64)
    marks = w * 2 + present[row]  # weight and presence in five bits
    while len(slot):
        every = slice(0, len(opened.model))
        tried = opened.tried(every, rule, width, seeds)
        found = _choice(*_held_cells(slot, row, marks, codes, tried), rule, opened.model + opened.first, tried, width, seeds, BINS)
        before, opened = opened, _advance(trees, opened, found, width, rule)
        model, node = before.model[slot], before.node[slot]
        feature = trees.feature[model, node]
        node = np.where(feature >= 0, trees.child[model, node] + (codes[row, feature] > trees.cut[model, node]), node)
        slots = np.full(trees.feature.shape, -1, dtype=np.int64)
        slots[opened.model, opened.node] = np.arange(len(opened.model))
        slot = slots[model, node]
        still = slot >= 0
        slot, row, marks = slot[still], row[still], marks[still]
    return trees


def _held_cells(slot: np.ndarray, row: np.ndarray, marks: np.ndarray, codes: np.ndarray, tried: np.ndarray) -> tuple[np.ndarray, ...]:
    """(cells met, ascending, weights, weights of presence) of all slots; a cell is one slot, feature tried and bin."""
    used = tried[slot]
    cell = (slot[:, None] * tried.shape[1] + np.arange(tried.shape[1])) * BINS + codes[row[:, None], used]
    if (used < 0).any():
        left = used >= 0
        cell, marks = cell[left], np.broadcast_to(marks[:, None], used.shape)[left]
    else:
        cell, marks = cell.ravel(), np.repeat(marks, used.shape[1])
    some = len(tried) * tried.shape[1] * BINS
    if some <= 4 * len(cell):
        w = marks >> 1
        weight, gradient = np.bincount(cell, w, some), np.bincount(cell, w * (marks & 1), some)
        met = np.flatnonzero(weight)
        return met, weight[met], gradient[met]
    packed = np.sort(cell << 5 | marks)
    cell, w = packed >> 5, packed >> 1 & 15
    head = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    return cell[head], *(np.add.reduceat(v, head).astype(np.float64) for v in (w, w * (packed & 1)))
