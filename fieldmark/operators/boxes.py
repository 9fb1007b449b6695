"""Joins of points and boxes on overlap, as equi-joins on grid cells.

Every box picks, per axis, the smallest power-of-two cell not shorter than itself, so it touches at most two cells
per axis however large it is. A side also announces itself on the levels the other side uses. A pair is accepted in
one cell only (the one holding the lower corner of the overlap), which makes a later de-duplication needless.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldmark.functions import arrays
from fieldmark.operators import cells, distribution
from fieldmark.session import materialize


class Axis(NamedTuple):
    """Closed interval columns of one axis, the same names on both sides, and the finest cell length.

    With ``open_ends`` a missing end is open, as for time; else a row without an end has no place and meets nothing.
    """

    low: str
    high: str
    base: float = 0.01
    open_ends: bool = True


LON, LAT = Axis("minx", "maxx", open_ends=False), Axis("miny", "maxy", open_ends=False)


OPEN = 1e15  # stands for a missing end


def _low(axis: Axis, side: str | None = None) -> Column:
    return F.coalesce(F.col(side)[axis.low] if side else F.col(axis.low), F.lit(-OPEN))


def _high(axis: Axis, side: str | None = None) -> Column:
    return F.coalesce(F.col(side)[axis.high] if side else F.col(axis.high), F.lit(OPEN))


def _level(axis: Axis) -> Column:
    extent = _high(axis) - _low(axis)
    return F.when(extent > axis.base, F.ceil(F.ln(extent / F.lit(axis.base)) / F.ln(F.lit(2.0)))).otherwise(F.lit(0)).cast("int")


def _length(axis: Axis, level: Column) -> Column:
    return F.lit(axis.base) * F.pow(F.lit(2.0), level)


def _with_levels(df: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    return df.withColumn("_lv", F.array(*[_level(a) for a in axes]))


def _levels_in_use(df: DataFrame) -> Column:
    """Distinct level combinations of a side: a handful of small arrays, whatever the row count."""
    return df.select("_lv").distinct().agg(F.collect_list("_lv").alias("all")).select("all").scalar()


def _announce(df: DataFrame, axes: Sequence[Axis], other_levels: Column) -> DataFrame:
    own = F.col("_lv")
    targets = F.array_distinct(F.transform("_other", lambda o: F.zip_with(o, own, lambda x, y: F.greatest(x, y))))
    df = df.withColumn("_other", other_levels).withColumn("_at", F.explode(targets)).drop("_other")
    for i, a in enumerate(axes):
        size = _length(a, F.col("_at")[i])
        df = df.withColumn(f"_c{i}", F.explode(F.sequence(F.floor(_low(a) / size), F.floor(_high(a) / size))))
    return df


def _placed(df: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    for a in axes:
        if not a.open_ends:
            df = df.filter(F.col(a.low).isNotNull() & F.col(a.high).isNotNull() & ~F.isnan(F.col(a.low).cast("double")) & ~F.isnan(F.col(a.high).cast("double")))
    return df


def overlap_join(left: DataFrame, right: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """All pairs whose closed intervals overlap on every axis: columns of both sides as structs ``l`` and ``r``.
    A missing end is open on axes with ``open_ends``; rows without an end on another axis are left out.

    The rows of each cell are counted first; left rows of crowded cells are dealt out over as many tasks as they need and the
    right side is repeated in those cells only, so the larger side belongs on the left.
    """
    a, b = (_with_levels(_placed(side, axes), axes) for side in (left, right))
    la, lb = _levels_in_use(a), _levels_in_use(b)
    a, b = _announce(a, axes, lb), _announce(b, axes, la)
    keys = ["_at", *[f"_c{i}" for i in range(len(axes))]]
    a = a.select(*keys, F.col("_lv").alias("_la"), F.struct(*left.columns).alias("l"))
    b = b.select(*keys, F.col("_lv").alias("_lb"), F.struct(*right.columns).alias("r"))
    joined = cells.join(a, b, keys, F.xxhash64("l"))
    keep = F.col("_at") == F.zip_with("_la", "_lb", lambda x, y: F.greatest(x, y))
    for i, ax in enumerate(axes):
        start = F.greatest(_low(ax, "l"), _low(ax, "r"))
        end = F.least(_high(ax, "l"), _high(ax, "r"))
        keep = keep & (start <= end) & (F.floor(start / _length(ax, F.col("_at")[i])) == F.col(f"_c{i}"))
    return joined.filter(keep).select("l", "r")


def _ends(axes: Sequence[Axis]) -> list[str]:
    return [c for a in axes for c in (a.low, a.high)]


def shared_overlap_join(left: DataFrame, right: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """The pairs of :func:`overlap_join` where rows of ``left`` share their boxes, as the scenes of a tile do.

    Equal boxes are compared once with the right side; the pairs of boxes and right rows then meet the rows of the box in an
    equi-join, so the work is that of the boxes and of the pairs that there are.
    """
    ends = {c: f"_e{i}" for i, c in enumerate(_ends(axes))}
    own = {c: end for a in axes for c, end in ((a.low, _low(a)), (a.high, _high(a)))}
    rows = materialize(_placed(left, axes).select(*[own[c].alias(e) for c, e in ends.items()], F.struct(*left.columns).alias("l")), "boxed")
    places = rows.select(*[F.col(e).alias(c) for c, e in ends.items()]).distinct()
    met = overlap_join(right, places, axes).select(*[F.col(f"r.{c}").alias(e) for c, e in ends.items()], F.col("l").alias("r"))
    return cells.join(materialize(met, "met"), rows, list(ends.values()), F.xxhash64("r")).select("l", "r")


def merged_spans(df: DataFrame, keys: Sequence[str], axis: Axis) -> DataFrame:
    """(keys, low, high): the closed intervals of each key joined where they overlap; a missing end is open, low > high is empty."""
    each = df.select(*keys, _low(axis).alias(axis.low), _high(axis).alias(axis.high)).distinct().filter(F.col(axis.low) <= F.col(axis.high))
    order = Window.partitionBy(*keys).orderBy(axis.low, axis.high)
    reach = F.max(axis.high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = each.withColumn("_new", F.when(F.col(axis.low) <= reach, 0).otherwise(1))
    numbered = begun.withColumn("_span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_span").agg(F.min(axis.low).alias(axis.low), F.max(axis.high).alias(axis.high)).drop("_span")


def as_point_boxes(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points as boxes without extent."""
    return points.withColumns({"minx": F.col(lon), "maxx": F.col(lon), "miny": F.col(lat), "maxy": F.col(lat)})


def invalid(df: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """Boxes with min > max on an axis."""
    bad = F.lit(False)
    for a in axes:
        bad = bad | (F.col(a.low) > F.col(a.high))
    return df.filter(bad)


def validated(df: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """Same rows; fails at run time on the first invalid box."""
    for a in axes:
        message = F.concat(F.lit(f"invalid box: {a.low}="), F.col(a.low).cast("string"), F.lit(f" > {a.high}="), F.col(a.high).cast("string"))
        df = df.withColumn(a.low, F.when(F.col(a.low) > F.col(a.high), F.raise_error(message)).otherwise(F.col(a.low)))
    return df


def extent(df: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    return df.agg(*[F.min(a.low).alias(a.low) for a in axes], *[F.max(a.high).alias(a.high) for a in axes])


def grid_chips(boxes: DataFrame, size: float, stride: float) -> DataFrame:
    """Row-major chips of every box: (.., chip_row, chip_col, minx, maxx, miny, maxy)."""
    size, stride = F.lit(float(size)), F.lit(float(stride))

    def steps(low: str, high: str) -> Column:
        n = F.floor((F.col(high) - F.col(low) - size) / stride)
        return F.when(n >= 0, F.sequence(F.lit(0).cast("bigint"), n)).otherwise(F.array().cast("array<bigint>"))

    chips = boxes.withColumn("chip_row", F.explode(steps("miny", "maxy"))).withColumn("chip_col", F.explode(steps("minx", "maxx")))
    x, y = F.col("minx") + F.col("chip_col") * stride, F.col("miny") + F.col("chip_row") * stride
    return chips.withColumns({"minx": x, "maxx": x + size, "miny": y, "maxy": y + size})


def random_chips(boxes: DataFrame, key: str, size: float, draws: DataFrame, seed: int) -> DataFrame:
    """A chip of a fixed size for each row of ``draws`` (a whole number ``draw``), inside a box drawn uniformly with replacement.

    Boxes are numbered by their key, range by range (no global sort in one task), a draw names the number of its box, and the
    two meet in an equi-join.
    """
    numbered = distribution.running_sum(boxes.withColumn("_one", F.lit(1).cast("bigint")), F.col(key), key, "_one").withColumnRenamed("before", "_ordinal")
    total = boxes.agg(F.count("*").alias("n")).select("n").scalar()
    drawn = draws.select("draw", F.floor(arrays.uniform(seed, F.col("draw")) * total).cast("bigint").alias("_ordinal"))
    hit = drawn.join(numbered, "_ordinal")
    x = F.col("minx") + arrays.uniform(seed + 1, F.col("draw")) * (F.col("maxx") - F.col("minx") - F.lit(float(size)))
    y = F.col("miny") + arrays.uniform(seed + 2, F.col("draw")) * (F.col("maxy") - F.col("miny") - F.lit(float(size)))
    return hit.select("draw", key, x.alias("minx"), (x + F.lit(float(size))).alias("maxx"), y.alias("miny"), (y + F.lit(float(size))).alias("maxy"))
