"""Column functions on dense vectors and on flat, row-major image patches.

A patch is ``STRUCT<bands, h, w, data>``; pixel ``(band, y, x)`` sits at ``band*h*w + y*w + x``.
Everything here is row-local: no shuffle, no Python worker.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def patch(data: Column, bands, h, w) -> Column:
    def as_int(v):
        return v.cast("int") if isinstance(v, Column) else F.lit(int(v))

    return F.struct(as_int(bands).alias("bands"), as_int(h).alias("h"), as_int(w).alias("w"), data.alias("data"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Lambda bodies are evaluated per element and do not share sub-expressions, so anything costly used inside one is
    bound first.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def on_image(fn: Callable[..., Column]) -> Callable[..., Column]:
    """Bind the first argument, a patch, before the function uses it inside lambdas."""

    @functools.wraps(fn)
    def run(img: Column, *args, **kwargs) -> Column:
        return let(img, lambda i: fn(i, *args, **kwargs))

    return run


def at(values: Column, i: Column) -> Column:
    """Zero-based element access, NULL outside the array."""
    return F.get(values, i.cast("int"))


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def build(bands, h, w, pixel: Callable[[Column, Column, Column], Column]) -> Column:
    """New patch whose pixel at (band, y, x) is ``pixel(band, y, x)``."""
    b, hh, ww = (v.cast("int") if isinstance(v, Column) else F.lit(int(v)) for v in (bands, h, w))
    plane = hh * ww
    index = F.when(b * plane > 0, F.sequence(F.lit(0), b * plane - 1)).otherwise(F.array().cast("array<int>"))

    def value(i: Column) -> Column:
        band, rest = F.floor(i / plane), i % plane
        return pixel(band, F.floor(rest / ww), rest % ww)

    return patch(F.transform(index, value), b, hh, ww)


def pixel(img: Column, band: Column, y: Column, x: Column) -> Column:
    return at(img["data"], band * img["h"] * img["w"] + y * img["w"] + x)


@on_image
def map_pixels(img: Column, fn: Callable[[Column, Column], Column]) -> Column:
    """Apply ``fn(value, band)`` to every pixel."""
    plane = img["h"] * img["w"]
    return patch(F.transform(img["data"], lambda v, i: fn(v, F.floor(i / plane))), img["bands"], img["h"], img["w"])


def band_slice(img: Column, band: Column) -> Column:
    plane = img["h"] * img["w"]
    return F.slice(img["data"], (band * plane + 1).cast("int"), plane)


@on_image
def per_band(img: Column, fn: Callable[[Column], Column]) -> Column:
    """One value per band: ``fn(pixels of the band)``."""
    return F.transform(F.sequence(F.lit(0), img["bands"] - 1), lambda b: fn(band_slice(img, b)))


def scatter(entries: Column, size: Column, fill: float | None = 0.0, kind: str = "double") -> Column:
    """Dense vector of ``size`` values (doubles unless ``kind`` says otherwise) from ``ARRAY<STRUCT<idx, value>>`` sorted by unique ``idx``; gaps get ``fill``.

    Linear in ``size``: runs of the filler are put between neighbours, nothing is looked up.
    """
    zero = F.lit(fill).cast(kind)

    def widen(cells: Column) -> Column:
        def run(e: Column, i: Column) -> Column:
            before = F.coalesce(F.get(cells, i - 1)["idx"], F.lit(-1))
            return F.concat(F.array_repeat(zero, (e["idx"] - before - 1).cast("int")), F.array(e["value"]))

        last = F.coalesce(F.get(cells, F.size(cells) - 1)["idx"], F.lit(-1))
        return F.concat(F.flatten(F.transform(cells, run)), F.array_repeat(zero, (size - last - 1).cast("int")))

    return let(entries, widen)


def unrolled(vector: str | Column, *names: str) -> Column:
    """Generator of (position, value) rows of a vector that is never empty.

    The plain generator makes Catalyst infer a filter on the vector's size, which computes a derived vector twice;
    the outer form does not.
    """
    return F.posexplode_outer(vector).alias(*names)


def total(values: Column) -> Column:
    """NULL-skipping sum."""
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


def present(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def mean(values: Column) -> Column:
    """NULL-skipping mean, NULL when nothing is present."""
    n = F.size(present(values))
    return F.when(n > 0, total(values) / n)


def argsort_desc(values: Column) -> Column:
    """Zero-based positions by falling value, ties by position."""
    keyed = F.transform(values, lambda v, i: F.struct((-v).alias("neg"), i.alias("idx")))
    return F.transform(F.sort_array(keyed), lambda s: s["idx"])


def top_positions(values: Column, k: Column) -> Column:
    return F.slice(argsort_desc(values), 1, k.cast("int"))


def nonzero_count(values: Column) -> Column:
    return F.size(F.filter(values, lambda v: v != 0))


#: Modulus and factors of the portable generator; three empty rounds follow the keys.
_SPAN, _FACTOR, _CARRY, _ROUNDS = 2_147_483_647, 48_271, 40_014, 3


def uniform(seed: int, *key: Column) -> Column:
    """Reproducible uniform number in [0, 1) from a row key; does not depend on partitioning.

    A counter-based generator in plain whole-number arithmetic, which other engines can repeat. Keys are whole numbers; other
    keys go by their hash.
    """
    numbers = [F.pmod(F.coalesce(k.try_cast("bigint"), F.xxhash64(k)), F.lit(_SPAN)) for k in key]
    rounds = F.array(*numbers, *[F.lit(0).cast("bigint")] * _ROUNDS)

    def mix(state: Column, number: Column) -> Column:
        fed = state + number + 1
        return (fed * _FACTOR + F.shiftright(fed, 15) * _CARRY) % _SPAN

    return F.aggregate(rounds, F.lit(seed % _SPAN).cast("bigint"), mix) / F.lit(float(_SPAN))


def normal(seed: int, *key: Column) -> Column:
    """Reproducible standard normal number from a row key."""
    u = F.greatest(uniform(seed, *key), F.lit(1e-12))
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2.0) * F.pi() * uniform(seed + 1, *key))
