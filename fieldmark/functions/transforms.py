"""Image transforms on patches: index arithmetic and pixel arithmetic inside the row."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmark.functions import arrays
from fieldmark.functions.arrays import let, on_image

# Grey weights of red, green, blue.
GREY = (0.2989, 0.587, 0.114)


@on_image
def crop(img: Column, top: Column, left: Column, h: Column, w: Column) -> Column:
    """Window clipped to the image, as slicing does."""
    hh = F.greatest(F.lit(0), F.least(h, img["h"] - top))
    ww = F.greatest(F.lit(0), F.least(w, img["w"] - left))
    return arrays.build(img["bands"], hh, ww, lambda b, y, x: arrays.pixel(img, b, y + top, x + left))


@on_image
def center_crop_half(img: Column, size: int) -> Column:
    """Start at n // 2 - size // 2 on each axis."""
    top = F.greatest(F.lit(0), F.floor(img["h"] / 2) - size // 2).cast("int")
    left = F.greatest(F.lit(0), F.floor(img["w"] / 2) - size // 2).cast("int")
    return crop(img, top, left, F.lit(size), F.lit(size))


@on_image
def center_crop(img: Column, h: int, w: int) -> Column:
    """Start at (n - size) // 2 on each axis."""
    top = F.greatest(F.lit(0), F.floor((img["h"] - h) / 2)).cast("int")
    left = F.greatest(F.lit(0), F.floor((img["w"] - w) / 2)).cast("int")
    return crop(img, top, left, F.lit(h), F.lit(w))


@on_image
def random_crop(img: Column, h: int, w: int, seed: int, *key: Column) -> Column:
    """Start drawn per row below max(n - size, 1)."""
    top = F.floor(arrays.uniform(seed, *key) * F.greatest(img["h"] - h, F.lit(1))).cast("int")
    left = F.floor(arrays.uniform(seed + 1, *key) * F.greatest(img["w"] - w, F.lit(1))).cast("int")
    return crop(img, top, left, F.lit(h), F.lit(w))


def crop_start(img: Column, h: Column, w: Column, centred: bool, seed: int, *key: Column) -> Column:
    """STRUCT<top, left> of a crop of ``img``: in the middle, or drawn per row below max(n - size, 1)."""
    def start(n: Column, size: Column, k: int) -> Column:
        if centred:
            return F.greatest(F.lit(0), F.floor((n - size) / 2).cast("int"))
        return F.floor(arrays.uniform(seed + k, *key) * F.greatest(n - size, F.lit(1))).cast("int")

    return F.struct(start(img["h"], h, 0).alias("top"), start(img["w"], w, 1).alias("left"))


@on_image
def crop_from(img: Column, start: Column, h: Column, w: Column) -> Column:
    """Window of a size at STRUCT<top, left>."""
    return let(start, lambda s: crop(img, s["top"], s["left"], h, w))


@on_image
def hflip(img: Column) -> Column:
    return arrays.build(img["bands"], img["h"], img["w"], lambda b, y, x: arrays.pixel(img, b, y, img["w"] - 1 - x))


@on_image
def vflip(img: Column) -> Column:
    return arrays.build(img["bands"], img["h"], img["w"], lambda b, y, x: arrays.pixel(img, b, img["h"] - 1 - y, x))


def flip_box(box: Column, size: Column, low: str, high: str) -> Column:
    """Mirrored interval of a box along one axis."""
    others = [n for n in ("minx", "maxx", "miny", "maxy") if n not in (low, high)]
    return F.struct((size - box[high]).alias(low), (size - box[low]).alias(high), *[box[n].alias(n) for n in others])


@on_image
def reorder_bands(img: Column, order: Sequence[int]) -> Column:
    picks = F.array(*[F.lit(i) for i in order])
    return arrays.build(len(order), img["h"], img["w"], lambda b, y, x: arrays.pixel(img, arrays.at(picks, b), y, x))


@on_image
def channels_first(img: Column) -> Column:
    """Pixel-interleaved data to band-sequential: a true transpose."""
    n = img["bands"]
    return arrays.build(n, img["h"], img["w"], lambda b, y, x: arrays.at(img["data"], (y * img["w"] + x) * n + b))


def normalize(img: Column, means: Column, stds: Column) -> Column:
    return arrays.map_pixels(img, lambda v, b: (v - arrays.at(means, b)) / arrays.at(stds, b))


@on_image
def max_channel_scale(img: Column) -> Column:
    return let(arrays.per_band(img, F.array_max), lambda tops: arrays.map_pixels(
        img, lambda v, b: v / F.nullif(arrays.at(tops, b), F.lit(0.0))))


def scale(img: Column, divisor: float) -> Column:
    return arrays.map_pixels(img, lambda v, b: v / F.lit(float(divisor)))


@on_image
def minmax(img: Column, low: float = 0.0, high: float = 1.0) -> Column:
    ends = F.struct(F.array_min(img["data"]).alias("lo"), F.array_max(img["data"]).alias("hi"))
    return let(ends, lambda e: arrays.map_pixels(
        img, lambda v, b: F.lit(low) + F.lit(high - low) * (v - e["lo"]) / F.nullif(e["hi"] - e["lo"], F.lit(0.0))))


@on_image
def resize_nearest(img: Column, h: int, w: int) -> Column:
    return arrays.build(img["bands"], h, w, lambda b, y, x: arrays.pixel(
        img, b, F.floor(y * img["h"] / F.lit(h)), F.floor(x * img["w"] / F.lit(w))))


def _taps(n: Column, size: int) -> Column:
    """Per output index the two source indices and the weight of the second: half-pixel centres, edges repeated."""

    def tap(i: Column) -> Column:
        place = F.greatest(F.lit(0.0), (i + F.lit(0.5)) * n / F.lit(float(size)) - F.lit(0.5))
        return let(place, lambda s: F.struct(
            F.floor(s).cast("int").alias("a"), F.least(F.floor(s) + 1, n - 1).cast("int").alias("b"), (s - F.floor(s)).alias("f")))

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), tap)


@on_image
def resize_bilinear(img: Column, h: int, w: int) -> Column:
    """Two passes over precomputed source positions: first along the rows, then along the columns."""

    def resampled(axes: Column) -> Column:
        def line(values: Column) -> Column:
            return F.transform(axes["x"], lambda t: F.get(values, t["a"]) * (1 - t["f"]) + F.get(values, t["b"]) * t["f"])

        def band(b: Column) -> Column:
            start = b * img["h"] * img["w"] + 1
            rows = F.transform(F.sequence(F.lit(0), img["h"] - 1), lambda y: let(
                F.slice(img["data"], (start + y * img["w"]).cast("int"), img["w"]), line))
            return let(rows, lambda r: F.flatten(F.transform(axes["y"], lambda t: F.zip_with(
                F.get(r, t["a"]), F.get(r, t["b"]), lambda p, q: p * (1 - t["f"]) + q * t["f"]))))

        return F.flatten(F.transform(F.sequence(F.lit(0), img["bands"] - 1), band))

    axes = F.struct(_taps(img["h"], h).alias("y"), _taps(img["w"], w).alias("x"))
    return arrays.patch(let(axes, resampled), img["bands"], h, w)


@on_image
def match_resolution(img: Column, own_res: float, target_res: float, h: int, w: int, means: Column | None = None) -> Column:
    """Centre crop to the target's ground extent (at least one pixel), then nearest resize; an empty patch becomes
    the layer means."""

    def extent(n: Column) -> Column:
        return F.floor(n * F.lit(float(target_res)) / F.lit(float(own_res))).cast("int")

    ch, cw = extent(img["h"]), extent(img["w"])
    top = F.greatest(F.lit(0), F.floor(img["h"] / 2) - F.floor(ch / 2)).cast("int")
    left = F.greatest(F.lit(0), F.floor(img["w"] / 2) - F.floor(cw / 2)).cast("int")
    part = crop(img, top, left, F.greatest(ch, F.lit(1)), F.greatest(cw, F.lit(1)))
    if means is not None:
        empty = (part["h"] == 0) | (part["w"] == 0)
        part = F.when(empty, arrays.patch(means, img["bands"], 1, 1)).otherwise(part)
    return resize_nearest(part, h, w)


@on_image
def noise(img: Column, std: float, top: float, seed: int, *key: Column) -> Column:
    """Adds normal noise clamped to [0, top], drawn per pixel from the row key."""
    data = F.transform(img["data"], lambda v, i: v + F.greatest(F.lit(0.0), F.least(
        F.lit(float(top)), F.lit(float(std)) * arrays.normal(seed, *key, i))))
    return arrays.patch(data, img["bands"], img["h"], img["w"])


def brightness(img: Column, factor: float, bound: float = 1.0) -> Column:
    """First three bands times ``factor``, clamped to [0, bound]."""
    return arrays.map_pixels(img, lambda v, b: F.when(b < 3, F.greatest(F.lit(0.0), F.least(F.lit(bound), v * F.lit(float(factor))))).otherwise(v))


@on_image
def contrast(img: Column, factor: float, bound: float = 1.0) -> Column:
    """First three bands blended with the mean grey value, clamped to [0, bound]."""
    grey = sum((F.lit(g) * arrays.mean(arrays.band_slice(img, F.lit(i))) for i, g in enumerate(GREY)), F.lit(0.0))
    f = F.lit(float(factor))
    return let(grey, lambda g: arrays.map_pixels(img, lambda v, b: F.when(b < 3, F.greatest(F.lit(0.0), F.least(
        F.lit(bound), f * v + (1 - f) * g))).otherwise(v)))


@on_image
def gaussian_blur(img: Column, size: int = 3) -> Column:
    """Separable Gaussian stencil with mirrored borders; sigma follows from the kernel size."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    half = size // 2
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    weights = [r / sum(raw) for r in raw]

    def mirrored(n: Column) -> Column:
        def source(i: Column) -> Column:
            return F.when(i < 0, -i).when(i >= n, 2 * n - 2 - i).otherwise(i)

        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(*[source(i + k) for k in range(-half, half + 1)]))

    def mixed(pick: Callable[[int], Column]) -> Column:
        return functools.reduce(lambda s, k: s + F.lit(weights[k]) * pick(k), range(1, size), F.lit(weights[0]) * pick(0))

    def blurred(axes: Column) -> Column:
        def line(values: Column) -> Column:
            return F.transform(axes["x"], lambda t: mixed(lambda k: F.get(values, t[k])))

        def band(b: Column) -> Column:
            start = b * img["h"] * img["w"] + 1
            rows = F.transform(F.sequence(F.lit(0), img["h"] - 1), lambda y: let(
                F.slice(img["data"], (start + y * img["w"]).cast("int"), img["w"]), line))
            columns = F.sequence(F.lit(0), img["w"] - 1)
            return let(rows, lambda r: F.flatten(F.transform(axes["y"], lambda t: F.transform(
                columns, lambda x: mixed(lambda k: F.get(F.get(r, t[k]), x))))))

        return F.flatten(F.transform(F.sequence(F.lit(0), img["bands"] - 1), band))

    axes = F.struct(mirrored(img["h"]).alias("y"), mirrored(img["w"]).alias("x"))
    return arrays.patch(let(axes, blurred), img["bands"], img["h"], img["w"])


def stack(first: Column, *others: Column) -> Column:
    """Bands of all patches behind each other; sizes must agree."""
    bands = first["bands"]
    for o in others:
        bands = bands + o["bands"]
    return arrays.patch(F.concat(first["data"], *[o["data"] for o in others]), bands, first["h"], first["w"])


@on_image
def take_bands(img: Column, start: int, count: int) -> Column:
    plane = img["h"] * img["w"]
    return arrays.patch(F.slice(img["data"], plane * start + 1, plane * count), count, img["h"], img["w"])


def nir_stack(rgb: Column, nir: Column) -> Column:
    """RGB beside NIR scaled to whole bytes of its own maximum, all divided by 255."""
    bytes_ = let(F.nullif(F.array_max(nir["data"]), F.lit(0.0)), lambda top: arrays.map_pixels(
        nir, lambda v, b: F.floor(v / top * F.lit(255.0)).cast("double")))
    return scale(stack(rgb, bytes_), 255.0)


def reflectance_clip(img: Column) -> Column:
    return arrays.map_pixels(img, lambda v, b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / F.lit(10000.0))))
