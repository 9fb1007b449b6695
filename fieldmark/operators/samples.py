"""Training-sample assembly: rows of named patches, targets and metadata.

Steps are ``DataFrame -> DataFrame`` functions on patch columns; a chain of them stays one projection.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions import arrays, transforms

Step = Callable[[DataFrame], DataFrame]

# Channels per named input.
CHANNELS = {"r": 1, "g": 1, "b": 1, "nir": 1, "landuse": 1, "ped": 8, "bioclim": 19, "rgb": 3}


def pixels(images: DataFrame, key: str, img: str = "img") -> DataFrame:
    """(key, band, y, x, value)."""
    i = F.col(img)
    plane = i["h"] * i["w"]
    flat = images.select(key, plane.alias("plane"), i["w"].alias("w"), arrays.unrolled(i["data"], "pos", "value")).filter(F.col("pos").isNotNull())
    rest = F.col("pos") % F.col("plane")
    return flat.select(key, F.floor(F.col("pos") / F.col("plane")).alias("band"), F.floor(rest / F.col("w")).alias("y"),
                       (rest % F.col("w")).cast("bigint").alias("x"), "value")


def min_size(images: DataFrame, side: int, img: str = "img") -> DataFrame:
    return images.filter((F.col(img)["h"] >= side) & (F.col(img)["w"] >= side))


def with_gaps(images: DataFrame, img: str = "img") -> DataFrame:
    """Images holding a missing pixel."""
    return images.filter(F.exists(F.col(img)["data"], lambda v: v.isNull() | F.isnan(v)))


def gated(img: Column, changed: Column, p: float, seed: int, *key: Column) -> Column:
    """``changed`` with probability ``p``, decided per row from its key."""
    if p >= 1:
        return changed
    return F.when(arrays.uniform(seed, *key) < F.lit(float(p)), changed).otherwise(img)


def env_groups(img: Column, sizes: Sequence[int]) -> list[Column]:
    """Consecutive band groups of the environmental patch, by cumulative size."""
    out, start = [], 0
    for n in sizes:
        out.append(transforms.take_bands(img, start, n))
        start += n
    return out


def target(kind: str, probs: str = "probs") -> list[Column]:
    """Target columns: rates, or presence with the rates kept, or raw rates for the logarithmic loss."""
    if kind in ("probs", "log"):
        return [F.col(probs).alias("target")]
    if kind == "binary":
        return [F.transform(probs, lambda v: F.when(v > 0, 1.0).otherwise(v)).alias("target"), F.col(probs).alias("original_target")]
    raise ValueError(f"unknown target type {kind}")


def channel_count(bands: Column) -> Column:
    """Channels of a list of band names; unknown names add nothing."""
    table = F.create_map(*[x for k, v in CHANNELS.items() for x in (F.lit(k), F.lit(v))])
    return F.aggregate(bands, F.lit(0), lambda a, b: a + F.coalesce(F.try_element_at(table, b), F.lit(0)))


def recode(value: Column, minus_one, zero, one) -> Column:
    return F.when(value == -1, minus_one).when(value == 0, zero).when(value == 1, one).otherwise(value)


def steps(specs: Sequence[dict], mode: str, key: str, stats: dict[str, tuple[Sequence[float], Sequence[float]]], seed: int = 0) -> list[Step]:
    """Chain of steps for ``mode`` ("train", "val", "test") from ordered specifications.

    A step is left out when its ``ignore`` is true or names the mode; ``skip`` names inputs that it leaves as they are. A step
    that draws does so once for a sample, and a crop takes one start, from the first of its inputs, for all of them.
    Normalization takes its statistics from ``stats`` by input name.
    """
    out: list[Step] = []
    for n, spec in enumerate(specs):
        if spec.get("ignore") is True or spec.get("ignore") == mode:
            continue
        out.append(_step(spec, mode, F.col(key), stats, seed + 10 * n))
    return out


def multiscale(specs: Sequence[dict], mode: str, key: str, stats: dict, scales: Sequence[int], seed: int = 0) -> tuple[dict[int, list[Step]], list[Step]]:
    """(crops of each scale, the other steps): with several scales every crop of the list is made once for each of them."""
    crops = [s for s in specs if s["name"] == "crop"]
    others = [s for s in specs if s["name"] != "crop"]
    by_scale = {size: steps([{**s, "height": size, "width": size} for s in crops], mode, key, stats, seed) for size in scales}
    return by_scale, steps(others, mode, key, stats, seed + 10 * len(crops))


def assemble_scales(samples: DataFrame, by_scale: dict[int, list[Step]], chain: Sequence[Step], inputs: Sequence[str] = ("sat",)) -> DataFrame:
    """One row for each sample and scale (``scale``): the crops of that scale, then the other steps.

    Crops of all scales are made of the same row, so samples are read once and nothing is joined.
    """
    rows = samples.withColumn("_whole", F.struct(*inputs))
    for size, crops in by_scale.items():
        rows = rows.withColumns({c: F.col(f"_whole.{c}") for c in inputs})
        for step in crops:
            rows = rows.transform(step)
        rows = rows.withColumn(f"_scale_{size}", F.struct(F.lit(size).alias("scale"), *inputs))
    other = [c for c in samples.columns if c not in inputs]
    rows = rows.select(*other, F.inline(F.array(*[F.col(f"_scale_{size}") for size in by_scale])))
    return assemble(rows, chain)


def _crop(spec: dict, mode: str, key: Column, seed: int, inputs: Sequence[str], p: float) -> Step:
    h, w = F.lit(spec["height"]), F.lit(spec["width"])
    centred = spec.get("center") is True or spec.get("center") == mode

    def apply(df: DataFrame) -> DataFrame:
        started = df.withColumn("_start", transforms.crop_start(F.col(inputs[0]), h, w, centred, seed + 1, key))
        return started.withColumns({c: gated(F.col(c), transforms.crop_from(F.col(c), F.col("_start"), h, w), p, seed, key) for c in inputs}).drop("_start")

    return apply


def _step(spec: dict, mode: str, key: Column, stats: dict, seed: int) -> Step:
    name, p = spec["name"], spec.get("p", 1.0)
    inputs = [c for c in spec.get("inputs", ["sat"]) if c not in spec.get("skip", ())]
    if name == "crop" and inputs:
        return _crop(spec, mode, key, seed, inputs, p)

    def change(img: Column, column: str) -> Column:
        if name == "hflip":
            return transforms.hflip(img)
        if name == "vflip":
            return transforms.vflip(img)
        if name == "normalize":
            if spec.get("maxchan"):
                img = transforms.max_channel_scale(img)
            if spec.get("by_255"):
                return transforms.scale(img, 255.0)
            means, stds = stats[column]
            return transforms.normalize(img, arrays.literal_vector(means), arrays.literal_vector(stds))
        if name == "resize":
            fn = transforms.resize_bilinear if column == "sat" else transforms.resize_nearest
            return fn(img, spec["height"], spec["width"])
        if name == "matchres":
            means = arrays.literal_vector(stats[column][0])
            return transforms.match_resolution(img, spec["resolution"][column], spec.get("target_resolution", 10), spec["height"], spec["width"], means)
        if name == "randomnoise":
            return transforms.noise(img, spec.get("std", 1e-2), spec.get("max_noise", 5e-2), seed + 2, key)
        if name == "blur":
            return transforms.gaussian_blur(img, spec.get("kernel", 3))
        if name == "randombrightness":
            return transforms.brightness(img, spec["val"])
        if name == "randomcontrast":
            return transforms.contrast(img, spec["val"])
        raise ValueError(f"unknown transform {name}")

    def apply(df: DataFrame) -> DataFrame:
        return df.withColumns({c: gated(F.col(c), change(F.col(c), c), p, seed, key) for c in inputs})

    return apply


def assemble(samples: DataFrame, chain: Sequence[Step], env: Sequence[str] = (), sat: str = "sat") -> DataFrame:
    """Run the steps, then append the environmental inputs to the satellite channels."""
    for step in chain:
        samples = samples.transform(step)
    if env:
        samples = samples.withColumn(sat, transforms.stack(F.col(sat), *[F.col(e) for e in env]))
    return samples
