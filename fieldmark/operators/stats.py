"""Normalization statistics.

Images are reduced inside the row to one number per band; only those numbers are aggregated. Deviations use a second
pass around the global mean, which is numerically safer than one pass over squares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions import arrays, transforms


def band_means(images: DataFrame, crop: int | None, img: str = "img") -> DataFrame:
    """(band, mean): mean over images of each image's mean of its centre crop."""
    source = transforms.center_crop_half(F.col(img), crop) if crop else F.col(img)
    per_image = images.select(source.alias("i")).select(arrays.unrolled(arrays.per_band(F.col("i"), arrays.mean), "band", "m"))
    return per_image.groupBy("band").agg(F.avg("m").alias("mean"))


def vector_of(table: DataFrame, index: str, value: str) -> Column:
    """A small (index, value) table as one scalar array in index order."""
    pairs = F.sort_array(F.collect_list(F.struct(index, value)))
    return table.agg(F.transform(pairs, lambda s: s[value]).alias("v")).select("v").scalar()


def band_deviations(images: DataFrame, means: Column, crop: int | None, divisor: int | None = None, img: str = "img") -> DataFrame:
    """(band, std): root of the mean over images of sum((x - mean)^2) / divisor, gaps skipped.

    ``divisor`` defaults to the number of pixels of the crop.
    """
    source = transforms.center_crop_half(F.col(img), crop) if crop else F.col(img)
    rows = images.select(source.alias("i"), means.alias("mu"))

    def spread(i: Column, b: Column) -> Column:
        mu = arrays.at(F.col("mu"), b)
        squares = arrays.let(mu, lambda m: F.transform(arrays.band_slice(i, b), lambda v: (v - m) * (v - m)))
        return arrays.total(squares) / (F.lit(divisor) if divisor else i["h"] * i["w"])

    spreads = arrays.let(F.col("i"), lambda i: F.transform(F.sequence(F.lit(0), i["bands"] - 1), lambda b: spread(i, b)))
    per_image = rows.select(arrays.unrolled(spreads, "band", "s"))
    return per_image.groupBy("band").agg(F.sqrt(F.avg("s")).alias("std"))


def band_stats(images: DataFrame, crop: int | None, divisor: int | None = None, img: str = "img") -> DataFrame:
    means = band_means(images, crop, img)
    stds = band_deviations(images, vector_of(means, "band", "mean"), crop, divisor, img)
    return means.join(stds, "band")


def point_stats(points: DataFrame, vector: str) -> DataFrame:
    """(layer, mean, std): gap-skipping mean and population deviation."""
    return points.select(arrays.unrolled(vector, "layer", "v")).groupBy("layer").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def pixel_stats(images: DataFrame, img: str = "img") -> DataFrame:
    """(pos, mean, std) of every pixel position over all images; partial rows are bounded by the image size."""
    return images.select(arrays.unrolled(F.col(img)["data"], "pos", "v")).groupBy("pos").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
