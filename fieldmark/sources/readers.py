"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark import schemas
from fieldmark.functions import time


def observations(spark: SparkSession, path: str, schema=schemas.OBSERVATION) -> DataFrame:
    """Tab-separated observation log with a header line and ISO dates; NaN is read as missing."""
    return schemas.null_for_nan(spark.read.schema(schema).options(sep="\t", header=True, dateFormat="yyyy-MM-dd").csv(path))


def checklists(spark: SparkSession, path: str) -> DataFrame:
    return observations(spark, path, schemas.CHECKLIST)


def occurrences(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated occurrence records, one row per record."""
    return observations(spark, path, schemas.OCCURRENCE)


def species_list(spark: SparkSession, path: str) -> DataFrame:
    """(species_idx, species) from a text file, one name per line; line order is the index, blank lines are dropped.

    A list has one line per taxon and fits one split; ``wholetext`` keeps its line order in a single row.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("species_idx", "species"))
    return lines.filter(F.col("species") != "")


def targets_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per hotspot; NaN is read as missing."""
    return schemas.null_for_nan(spark.read.schema(schemas.TARGET).json(path))


def parse_target(text: Column) -> Column:
    return F.from_json(text, schemas.TARGET)


def array_files(spark: SparkSession, path: str, glob: str = "*.npy") -> DataFrame:
    """(hotspot_id, bands, h, w, data) from array files named after their hotspot.

    Spark lists and splits the files; only the decoding of one file's bytes runs in Python, batch by batch.
    """

    def decode(batches):
        import io

        import numpy as np
        import pandas as pd

        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"]):
                a = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                a = a.reshape((1,) * (3 - a.ndim) + a.shape)
                name = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                rows.append((name, *a.shape, [None if np.isnan(v) else float(v) for v in a.ravel()]))
            yield pd.DataFrame(rows, columns=["hotspot_id", "bands", "h", "w", "data"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(decode, "hotspot_id string, bands int, h int, w int, data array<double>")


def wkt_ring(text: Column) -> Column:
    """ARRAY<STRUCT<lon, lat>> of the outer ring of a WKT polygon."""
    inner = F.regexp_extract(text, r"POLYGON\s*\(\(([^)]*)\)", 1)
    return F.transform(F.split(F.trim(inner), r"\s*,\s*"), lambda p: F.struct(
        F.get(F.split(p, r"\s+"), 0).cast("double").alias("lon"), F.get(F.split(p, r"\s+"), 1).cast("double").alias("lat")))


def named_group(name: Column, pattern: str, group: int = 1) -> Column:
    """Part of a file name matched by a regular expression, NULL when there is no match."""
    found = F.regexp_extract(name, pattern, group)
    return F.when(found != "", found)




def dated_files(rows: DataFrame, pattern: str, date_format: str) -> DataFrame:
    """``rows`` of a file source with ``mint`` and ``maxt`` of the date in their file's path.

    The path comes from the source's hidden metadata column. ``pattern`` has a group named ``date``; rows of files that don't match
    are left out.
    """
    before = pattern[:pattern.index("(?<date>")]
    group = 1 + before.count("(") - before.count("(?") - before.count("\\(")
    date = named_group(F.col("_metadata.file_path"), pattern, group)
    dated = rows.select("*", time.interval_of(date, date_format).alias("_interval"))
    return dated.filter(F.col("_interval").isNotNull()).select(*rows.columns, "_interval.mint", "_interval.maxt")
