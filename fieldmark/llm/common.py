"""Helpers shared by the text operators: inputs, ASCII lower-casing, size-checked broadcasts, hot-key look-ups."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.session import materialize

#: A side of a join is broadcast only below this measured size; above it the join is shuffled.
BROADCAST_BYTES = 32 << 20
#: A key is hot when it holds more than one row in HOT_SHARE; there are at most HOT_SHARE such keys.
HOT_SHARE = 2000
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is several times faster than ``translate`` and does the same on ASCII text."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a written table for broadcasting when its measured rows fit; else leave the join to be shuffled."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def look_up(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """Left-join the written table ``groups`` (one row a key, with its row count ``size``) to ``rows``.

    Hot keys, of which there are fewer than ``HOT_SHARE``, are broadcast; their rows then get a null-safe spread key, so
    that no shuffled key holds more than one row in ``HOT_SHARE`` of the rows.
    """
    values = [c for c in groups.columns if c != key]
    limit = max(total // HOT_SHARE, 100)
    hot = groups.filter(F.col(size) > limit).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    cold = groups.filter(F.col(size) <= limit).select(F.col(key).cast("string").alias("_cold"), *[F.col(c).alias(f"_cold_{c}") for c in values])
    tagged = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    tagged = tagged.withColumn("_at", F.when(F.col("_hot").isNull(), F.col(key).cast("string")).otherwise(F.concat(F.lit("*"), spread.cast("string"))))
    found = tagged.join(cold, F.col("_at") == F.col("_cold"), "left")
    return found.select(*rows.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in values])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` but those whose id and text are in ``gone`` (id, hash of the text); columns of ``df`` may have any name.

    Rows without an id, or that share one, are told apart by their text. Texts aren't moved unless ``gone`` is too large to
    broadcast.
    """
    own_id, own_raw = fresh(df, "gone_id"), fresh(df, "gone_raw")
    listed = materialize(gone.toDF(own_id, own_raw).distinct(), "gone")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (text_hash(F.col(f"`{text_col}`")) == F.col(own_raw))
    return df.join(if_small(listed, 24), same, "left_anti")


def text_hash(text: Column) -> Column:
    """Hash of a text as it is; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


__all__ = ["BROADCAST_BYTES", "SPACE", "WORD", "ascii_lower", "fresh", "if_small", "look_up", "materialize", "table", "text_hash", "without"]
