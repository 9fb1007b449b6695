"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass one sets, for every row, three bits in one 64-bit word of a register-blocked Bloom filter and keeps the bits that were
set twice. Pass two probes each row: a row with one of its bits missing has no equal and passes straight through; only
the remaining, possibly repeated rows are shuffled by content and grouped exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm.common import ascii_lower, if_small, look_up, materialize, table, without

#: Bits of the filter for each row.
BITS_PER_ROW = 16


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _raw, _sha, _hash) of every row; null text counts as empty, ``_raw`` hashes the text as it is."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_raw"), ascii_lower(text).alias("_norm"))
    return rows.select("_id", "_raw", F.sha2("_norm", 256).alias("_sha"), F.xxhash64("_norm").alias("_hash"))


def _word(words: int) -> Column:
    return F.pmod(F.col("_hash"), F.lit(words))


def _bits() -> list[Column]:
    high = F.xxhash64("_hash")
    return [F.shiftrightunsigned(high, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(3)]


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)


def bloom_of_repeats(narrow: DataFrame, words: int) -> DataFrame:
    """(_word, _set): words of the filter with the bits that more than one row set."""
    bits = narrow.select(_word(words).alias("_word"), F.explode(F.array_distinct(F.array(*_bits()))).alias("_bit"))
    twice = bits.groupBy("_word", "_bit").agg(F.count("*").alias("_n")).filter("_n > 1")
    return twice.groupBy("_word").agg(F.bit_or(_one(F.col("_bit"))).alias("_set"))


def decisions(narrow: DataFrame) -> DataFrame:
    """Adds keep_id, group_size and kept to the written table ``narrow`` of :func:`fingerprints`.

    The row with the largest id stays; a null id loses to any other and a group of null ids keeps a null. Rows that
    repeat both id and text are counted separately and are kept or dropped together. An empty table gives no rows.
    """
    total = narrow.count()
    words = max(1024, total * BITS_PER_ROW // 64)
    bloom = materialize(bloom_of_repeats(narrow, words), "bloom")
    mask = _one(_bits()[0]).bitwiseOR(_one(_bits()[1])).bitwiseOR(_one(_bits()[2]))
    probed = narrow.withColumn("_word", _word(words)).join(if_small(bloom, 40), "_word", "left")
    probed = probed.select(*narrow.columns, F.coalesce(F.col("_set").bitwiseAND(mask) == mask, F.lit(False)).alias("_maybe"))
    once = probed.filter("NOT _maybe").select(*narrow.columns, F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    maybe = probed.filter("_maybe").select(*narrow.columns)
    groups = materialize(maybe.groupBy("_sha").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    found = look_up(maybe, groups, "_sha", "group_size", total, F.xxhash64("_id", "_hash"))
    return once.unionByName(found).withColumn("kept", F.col("_id").eqNullSafe(F.col("keep_id")))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: the id column, keep_id, group_size, kept, text_sha256 (see :func:`decisions`)."""
    narrow = materialize(fingerprints(df, id_col, text_col), "fingerprints")
    return decisions(narrow).select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that :func:`decisions` keeps, with all their columns, whatever their names.

    Null text counts as empty; rows that repeat both id and text stay or go together; of texts without any id all rows stay; an
    empty table stays empty.
    """
    narrow = materialize(fingerprints(df, id_col, text_col), "fingerprints")
    return without(df, decisions(narrow).filter("NOT kept").select("_id", "_raw"), id_col, text_col)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_exact_dedup": op6}
ORACLE = {"op6_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""}
