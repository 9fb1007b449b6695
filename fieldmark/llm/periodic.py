"""Runs (maximal periodic stretches of words) of each text by a dictionary of basic factors.

Level k of the dictionary numbers the factors of m = 2 ** k words, equal factors alike; level k + 1 comes from pairs of
numbers of level k. A run of period p, m <= p < 2 m, begins with a factor that comes again p words later. Occurrences of one
factor at most m / 2 apart form an arithmetic progression; inside a progression every occurrence but the first follows the same
word, so only pairs with the head of a progression can begin a run. Such pairs propose periods; two numbers of the same
level tell whether a whole period agrees, then the stretch is extended word by word and equal stretches keep the smallest period.

Texts are worked on whole, one row at a time as far as results go, so nothing is shuffled; memory is some arrays of the
number of words of one text, or of about a megabyte of short texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions.arrays import let
from fieldmark.llm import tokens
from fieldmark.llm.common import WORD, table

#: A run has at least this many words (and twice its period).
LEAST = 12
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _number(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key, how often the key of that number occurs)."""
    _, number, n = np.unique(keys, return_inverse=True, return_counts=True)
    return number.astype(np.int64), n


def _pairs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for every whole number value in [low[row], high[row])."""
    many = np.maximum(high - low, 0)
    row = np.repeat(np.arange(len(low)), many)
    return row, np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + low[row]


def _proposed(at: np.ndarray, number: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): places of equal factors of ``m`` words, m <= y - x < 2 m, one of them the head of a progression.

    ``at`` ascends inside each number, equal numbers are neighbours.
    """
    near = np.r_[False, (number[1:] == number[:-1]) & (2 * (at[1:] - at[:-1]) <= m)]
    head = np.flatnonzero(~near)
    # one ascending key over (number, place); a gap of 2 m keeps look-ups inside a number
    width = int(at.max()) + 4 * m + 4
    key = number * width + at + 2 * m
    row, other = _pairs(np.searchsorted(key, key[head] + m), np.searchsorted(key, key[head] + 2 * m))
    left = head[row]
    x, y = [at[left]], [at[other]]
    row, before = _pairs(np.searchsorted(key, key[head] - 2 * m, "right"), np.searchsorted(key, key[head] - m, "right"))
    right = head[row]
    only = near[before]  # heads were paired above
    x.append(at[before[only]])
    y.append(at[right[only]])
    x, y = np.concatenate(x), np.concatenate(y)
    return x, y


def _extent(words: np.ndarray, x: int, y: int, stop: int) -> int:
    """End of the stretch around x and y in which words y - x apart are equal; it holds at least up to ``y``."""
    step = 64
    while y < stop:
        size = min(step, stop - y)
        other = np.flatnonzero(words[x:x + size] != words[y:y + size])
        if len(other):
            return y + int(other[0])
        x, y, step = x + size, y + size, step * 4
    return stop


def runs_of(words: np.ndarray, text: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run of the words of some texts, ascending; ``text`` numbers the text of each word."""
    n = len(words)
    none = np.zeros(0, dtype=np.int64)
    if n < least:
        return none, none, none
    stops = np.searchsorted(text, text, "right")
    starts = np.searchsorted(text, text, "left")
    # factors of different texts are different
    number, count = _number(tokens.mix(words + tokens.mix(text.astype(np.uint64) + np.uint64(1))))
    level = np.where(count[number] > 1, number, -1)  # -1: occurs once in its text, so nothing longer there comes again
    found = []
    m = 1
    while True:
        alive = np.flatnonzero(level >= 0)
        if not len(alive):
            break
        order = alive[np.argsort(level[alive], kind="stable")]
        x, y = _proposed(order, level[order], m)
        p = y - x
        # nothing to the left agrees, and a whole period does: the last m of its words have the same number, too
        ok = (x == starts[x]) | (words[x - 1] != words[y - 1])
        ok &= y + p <= stops[y]
        x, y, p = x[ok], y[ok], p[ok]
        ok = (level[y - m] == level[y - m + p]) & (level[y - m] >= 0)
        ok &= x + np.maximum(least, 2 * p) <= stops[x]
        x, y, p = x[ok], y[ok], p[ok]
        for j in range(1, max(0, least - m)):  # short periods need more than two of them
            if not len(x):
                break
            more = j + p < least
            ok = ~more | (words[np.minimum(x + j, n - 1)] == words[np.minimum(y + j, n - 1)])
            x, y, p = x[ok], y[ok], p[ok]
        end = np.array([_extent(words, int(b), int(b + q), int(s)) for b, q, s in zip(x + p, p, stops[x])], dtype=np.int64)
        found.append((x, end, p))
        # the next level: pairs of factors side by side, both of which come again
        here = alive[alive + 2 * m <= n]
        here = here[(level[here + m] >= 0) & (text[here] == text[here + 2 * m - 1])]
        following = np.full(n, -1, dtype=np.int64)
        if len(here):
            number, count = _number(level[here] * np.int64(n) + level[here + m])
            following[here] = np.where(count[number] > 1, number, -1)
        level, m = following, 2 * m
    if not found:
        return none, none, none
    start, end, period = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    fresh = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][:len(start)]
    start, end, period = start[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _collapsed(found: tokens.Words, gone: np.ndarray) -> list[str]:
    """Digest of the words left of each text, joined by one space."""
    out = []
    for first, stop in zip(found.first[:-1], found.first[1:]):
        digest = hashlib.sha256()
        kept = np.flatnonzero(~gone[first:stop]) + first
        # neighbours that stand one blank apart are one stretch of bytes
        cut = np.flatnonzero((np.diff(kept) != 1) | (found.start[kept[1:]] != found.end[kept[:-1]] + 1) | (found.data[found.end[kept[:-1]]] != 32)) if len(kept) > 1 else []
        edge = np.r_[0, np.asarray(cut, dtype=np.int64) + 1, len(kept)]
        for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
            if b > a:
                digest.update((b" " if k else b"") + found.data[found.start[kept[a]]:found.end[kept[b - 1]]].tobytes())
        out.append(digest.hexdigest())
    return out


def _find(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for found in tokens.words(batch.column("text"), lower=False):
            text = found.text_of()
            start, end, period = runs_of(found.hash, text, least)
            step = np.zeros(len(found.hash) + 1, dtype=np.int64)
            np.add.at(step, start + period, 1)
            np.add.at(step, end, -1)
            gone = np.cumsum(step[:-1]) > 0
            texts = found.stop - found.begin
            owner = text[start] if len(start) else start
            counts = np.bincount(owner, minlength=texts).astype(np.int64)
            offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(start - found.first[owner]), pa.array(end - start), pa.array(period)], fields=list(_RUN))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").slice(found.begin, texts), pa.array(found.counts()), pa.ListArray.from_arrays(pa.array(offsets), values),
                 pa.array(_collapsed(found, gone), pa.string())],
                ["key", "n_words", "runs", "collapsed_sha256"])


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row for each row of ``df``: the id, ``n_words``, ``runs`` (start, length, period; by start, then period), ``collapsed_sha256``.

    A run is a stretch of words with smallest period q and a length of at least ``least`` words and 2 q that can't be extended.
    ``collapsed_sha256`` is of the text left when each run keeps only its first period. Words are compared as 64-bit hashes of
    their bytes, case kept. Null and blank texts have no words and no runs; repeated rows and ids stay, null ids too; an empty table
    gives no rows; other columns are left out, whatever their names.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    shape = f"key {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed_sha256 string"
    return rows.mapInArrow(lambda batches: _find(batches, least), shape).withColumnRenamed("key", id_col)


def longest(runs: Column) -> Column:
    """The run with the greatest length; ties go to the smallest start, then the smallest period. Null if there is none."""
    ranked = F.transform(runs, lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    return F.array_max(ranked)


def planted(doc_id: Column, text: Column) -> Column:
    """``text`` with a tail made periodic where crc32 of the id as text is divisible by 10; rows without an id are left alone."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        bound = F.struct(words.alias("words"), a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p"))
        places = F.filter(F.sequence(F.lit(0).cast("bigint"), n), lambda i: i < n)
        return let(bound, lambda v: F.transform(places, lambda i: F.get(
            v["words"], F.when(i < v["a"], i).otherwise(v["a"] + F.pmod(i - v["a"], v["p"])).cast("int"))))

    changed = F.array_join(let(F.regexp_extract_all(text, F.lit(WORD), 0), tail), " ")
    return F.when(h % 10 == 0, changed).otherwise(text)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(docs).withColumn("best", longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("CASE WHEN best IS NOT NULL THEN 1000 * best.length DIV -best.period END").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256")


QUERIES = {"op13_periodic": op13}
ORACLE: dict[str, str] = {}
