"""Substring deduplication with prefix-partitioned suffix trees over words.

Every window of 20 words has an anchor, the smallest hash among its 8-word runs, so equal windows have equal anchors. Anchors
that occur once can't begin a repeat. The others are the prefixes by which suffixes are split: the suffixes around one prefix
form a subtree, and prefixes are packed into groups of a bounded number of suffixes. Sorting the suffixes of a group
lays out its subtree; nodes at a depth of 20 words with more than one suffix are the repeats. A prefix that is too frequent
for one group is lengthened to the whole window, where the node is known by its hash and only its first suffix is sought.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import tokens
from fieldmark.llm.common import BROADCAST_BYTES, if_small, look_up, materialize, table

#: Words of a window, of an anchor, and the most windows that share one anchor.
WINDOW, ANCHOR = 20, 8
SPAN = WINDOW - ANCHOR + 1
#: Anchors in one group of suffixes, about; a prefix that occurs more often is lengthened.
GROUP = 20_000
_KEPT = "h bigint, n bigint"


def _anchors(found: tokens.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, word at which its anchor begins, hash of the anchor)."""
    starts, _ = tokens.windows(found, WINDOW)
    if not len(starts):
        return starts, starts, np.zeros(0, dtype=np.uint64)
    at, run = tokens.windows(found, ANCHOR)
    runs = np.full(len(found.hash) + SPAN, np.iinfo(np.uint64).max, dtype=np.uint64)
    runs[at] = run
    offset = np.lib.stride_tricks.sliding_window_view(runs, SPAN)[starts].argmin(axis=1)
    return starts, starts + offset, runs[starts + offset]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for found in tokens.words(batch.column("_text"), lower=False):
            _, place, h = _anchors(found)
            parts.append(h[np.r_[True, place[1:] != place[:-1]]] if len(h) else h)
        h, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([tokens.signed(h), pa.array(n, pa.int64())], ["h", "n"])


def _suffixes(batches: Iterator[pa.RecordBatch], repeated: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(h, doc, sub, place, ahead, words): each anchor that may be repeated, with the words of all its windows.

    The first window begins ``ahead`` words before the anchor; words are cut to 32 bits, so equal windows differ in none of
    20 such numbers.
    """
    for batch in batches:
        doc, sub = batch.column("_doc").to_numpy(), batch.column("_sub").to_numpy()
        for found in tokens.words(batch.column("_text"), lower=False):
            starts, place, h = _anchors(found)
            if repeated is not None and len(h):
                spot = np.minimum(np.searchsorted(repeated, h), max(len(repeated) - 1, 0))
                use = repeated[spot] == h if len(repeated) else np.zeros(len(h), dtype=bool)
                starts, place, h = starts[use], place[use], h[use]
            if not len(h):
                continue
            # windows with one anchor follow one another
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            last = np.r_[first[1:], len(place)] - 1
            lengths = starts[last] - starts[first] + WINDOW
            where = np.repeat(starts[first] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
            text = found.text_of()[starts[first]]
            yield pa.RecordBatch.from_arrays(
                [tokens.signed(h[first]), pa.array(doc[found.begin + text]), pa.array(sub[found.begin + text]), pa.array((place[first] - found.first[text]).astype(np.int64)),
                 pa.array((place[first] - starts[first]).astype(np.int32)),
                 tokens.lists((found.hash[where] >> np.uint64(32)).astype(np.uint32).view(np.int32), lengths)],
                ["h", "doc", "sub", "place", "ahead", "words"])


def _windows_of(group: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset of the window in the row, the windows as a matrix of words)."""
    items = group.column("words")
    items = items.combine_chunks() if isinstance(items, pa.ChunkedArray) else items
    flat, lengths = items.flatten().to_numpy(), np.diff(items.offsets.to_numpy())
    begin = np.r_[0, np.cumsum(lengths)[:-1]]
    many = lengths - WINDOW + 1
    row = np.repeat(np.arange(len(lengths)), many)
    offset = np.arange(many.sum()) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many)
    return row, offset, flat[(begin[row] + offset)[:, None] + np.arange(WINDOW)]


def _repeats(group: pa.Table) -> pa.Table:
    """(doc, sub, place, ahead, later): bit k of ``later`` says that the row's window k also begins earlier.

    Sorted suffixes lay out the subtree of the group; the depth of the node that joins two neighbours is the number of words
    they share. Members of nodes of full depth are told in the order of documents and places, the first of each stays.
    """
    row, offset, words = _windows_of(group)
    doc, sub, place, ahead = (group.column(c).to_numpy() for c in ("doc", "sub", "place", "ahead"))
    start = place[row] - ahead[row] + offset
    order = np.lexsort((start, sub[row], doc[row], *words.T[::-1]))
    same = (words[order[1:]] == words[order[:-1]]).all(axis=1)  # the node is WINDOW deep
    head = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(order)), 0))
    first = order[head]
    earlier = (doc[row[first]] != doc[row[order]]) | (sub[row[first]] != sub[row[order]]) | (start[first] != start[order])
    hit = order[earlier]
    later = np.zeros(len(doc), dtype=np.int64)
    np.bitwise_or.at(later, row[hit], np.int64(1) << offset[hit])
    some = np.flatnonzero(later)
    return pa.table({"doc": doc[some], "sub": sub[some], "place": place[some], "ahead": pa.array(ahead[some], pa.int32()), "later": later[some]})


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, doc, sub, start) of every window of frequent prefixes; a node is the hash of the whole window."""
    for batch in batches:
        if not batch.num_rows:
            continue
        row, offset, words = _windows_of(batch)
        doc, sub, place, ahead = (batch.column(c).to_numpy() for c in ("doc", "sub", "place", "ahead"))
        node = np.zeros(len(row), dtype=np.uint64)
        for k in range(WINDOW):
            node = tokens.mix(node + words[:, k].view(np.uint32).astype(np.uint64) + np.uint64(k + 1))
        yield pa.RecordBatch.from_arrays([tokens.signed(node), pa.array(doc[row]), pa.array(sub[row]), pa.array(place[row] - ahead[row] + offset)], ["node", "doc", "sub", "start"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = batch.column("marks").to_pylist()
        total, gone, digest = [], [], []
        for found in tokens.words(batch.column("_text"), lower=False):
            step = np.zeros(len(found.hash) + 1, dtype=np.int64)
            for k in range(found.begin, found.stop):
                base = int(found.first[k - found.begin])
                for m in marks[k] or ():
                    bits = m["later"]
                    while bits:
                        low = bits & -bits
                        at = base + m["start"] + low.bit_length() - 1
                        step[at] += 1
                        step[at + WINDOW] -= 1
                        bits ^= low
            covered = np.cumsum(step[:-1]) > 0
            total.append(found.counts())
            sums = np.r_[0, np.cumsum(covered)]
            gone.append(sums[found.first[1:]] - sums[found.first[:-1]])
            # each kept word and the blank after it, if its text goes on
            ends = _text_ends(batch.column("_text"), found)
            edge = np.zeros(len(found.data) + 2, dtype=np.int32)
            kept = ~covered
            np.add.at(edge, found.start[kept], 1)
            np.add.at(edge, np.minimum(found.end + 1, ends[found.text_of() + 1])[kept], -1)
            keep = np.cumsum(edge[:len(found.data)]) > 0
            plain = np.where((found.data == 32) | ((found.data >= 9) & (found.data <= 13)), np.uint8(32), found.data)
            for low, high in zip(ends[:-1], ends[1:]):
                digest.append(hashlib.sha256(plain[low:high][keep[low:high]].tobytes().rstrip(b" ")).hexdigest())
        counts = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (total, gone)]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(counts[0]), pa.array(counts[1]), pa.array(digest, pa.string())],
                                         ["_id", "n_words", "n_removed", "kept_sha256"])


def _text_ends(column: pa.Array, found: tokens.Words) -> np.ndarray:
    _, offsets = tokens.column_bytes(column)
    own = offsets[found.begin:found.stop + 1]
    return own - own[0]


def find_repeats(texts: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc, sub, start, later): bit k of ``later`` marks the window at start + k as one that begins earlier, too."""
    spark = texts.sparkSession
    counts = texts.select("_text").mapInArrow(_count, _KEPT).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    repeated = materialize(counts, "prefixes")
    n, total = repeated.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shape = "h bigint, doc bigint, sub bigint, place bigint, ahead int, words array<int>"
    if n * 8 <= BROADCAST_BYTES:
        held = np.sort(repeated.select("h").toArrow().column(0).to_numpy().view(np.uint64))
        shared = spark.sparkContext.broadcast(held)
        rows = texts.mapInArrow(lambda batches: _suffixes(batches, shared.value), shape)
    else:
        rows = texts.mapInArrow(lambda batches: _suffixes(batches, None), shape).join(repeated.select("h"), "h", "left_semi")
    hot = materialize(repeated.filter(F.col("n") > group).select("h"), "long-prefixes")
    subtree = F.pmod(F.xxhash64("h"), F.lit(max(1, int(total) // group)))
    out = "doc bigint, sub bigint, place bigint, ahead int, later bigint"
    few = hot.count()
    usual = rows.join(if_small(hot, 16), "h", "left_anti") if few else rows
    marks = usual.withColumn("subtree", subtree).groupBy("subtree").applyInArrow(lambda t: _repeats(t.drop_columns(["subtree"])), out)
    marks = marks.select("doc", "sub", (F.col("place") - F.col("ahead")).alias("start"), "later")
    if few:
        nodes = rows.join(if_small(hot, 16), "h", "left_semi").mapInArrow(_nodes, "node bigint, doc bigint, sub bigint, start bigint")
        first = nodes.groupBy("node").agg(F.min(F.struct("doc", "sub", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        first = materialize(first, "first")
        # a passage may stand in very many texts, so its node is looked up, not joined
        found = look_up(nodes, first, "node", "n", int(total), F.xxhash64("doc", "sub"))
        later = found.filter(F.struct("doc", "sub", "start") != F.col("first"))
        marks = marks.unionByName(later.select("doc", "sub", "start", F.lit(1).cast("bigint").alias("later")))
    return marks


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row for each row of ``df``: id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space).

    A word goes when a window of 20 words around it also begins earlier: in a smaller id, or earlier in the same text. Null and
    short texts lose nothing; ids are whole numbers, null comes before all. Rows that share an id, or have none, but not the
    text are documents of their own, ordered by a hash of the text; rows that repeat both are one document, of which each
    row loses the same. An empty table gives no rows.
    """
    own = [F.coalesce(F.col(id_col), F.lit(-(1 << 63))).alias("_doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_sub"), F.col(text_col).alias("_text")]
    marks = materialize(find_repeats(df.select(*own), group), "marks")
    per_doc = marks.groupBy("doc", "sub").agg(F.collect_set(F.struct("start", "later")).alias("marks"))  # bounded by the text
    rows = df.select(F.col(id_col).alias("_id"), *own)
    joined = rows.join(per_doc, (F.col("_doc") == F.col("doc")) & (F.col("_sub") == F.col("sub")), "left").select("_id", "_text", "marks")
    kind = df.schema[id_col].dataType.simpleString()
    done = joined.mapInArrow(_finish, f"_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")
    return done.withColumnRenamed("_id", id_col)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op5_substring_dedup": op5}
ORACLE: dict[str, str] = {}
