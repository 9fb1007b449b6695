"""Similarity join of word-shingle sets by vertical partitioning.

Shingles have one global order: those in many texts last, the rest by hash. The order is cut into fragments. Fragment
zero of a set is its prefix in that order, which two similar sets must share a shingle of; partial overlaps are counted
fragment by fragment and summed per pair. Texts with the same set form one class. A class is compared with the hub of each
prefix shingle it has, not with all others that have it; later rounds compare only what the links found so far leave open.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.llm import tokens
from fieldmark.llm.common import BROADCAST_BYTES, if_small, look_up, materialize, table, text_hash, without
from fieldmark.operators.spatial import connected_components
from fieldmark.session import settings

#: Words of a shingle.
SHINGLE = 5
#: Fragments of the global order beside the prefix.
FRAGMENTS = 4
#: A shingle goes to the end of the order if this share of all prefix entries are its own (and at least COMMON_LEAST);
#: at most 1 / COMMON_SHARE shingles do, whatever the corpus.
COMMON_SHARE = 2.5e-7
COMMON_LEAST = 8
#: The same of all shingles of all texts, in the prefix or not: this share of them, and so many texts at least.
COMMON_TEXTS = 64
#: Bytes of shingles that a task counts at once.
COUNT_BYTES = 32 << 20
#: Members of a shingle, of its largest component and of the others, that are compared with all outside their component in
#: the first round after the hubs; each further round takes four times as many.
PIVOTS = 4
#: Shingles and classes of one side of a block of a crowd, about; a block takes some tens of MB.
BLOCK, BLOCK_CLASSES = 500_000, 2_000
#: Shingles that a task holds before it hands them on.
HELD = 1 << 20
#: Bytes of texts that a Python task is handed at once.
ARROW_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
_LAST = np.uint64(1 << 62)


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle numbers below 2 ** 62) of every text with words."""
    for found in tokens.words(column):
        at, shingle = tokens.windows(found, SHINGLE)
        bounds = np.searchsorted(at, found.first)
        counts = found.counts()
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        whole = tokens._spans(found.hash, found.first[short], found.first[short + 1]) if len(short) else None
        k = 0
        for row in np.flatnonzero(counts).tolist():
            if counts[row] < SHINGLE:
                own = whole[k:k + 1]
                k += 1
            else:
                own = shingle[bounds[row]:bounds[row + 1]]
            yield found.begin + row, np.unique(own >> np.uint64(2))


def _signature(own: np.ndarray) -> np.uint64:
    return tokens.mix(np.array([tokens.mix(own).sum() + np.uint64(len(own))], dtype=np.uint64))[0]


def _prefix(own: np.ndarray) -> np.ndarray:
    """First entries of a set in the global order; a similar set has one of them in its own prefix."""
    return own[:len(own) - (4 * len(own) + 4) // 5 + 1]


def _common(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which members of ``own`` are in the sorted array ``common``."""
    if not len(common):
        return np.zeros(len(own), dtype=bool)
    return common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = len(batch)
        n, sig = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.uint64)
        prefix: list[np.ndarray] = []
        lengths = np.zeros(rows, dtype=np.int64)
        for row, own in _sets(batch.column("_text")):
            n[row], sig[row] = len(own), _signature(own)
            prefix.append(_prefix(own))
            lengths[row] = len(prefix[-1])
        flat = np.concatenate(prefix) if prefix else np.zeros(0, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_raw"), pa.array(n), tokens.signed(sig), tokens.lists(flat, lengths)], ["_id", "_raw", "n", "sig", "prefix"])


def _counted(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Shingles of all texts by their first ``bits`` bits, packed: those met once so far, those met more often and how often."""

    def packed(kept: list[np.ndarray]) -> pa.RecordBatch:
        h, k = np.unique(np.concatenate(kept), return_counts=True)
        cuts = np.searchsorted(h, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(62 - bits))
        rows = [(b, x[n == 1].tobytes(), x[n > 1].tobytes(), n[n > 1].tobytes()) for b, (x, n) in enumerate(zip(np.split(h, cuts), np.split(k, cuts))) if len(x)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 3))], ["bucket", "once", "more", "k"])

    kept, held = [], 0
    for batch in batches:
        for _, own in _sets(batch.column("_text")):
            kept.append(own)
            held += len(own)
            if held > HELD:
                yield packed(kept)
                kept, held = [], 0
    if kept:
        yield packed(kept)


def _frequent(group: pa.Table, limit: int) -> pa.Table:
    """Shingles of a bucket that ``limit`` texts have."""
    once, more, k = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("once", np.uint64), ("more", np.uint64), ("k", np.int64)))
    h, place = np.unique(np.concatenate([once, more]), return_inverse=True)
    texts = np.bincount(place, np.concatenate([np.ones(len(once), dtype=np.int64), k]), len(h))
    return pa.table({"h": tokens.signed(h[texts >= limit])})


def _common_shingles(texts: DataFrame, classes: DataFrame, total: int) -> np.ndarray:
    """Shingles that go last, sorted: 2 / COMMON_SHARE at most, whatever the corpus. All texts together have ``total`` shingles.

    Counts are complete, those of prefixes and those of all shingles; the latter travel packed, in buckets of bounded size.
    """
    prefixes = classes.select(F.explode("prefix").alias("h"), F.lit(1).cast("bigint").alias("k"))
    limit = max(COMMON_LEAST, int(COMMON_SHARE * (prefixes.agg(F.sum("k")).first()[0] or 0)))
    found = [_unsigned(prefixes.groupBy("h").agg(F.sum("k").alias("k")).filter(F.col("k") >= limit).select("h"))]
    wide = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * total // COUNT_BYTES)
    bits, least = wide.bit_length(), max(COMMON_TEXTS, int(COMMON_SHARE * total))
    counted = texts.select("_text").mapInArrow(lambda batches: _counted(batches, bits), "bucket int, once binary, more binary, k binary")
    frequent = counted.groupBy("bucket").applyInArrow(lambda group: _frequent(group, least), "h bigint")
    found.append(_unsigned(materialize(frequent, "frequent")))
    return np.unique(np.concatenate(found))


def _unsigned(one: DataFrame) -> np.ndarray:
    """The single column of a bounded table, sorted."""
    return np.sort(one.toArrow().column(0).to_numpy().view(np.uint64))


def _ordered(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    return np.sort(np.where(_common(own, common), own | _LAST, own))


def _arrays(rows: list, names: list[str]) -> pa.RecordBatch:
    lengths = np.array([len(r[-1]) for r in rows], dtype=np.int64)
    flat = np.concatenate([r[-1] for r in rows]) if rows else np.zeros(0, dtype=np.uint64)
    columns = [pa.array([int(np.uint64(r[0]).view(np.int64)) for r in rows], pa.int64())]
    columns += [pa.array([r[k] for r in rows], pa.int32()) for k in range(1, len(names) - 1)]
    return pa.RecordBatch.from_arrays([*columns, tokens.lists(flat, lengths)], names)


def _reordered(texts: DataFrame, common) -> DataFrame:
    """(sig, common, prefix) of the texts whose prefix by hash holds a shingle that goes last; ``common`` counts all such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for _, own in _sets(batch.column("_text")):
                if _common(_prefix(own), common.value).any():
                    ordered = _ordered(own, common.value)
                    rows.append((_signature(own), int((ordered >= _LAST).sum()), _prefix(ordered)))
                    held += len(rows[-1][-1])
                    if held > HELD:
                        yield _arrays(rows, ["sig", "common", "prefix"])
                        rows, held = [], 0
            yield _arrays(rows, ["sig", "common", "prefix"])

    return texts.select("_text").mapInArrow(run, "sig bigint, common int, prefix array<bigint>")


def _fragments(texts: DataFrame) -> DataFrame:
    """(sig, fragment, items) of the texts; a task gives each class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows, held = [], 0
            for _, own in _sets(batch.column("_text")):
                sig = _signature(own)
                if int(sig) in seen:
                    continue
                seen.add(int(sig))
                held += len(own)
                if held > HELD:
                    yield _arrays(rows, ["sig", "fragment", "items"])
                    rows, held = [], len(own)
                cuts = np.searchsorted(own, np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64((1 << 62) // FRAGMENTS))
                rows += [(sig, k, part) for k, part in enumerate(np.split(own, cuts)) if len(part)]
            yield _arrays(rows, ["sig", "fragment", "items"])

    return texts.select("_text").mapInArrow(run, "sig bigint, fragment int, items array<bigint>")


def _similar(n_a: Column, n_b: Column, both: Column) -> Column:
    """80 % of the union is shared."""
    return 9 * both >= 4 * (n_a + n_b)


def _ahead(prefix: Column, last: Column) -> Column:
    return F.size(F.filter(prefix, lambda x: x <= last))


class _Join:
    """State of one join: texts, classes (sig, n, raw, prefix), fragments read so far and the pairs decided so far."""

    def __init__(self, texts: DataFrame, classes: DataFrame):
        self.texts, self.classes = texts, classes
        self.links: list[DataFrame] = []
        self.fragments: list[DataFrame] = []
        self.read: DataFrame | None = None
        self.decided: DataFrame | None = None

    def parts_of(self, ends: DataFrame) -> DataFrame:
        """(sig, fragment, items) of distinct classes (sig) and perhaps of others; only texts of classes not met before are tokenised."""
        fresh = ends if self.read is None else ends.join(self.read, "sig", "left_anti")
        fresh = materialize(fresh.select("sig").join(self.classes.select("sig", "raw"), "sig"), "pair-ends")
        n = fresh.count()
        if n or not self.fragments:
            wanted = if_small(fresh.select("raw"), 16) if n * 16 <= BROADCAST_BYTES else None
            if wanted is not None:
                parts = _fragments(self.texts.join(wanted, F.col("_raw") == F.col("raw"), "left_semi"))
            else:
                parts = _fragments(self.texts).join(fresh.select("sig"), "sig", "left_semi")
            self.fragments.append(materialize(parts.groupBy("sig", "fragment").agg(F.first("items").alias("items")), "fragments"))
            known = fresh.select("sig")
            self.read = known if self.read is None else materialize(self.read.unionByName(known), "read")
        return reduce(DataFrame.unionByName, self.fragments)

    def decide(self, pairs: DataFrame) -> None:
        """Find the links among written pairs (a, b, n_a, n_b), a < b."""
        ends = pairs.select("a", "b")
        self.decided = ends if self.decided is None else materialize(self.decided.unionByName(ends), "decided")
        a = self.classes.select(F.col("sig").alias("a"), F.col("prefix").alias("of_a"))
        b = self.classes.select(F.col("sig").alias("b"), F.col("prefix").alias("of_b"))
        first = pairs.join(a, "a").join(b, "b")
        last = F.least(F.element_at("of_a", -1), F.element_at("of_b", -1))
        apart = _ahead(F.col("of_a"), last) + _ahead(F.col("of_b"), last) - 2 * F.size(F.array_intersect("of_a", "of_b"))
        # what differs in fragment zero alone mustn't exceed what may differ in all
        open_ = materialize(first.filter(9 * apart <= F.col("n_a") + F.col("n_b")).select(*pairs.columns), "open-pairs")
        parts = self.parts_of(open_.select(F.col("a").alias("sig")).unionByName(open_.select(F.col("b").alias("sig"))).distinct())
        of_a = parts.select(F.col("sig").alias("a"), "fragment", F.col("items").alias("of_a"))
        of_b = parts.select(F.col("sig").alias("b"), "fragment", F.col("items").alias("of_b"))
        counted = open_.join(of_a, "a").join(of_b, ["b", "fragment"]).select(*pairs.columns, F.size(F.array_intersect("of_a", "of_b")).alias("part"))
        total = counted.groupBy(*pairs.columns).agg(F.sum("part").alias("both"))
        self.links.append(materialize(total.filter(_similar(F.col("n_a"), F.col("n_b"), F.col("both"))).select("a", "b"), "links"))

    def labels(self) -> DataFrame | None:
        """(sig, label) of classes with a link."""
        if not any(not x.isEmpty() for x in self.links):
            return None
        return connected_components(reduce(DataFrame.unionByName, self.links)).select(F.col("node").alias("sig"), "label")


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b, n_a, n_b), a < b, of rows (h, x, n_x, c_x, y, n_y, c_y), without pairs that can't link.

    Sizes may rule a link out. So may counts of common shingles, where the pair meets in one: a pair that shares a rarer one
    meets there as well, and any other shares common ones only.
    """
    swap = F.col("x") > F.col("y")
    may = (F.col("h") < F.lit(int(_LAST))) | _similar(F.col("n_x"), F.col("n_y"), F.least("c_x", "c_y"))
    ends = rows.filter("x <> y").filter(may).select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"),
        F.when(swap, F.col("n_y")).otherwise(F.col("n_x")).alias("n_a"), F.when(swap, F.col("n_x")).otherwise(F.col("n_y")).alias("n_b"))
    return ends.filter(5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b")).distinct()


def _compare(group: pa.Table) -> pa.Table:
    """Links between the left and the right block of a crowd, as far as they join components; one fragment at a time."""
    side, sig, n, label = (group.column(c).to_numpy() for c in ("side", "sig", "n", "label"))
    items = group.column("items").combine_chunks()
    flat = items.flatten().to_numpy()
    lengths = np.diff(items.offsets.to_numpy())
    ids, first, row = np.unique(sig * 2 + side, return_index=True, return_inverse=True)
    left, right = np.flatnonzero(side[first] == 0), np.flatnonzero(side[first] == 1)
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    place = np.zeros(len(ids), dtype=np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    owner = np.repeat(row, lengths)
    values, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    rank = np.full(len(values), -1)
    rank[shared] = np.arange(len(shared))
    column = rank[column]
    for start in range(0, len(shared), 2048):
        inside = (column >= start) & (column < start + 2048)
        a, b = np.zeros((len(left), 2048), dtype=np.float32), np.zeros((len(right), 2048), dtype=np.float32)
        for matrix, wanted in ((a, 0), (b, 1)):
            use = inside & (side[first][owner] == wanted)
            matrix[place[owner[use]], column[use] - start] = 1
        both += a @ b.T
    n_of, label_of, sig_of = n[first], label[first], sig[first]
    linked = 9 * both >= 4 * (n_of[left][:, None] + n_of[right][None, :])
    linked &= label_of[left][:, None] != label_of[right][None, :]
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked)):
        x, y = top(int(label_of[left[i]])), top(int(label_of[right[j]]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(sig_of[left[i]]), int(sig_of[right[j]])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _crowds(join: _Join, members: DataFrame, labels: DataFrame | None) -> DataFrame | None:
    """Links among the classes that share a hub in common shingles, written; None if no crowd is left open.

    A crowd is everything around one hub. Members outside its largest component are compared with all members, block by
    block; blocks hold about ``BLOCK`` shingles, so no task depends on the size of a crowd, and only links leave it.
    """
    labelled = members.join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig")) if labels is not None else members.withColumn("label", F.col("sig"))
    labelled = materialize(labelled, "crowds")
    sums = labelled.groupBy("hub", "label").agg(F.count("*").alias("k"), F.sum("n").alias("size"))
    largest = F.struct("k", "label")
    main = sums.groupBy("hub").agg(F.max_by("label", largest).alias("main"), F.sum("size").alias("size"), F.max_by("size", largest).alias("inner"),
                                   F.sum("k").alias("all"), F.max("k").alias("most"), F.count("*").alias("labels")).filter("labels > 1")
    sides = ((F.col("size") - F.col("inner"), F.col("all") - F.col("most")), (F.col("size"), F.col("all")))
    blocks = [F.ceil(F.greatest(shingles / F.lit(BLOCK), members / F.lit(BLOCK_CLASSES))).cast("int") for shingles, members in sides]
    main = main.select("hub", "main", blocks[0].alias("lefts"), blocks[1].alias("rights"))
    open_ = materialize(labelled.join(main, "hub"), "open-crowds")
    if open_.isEmpty():
        return None
    parts = join.parts_of(open_.select("sig").distinct())
    spot = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "sig"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = open_.filter("label <> main").select("hub", spot(0, "lefts").alias("i"), each("rights").alias("j"), F.lit(0).cast("bigint").alias("side"), "sig", "n", "label")
    right = open_.select("hub", each("lefts").alias("i"), spot(1, "rights").alias("j"), F.lit(1).cast("bigint").alias("side"), "sig", "n", "label")
    laid = left.unionByName(right).join(parts, "sig")
    return materialize(laid.groupBy("hub", "i", "j").applyInArrow(_compare, "a bigint, b bigint"), "links")


def similarity_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: the id column, n_shingles and component_id, the smallest id reachable by links.

    Two texts link when their sets of 5-word shingles (A-Z in lower case; the whole sequence if there are fewer words) have a
    Jaccard similarity of 0.8 or more. Null and blank texts have no shingles and are their own component. Rows with the
    same set share a component; null ids are never the smallest unless a component has no other; an empty table gives no rows.
    """
    found = _components(df, id_col, text_col)
    component = F.when(F.col("n") > 0, F.col("first._id")).otherwise(F.col("_id"))
    return found.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _components(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _raw, n, first): each row with the hash of its text and the first row (_id, _raw) of its component, smallest id first."""
    with settings(df.sparkSession, {ARROW_BATCH: str(BATCH_BYTES)}):
        return _found(df, id_col, text_col)


def _found(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = df.sparkSession
    texts = df.select(F.col(id_col).alias("_id"), text_hash(F.col(text_col)).alias("_raw"), F.col(text_col).alias("_text"))
    kind = df.schema[id_col].dataType.simpleString()
    rows = materialize(texts.mapInArrow(_profile, f"_id {kind}, _raw bigint, n bigint, sig bigint, prefix array<bigint>"), "profiles")
    full = rows.filter("n > 0")
    classes = full.groupBy("sig").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_raw")).alias("least"), F.min("_raw").alias("raw"), F.count("*").alias("members"))
    classes = materialize(classes, "classes")
    # common shingles go last
    held = _common_shingles(texts, classes, rows.agg(F.sum("n")).first()[0] or 0)
    if len(held):
        new = _reordered(texts, spark.sparkContext.broadcast(held)).groupBy("sig").agg(F.first("common").alias("common"), F.first("prefix").alias("new"))
        classes = classes.join(new, "sig", "left").withColumn("prefix", F.coalesce("new", "prefix")).drop("new")
        classes = materialize(classes.withColumn("common", F.coalesce("common", F.lit(0))), "classes")
    else:
        classes = classes.withColumn("common", F.lit(0))
    # members of each shingle that two classes have in their prefixes; the hub is the one with fewest shingles of its own
    by_shingle = Window.partitionBy("h")
    entries = classes.select(F.explode("prefix").alias("h"), "sig", "n", F.col("common").alias("c"))
    # in a common shingle only those stay that can link by common shingles alone
    entries = entries.filter((F.col("h") < F.lit(int(_LAST))) | _similar(F.col("n"), F.ceil(F.col("n") * 4 / 5), F.col("c"))).repartition("h")
    central = F.min(F.struct((F.col("n") - F.col("c")).alias("own"), "sig", "n", "c")).over(by_shingle)
    members = entries.withColumn("hub", central).withColumn("low", F.min("sig").over(by_shingle)).withColumn("high", F.max("sig").over(by_shingle))
    members = materialize(members.filter("low <> high").select("h", "sig", "n", "c", "hub"), "members")
    join = _Join(texts, classes.select("sig", "raw", "prefix"))
    join.decide(materialize(_pairs(members.select("h", F.col("hub.sig").alias("x"), F.col("hub.n").alias("n_x"), F.col("hub.c").alias("c_x"),
                                                  F.col("sig").alias("y"), F.col("n").alias("n_y"), F.col("c").alias("c_y"))), "pairs"))
    labels = join.labels()
    done = None
    open_ = members.filter(F.col("h") < F.lit(int(_LAST))).select("h", "sig", "n", "c")
    take = PIVOTS
    while True:
        labelled = open_.join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig")) if labels is not None else open_.withColumn("label", F.col("sig"))
        per_label = labelled.groupBy("h", "label").agg(F.count("*").alias("k"))
        largest = per_label.groupBy("h").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1").drop("labels")
        open_members = materialize(labelled.join(largest, "h"), "open-members")
        open_ = open_members.select("h", "sig", "n", "c")
        inner = F.col("label") == F.col("main")
        rest = open_members.select(*open_.columns, "label", inner.alias("inner"))
        if done is not None:
            rest = rest.join(done, ["h", "sig"], "left_anti")
        order = Window.partitionBy("h", "inner").orderBy(F.col("n") - F.col("c"), "sig")
        ranked = rest.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= take)
        pivots = materialize(ranked.select("h", F.col("sig").alias("x"), F.col("n").alias("n_x"), F.col("c").alias("c_x"), F.col("label").alias("of_x"), "inner"), "pivots")
        # a shingle is settled when everything outside its largest component has been compared
        if pivots.filter("NOT inner").isEmpty():
            break
        take *= 4
        other = open_members.select("h", F.col("sig").alias("y"), F.col("n").alias("n_y"), F.col("c").alias("c_y"), "label")
        pairs = _pairs(pivots.join(other, "h").filter("of_x <> label"))
        pairs = pairs.join(join.decided, ["a", "b"], "left_anti")
        before = len(join.links)
        join.decide(materialize(pairs, "pairs"))
        if len(join.links) > before:
            labels = join.labels()
        used = pivots.select("h", F.col("x").alias("sig"))
        done = used if done is None else done.unionByName(used)
    crowded = _crowds(join, members.filter(F.col("h") >= F.lit(int(_LAST))).select(F.col("hub.sig").alias("hub"), "sig", "n").distinct(), labels)
    if crowded is not None:
        join.links.append(crowded)
        labels = join.labels()
    # smallest id of each component, then of each row's class
    named = classes.select("sig", "least", "members")
    total = rows.count()
    if labels is not None:
        joined = materialize(named.join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig")), "labelled")
        sums = materialize(joined.groupBy("label").agg(F.min("least").alias("first"), F.count("*").alias("k")), "components")
        named = look_up(joined, sums, "label", "k", joined.count(), F.col("sig")).select("sig", "first", "members")
    else:
        named = named.withColumnRenamed("least", "first")
    found = look_up(rows.select("_id", "_raw", "n", "sig"), materialize(named, "named"), "sig", "members", total, F.xxhash64("_id", "sig"))
    return found.select("_id", "_raw", "n", "first")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each component of ``docs``, by smallest id, then a hash of the text; all columns stay, whatever their names.

    Rows without an id come last in their component. Rows that repeat both id and text stay or go together; null and blank
    texts have no component and stay; an empty table stays empty.
    """
    found = _components(docs, id_col, text_col).filter("n > 0")
    later = ~(F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("_raw") == F.col("first._raw")))
    return without(docs, found.filter(later).select("_id", "_raw"), id_col, text_col)


QUERIES = {"op7_ngram_join": op7}
ORACLE: dict[str, str] = {}
