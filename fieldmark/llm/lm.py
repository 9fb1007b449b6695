"""Language-model scoring with log-frequency Bloom filters.

A pair of words with count c is put into a filter once for each level 1 .. 1 + floor(2 log2 c). A worker asks for level 1,
2, and so on until the filter says no; the last level gives the count, rounded down to a power of the root of two unless
the filter errs upwards. Pairs are discounted, and what that leaves goes to exact counts of single words.

Every pair of the training texts is held. The most frequent ones, of which there is a bounded number, are in a filter that
is broadcast; the others are in one filter for each shard of the pair hash, and pairs to score are sent to their shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import tokens
from fieldmark.llm.common import materialize, table

#: Pairs whose count is at least this share of all training tokens are broadcast: 1 / PAIR_SHARE of them at most, and their
#: levels add up to a few times as many, whatever the corpus. The others are in the filters of the shards.
PAIR_SHARE = 5e-7
#: Training tokens for each shard of the other pairs, and shards at least.
SHARD_TOKENS, SHARDS = 4_000_000, 128
#: Pairs that a task gathers before it deals them out to the shards.
GATHERED = 1_000_000
#: Words with at least this share of the training tokens are broadcast with their counts; the others are joined.
WORD_SHARE = 2.5e-7
#: Bits of the filter for each entry, and probes for each look-up.
BITS, PROBES = 12, 6
#: Taken off each pair's count; it goes to the single words.
DISCOUNT = 0.75
#: Texts are scored in so many parts, one after the other; only the pairs of one are on the way to the shards.
PARTS = 3
#: Filters up to so many bits are set in an array of flags.
FLAGS = 1 << 26
_END = tokens.mix(np.array([1], dtype=np.uint64))[0]


def in_training(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 != 2


def _with_ends(found: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, token) with one end after the words of each text."""
    texts = len(found.first) - 1
    counts = found.counts() + 1
    text = np.repeat(np.arange(texts), counts)
    ends = np.cumsum(counts) - 1
    token = np.empty(len(text), dtype=np.uint64)
    word = np.ones(len(text), dtype=bool)
    word[ends] = False
    token[word], token[ends] = found.hash, _END
    return text, token


def _pairs(text: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the second token, hash) of the pairs inside a text; the first token of a text has none."""
    at = np.flatnonzero(text[1:] == text[:-1]) + 1
    return at, tokens.mix(token[at - 1] * np.uint64(0x9E3779B97F4A7C15) + tokens.mix(token[at]))


def _tally(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _summed(keys: np.ndarray, n: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their counts and the first word that each has wherever it stands."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[new], np.add.reduceat(n[order], new) if len(new) else n, v[order[new]]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, summed over some megabytes of text at a time."""
    for batch in batches:
        parts = [np.unique(_with_ends(found)[1], return_counts=True) for found in tokens.words(batch.column("_text"))]
        if parts:
            keys, n = _tally(parts)
            yield pa.RecordBatch.from_arrays([tokens.signed(keys), pa.array(n)], ["h", "n"])


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _dealt(shard: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, list]:
    """Columns ordered by shard, cut into the bytes of each shard."""
    at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, dtype=np.int64)
    ends = np.r_[at[1:], len(shard)]
    return {"shard": shard[at].tolist()} | {c: [x[i:j].tobytes() for i, j in zip(at, ends)] for c, x in columns.items()}


def _count_pairs(shards: int):
    """Counts of pairs and the first word of each, packed by shard."""

    def packed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        keys, n, v = _summed(*map(np.concatenate, zip(*parts)))
        rows = _dealt(_shard(keys, shards), {"h": keys, "n": n, "v": v})
        return pa.RecordBatch.from_arrays([pa.array(rows["shard"], pa.int32()), *[pa.array(rows[c], pa.binary()) for c in "hnv"]], ["shard", *"hnv"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for found in tokens.words(batch.column("_text")):
                text, token = _with_ends(found)
                at, key = _pairs(text, token)
                parts.append(_summed(key, np.ones(len(key), dtype=np.int64), token[at - 1]))
                if sum(len(p[0]) for p in parts) >= GATHERED:
                    yield packed(parts)
                    parts = []
        if parts:
            yield packed(parts)

    return run


def _bytes(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


FILTERS = "shard int, bits binary, often array<bigint>, times array<bigint>, v array<bigint>, taken array<double>"


def _build(least: int):
    """The filter of a shard, its pairs of at least ``least``, which are left out of it, and what pairs take from their first words."""

    def run(rows: pa.Table) -> pa.Table:
        keys, n, v = _summed(_bytes(rows.column("h"), np.uint64), _bytes(rows.column("n"), np.int64), _bytes(rows.column("v"), np.uint64))
        words, spot = np.unique(v, return_inverse=True)
        taken = np.bincount(spot, np.maximum(count_of(level_of(n)) - DISCOUNT, 0), len(words))
        often = n >= least
        bits = LogFrequencyFilter.build(keys[~often], n[~often]).bits
        return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary()),
                         "often": _one_list(keys[often].view(np.int64)), "times": _one_list(n[often]), "v": _one_list(words.view(np.int64)), "taken": _one_list(taken)})

    return run


def _one_list(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.floor(2 * np.log2(np.maximum(counts, 1)) + 1e-9).astype(np.int64) + 1


def count_of(levels: np.ndarray) -> np.ndarray:
    return np.where(levels > 0, 2.0 ** ((levels - 1) / 2), 0.0)


def _steps(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of a level begin, and the way from one to the next."""
    one = tokens.mix(keys + np.uint64(level * 0xD6E8FEB86659FD93 % (1 << 64)))
    return one, tokens.mix(one) | np.uint64(1)


class LogFrequencyFilter:
    """Bloom filter of (key, level); a key's level is 1 + floor(2 log2 count)."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> LogFrequencyFilter:
        levels = level_of(counts)
        size = 64
        while size < BITS * max(1, int(levels.sum())):
            size *= 2
        made = cls(np.zeros(size // 8, dtype=np.uint8))
        flags = np.zeros(size if size <= FLAGS else 0, dtype=bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            one, two = _steps(keys[levels >= level], level)
            for k in range(PROBES):
                spot = made._spot(one, two, k)
                if len(flags):
                    flags[spot] = True
                else:
                    np.bitwise_or.at(made.bits, spot >> np.uint64(3), (np.uint8(1) << (spot & np.uint64(7)).astype(np.uint8)))
        if len(flags):
            made.bits = np.packbits(flags, bitorder="little")
        return made

    def _spot(self, one: np.ndarray, two: np.ndarray, k: int) -> np.ndarray:
        return (one + np.uint64(k) * two) & np.uint64(len(self.bits) * 8 - 1)

    def at_level(self, keys: np.ndarray, level: int) -> np.ndarray:
        """Which keys have every probe of a level say yes; only those that did so far are probed further."""
        found = np.arange(len(keys))
        one, two = _steps(keys, level)
        for k in range(PROBES):
            spot = self._spot(one, two, k)
            yes = (self.bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
            found, one, two = found[yes], one[yes], two[yes]
        return found

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Highest level up to which every probe says yes, 0 for keys that aren't there."""
        out = np.zeros(len(keys), dtype=np.int64)
        left, level = np.arange(len(keys)), 0
        while len(left):
            level += 1
            left = left[self.at_level(keys[left], level)]
            out[left] = level
        return out


class Model:
    """Totals, the frequent words (sorted by hash) with their counts and the share of the tokens after each that pairs
    explain, and the filter of the frequent pairs with the least count of these: bounded by the two shares."""

    def __init__(self, total: int, distinct: int, words: np.ndarray, counts: np.ndarray, explained: np.ndarray, bits: np.ndarray, least: int):
        self.total, self.distinct, self.words, self.counts, self.explained, self.least = total, distinct, words, counts, explained, least
        self.pairs = LogFrequencyFilter(bits)

    def state(self) -> tuple:
        return self.total, self.distinct, self.words, self.counts, self.explained, self.pairs.bits, self.least

    def known(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(whether frequent, count, chance as a single word, what pairs leave after it) of each token; 0 and 1 for others."""
        if not len(self.words):
            return np.zeros(len(token), dtype=bool), np.zeros(len(token), dtype=np.int64), np.full(len(token), 1 / (self.total + self.distinct + 1)), np.ones(len(token))
        spot = np.minimum(np.searchsorted(self.words, token), len(self.words) - 1)
        often = self.words[spot] == token
        count = np.where(often, self.counts[spot], 0)
        left = np.where(often, np.maximum(1 - self.explained[spot], 1e-6), 1.0)
        return often, count, (count + 1) / (self.total + self.distinct + 1), left

    def frequent(self, keys: np.ndarray) -> np.ndarray:
        """Counts of the frequent pairs among the keys, 0 for the others."""
        least = int(level_of(np.array([self.least]))[0])
        out = np.zeros(len(keys))
        # most pairs that aren't frequent fail at the least level, before the levels below it are probed
        some = self.pairs.at_level(keys, least)
        each, back = np.unique(keys[some], return_inverse=True)
        levels = self.pairs.levels(each)
        out[some] = np.where(levels >= least, count_of(levels), 0.0)[back]
        return out


def _bounded(counts: DataFrame) -> list[np.ndarray]:
    """The columns of a bounded table, by hash."""
    held = counts.toArrow()
    columns = [held.column(c).to_numpy() for c in held.column_names]
    order = np.argsort(columns[0].view(np.uint64))
    return [c[order] for c in columns]


def train(texts: DataFrame) -> tuple[Model, DataFrame, DataFrame, int]:
    """The model, the written table (h, n, explained) of all words of texts (_text), the filters of the shards and their number."""
    counted = materialize(texts.select("_text").mapInArrow(_count_words, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), "words")
    total, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least, shards = max(1, int(PAIR_SHARE * total)), max(SHARDS, -(-total // SHARD_TOKENS))
    pairs = texts.select("_text").mapInArrow(_count_pairs(shards), "shard int, h binary, n binary, v binary")
    filters = materialize(pairs.groupBy("shard").applyInArrow(_build(least), FILTERS), "pair-filters")
    taken = filters.select(F.explode(F.arrays_zip("v", "taken")).alias("x")).groupBy(F.col("x.v").alias("v")).agg(F.sum("x.taken").alias("taken"))
    explained = F.least(F.lit(1.0), F.coalesce("taken", F.lit(0.0)) / F.col("n"))
    words = materialize(counted.join(taken, F.col("h") == F.col("v"), "left").select("h", "n", explained.alias("explained")), "words")
    known, counts, shares = _bounded(words.filter(F.col("n") >= _least_known(total)))
    keys, n = _bounded(filters.select(F.explode(F.arrays_zip("often", "times")).alias("x")).select("x.often", "x.times"))
    held = LogFrequencyFilter.build(keys.view(np.uint64), n)
    return Model(int(total), int(distinct), known.view(np.uint64), counts, shares, held.bits, least), words, filters.select("shard", "bits"), shards


def _least_known(total: int) -> int:
    return max(1, int(WORD_SHARE * total))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Scores of texts from the frequent words and pairs, and the words whose counts are yet to be joined.

    ``rare`` and ``times`` list the other words and how often each stands in the text.
    """
    for batch in batches:
        sums = np.zeros((3, len(batch)))
        tally = np.zeros((2, len(batch)), dtype=np.int64)
        rare, times, lengths = [], [], np.zeros(len(batch), dtype=np.int64)
        for found in tokens.words(batch.column("_text")):
            text, token = _with_ends(found)
            often, count, single, leaves = model.known(token)
            at, key = _pairs(text, token)
            # what pairs leave of the tokens after a word goes to single words
            left = np.ones(len(token))
            left[at] = leaves[at - 1]
            chance = single * left
            both = often[at - 1] & often[at]
            at, key = at[both], key[both]
            chance[at] += np.maximum(model.frequent(key) - DISCOUNT, 0) / np.maximum(count[at - 1], 1)
            chance = np.minimum(chance, 1.0)
            base = np.where(often, np.log10(single), 0.0)
            # a rare word adds its own logarithm once its count is joined
            own = np.where(often, np.log10(chance), np.log10(left))
            n = found.stop - found.begin
            sums[0, found.begin:found.stop] += np.bincount(text, base, n)
            sums[1, found.begin:found.stop] += np.bincount(text, own, n)
            tally[0, found.begin:found.stop] += np.bincount(text, minlength=n)
            tally[1, found.begin:found.stop] += np.bincount(text[often], minlength=n)
            rest = np.flatnonzero(~often)
            order = np.lexsort((token[rest], text[rest]))
            t, w = text[rest][order], token[rest][order]
            new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (w[1:] != w[:-1])]) if len(t) else np.zeros(0, dtype=np.int64)
            rare.append(w[new])
            times.append(np.diff(np.r_[new, len(t)]))
            lengths[found.begin:found.stop] += np.bincount(t[new], minlength=n)
        flat = np.concatenate(rare) if rare else np.zeros(0, dtype=np.uint64)
        many = np.concatenate(times) if times else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_key"), pa.array(tally[0]), pa.array(tally[1]), pa.array(sums[0]), pa.array(sums[1]),
             tokens.lists(flat, lengths), tokens.lists(many.astype(np.int64), lengths)],
            ["_id", "_key", "n_tokens", "n_known", "base", "own", "rare", "times"])


QUERIED = ("k", "runs", "h", "first", "base")
QUERIES_KIND = "shard int, " + ", ".join(f"{c} binary" for c in QUERIED)


def _packed(k: np.ndarray, h: np.ndarray, first: np.ndarray, base: np.ndarray, shards: int) -> pa.RecordBatch:
    """Pairs to score by shard: text key with the length of its run, pair, count of the first word, chance without the pair."""
    shard = _shard(h, shards)
    order = np.lexsort((k, shard))
    k, shard = k[order], shard[order]
    rows = _dealt(shard, {"h": h[order], "first": first[order].astype(np.float32), "base": base[order].astype(np.float32)})
    new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (shard[1:] != shard[:-1])]) if len(k) else np.zeros(0, dtype=np.int64)
    rows |= _dealt(shard[new], {"k": k[new], "runs": np.diff(np.r_[new, len(k)]).astype(np.int32)})
    return pa.RecordBatch.from_arrays([pa.array(rows["shard"], pa.int32()), *[pa.array(rows[c], pa.binary()) for c in QUERIED]], ["shard", *QUERIED])


def _known_pairs(batches: Iterator[pa.RecordBatch], model: Model, shards: int) -> Iterator[pa.RecordBatch]:
    """Pairs of known words that aren't frequent, packed: with the count of the first, and the chance as a single word of the
    second times what pairs leave after the first."""
    parts: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        keys = batch.column("_key").to_numpy()
        for found in tokens.words(batch.column("_text")):
            text, token = _with_ends(found)
            often, count, single, leaves = model.known(token)
            at, key = _pairs(text, token)
            both = often[at - 1] & often[at]
            at, key = at[both], key[both]
            rest = model.frequent(key) == 0
            at, key = at[rest], key[rest]
            parts.append((keys[found.begin + text[at]], key, count[at - 1], single[at] * leaves[at - 1]))
            if sum(len(p[0]) for p in parts) >= GATHERED:
                yield _packed(*map(np.concatenate, zip(*parts)), shards)
                parts = []
    if parts:
        yield _packed(*map(np.concatenate, zip(*parts)), shards)


def _other_pairs(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Pairs with a word whose count is yet to be joined, none of which is frequent; a known word has the pair's hash in its
    place, which no word has, and an unknown one leaves its part out."""
    for batch in batches:
        keys = batch.column("_key").to_numpy()
        for found in tokens.words(batch.column("_text")):
            text, token = _with_ends(found)
            often, count, single, leaves = model.known(token)
            at, h = _pairs(text, token)
            use = ~(often[at - 1] & often[at])
            at, h = at[use], h[use]
            a, b = often[at - 1], often[at]
            base = np.where(b, single[at], 1.0) * leaves[at - 1]
            yield pa.RecordBatch.from_arrays([pa.array(keys[found.begin + text[at]]), tokens.signed(h), tokens.signed(np.where(a, h, token[at - 1])), tokens.signed(np.where(b, h, token[at])),
                                              pa.array(count[at - 1].astype(np.float32)), pa.array(base)], ["k", "h", "v", "w", "first", "base"])


def _probe(held: pa.Table, asked: pa.Table) -> pa.Table:
    """What the pairs of a shard add to the logarithm of each text's chance."""
    k, gain = np.zeros(0, dtype=np.int64), np.zeros(0)
    if held.num_rows and asked.num_rows:
        seen = count_of(LogFrequencyFilter(_bytes(held.column("bits"), np.uint8)).levels(_bytes(asked.column("h"), np.uint64)))
        more = np.maximum(seen - DISCOUNT, 0) / _bytes(asked.column("first"), np.float32)
        hit = more > 0
        base = _bytes(asked.column("base"), np.float32)[hit].astype(np.float64)
        k, back = np.unique(np.repeat(_bytes(asked.column("k"), np.int64), _bytes(asked.column("runs"), np.int32))[hit], return_inverse=True)
        gain = np.bincount(back, np.log10(np.minimum(base + more[hit], 1.0)) - np.log10(base), len(k))
    return pa.table({"k": pa.array(k, pa.int64()), "gain": pa.array(gain, pa.float64())})


def _gains(keyed: DataFrame, shared, words: DataFrame, filters: DataFrame, shards: int, least_known: int, size: float) -> DataFrame:
    """(k, gain): what pairs that aren't frequent add to the score of the texts with a key, summed over rows that repeat.

    Each part of the texts is written before the next begins, so the pairs of all are never on disk at once.
    """
    parts = []
    for part in range(PARTS):
        texts = keyed.select("_key", "_text").filter(F.pmod(F.col("_key"), F.lit(PARTS)) == part)
        parts.append(materialize(_gains_of(texts, shared, words, filters, shards, least_known, size), "gains"))
    return reduce(DataFrame.unionByName, parts)


def _gains_of(texts: DataFrame, shared, words: DataFrame, filters: DataFrame, shards: int, least_known: int, size: float) -> DataFrame:
    asked = texts.mapInArrow(lambda batches: _known_pairs(batches, Model(*shared.value), shards), QUERIES_KIND)
    if least_known > 1:  # else every word of the training texts is known, and pairs with others have not been seen
        rows = texts.mapInArrow(lambda batches: _other_pairs(batches, Model(*shared.value)),
                                "k bigint, h bigint, v bigint, w bigint, first float, base double")
        a, b = F.col("v") == F.col("h"), F.col("w") == F.col("h")
        rare = words.filter(F.col("n") < least_known)
        one = rare.select(F.col("h").alias("v"), F.col("n").alias("n1"), F.greatest(1 - F.col("explained"), F.lit(1e-6)).alias("left"))
        two = rare.select(F.col("h").alias("w"), F.col("n").alias("n2"))
        rows = rows.join(one, "v", "left").filter(a | F.col("n1").isNotNull())
        rows = rows.select("k", "h", "w", F.when(a, F.col("first")).otherwise(F.col("n1")).cast("float").alias("first"), (F.col("base") * F.when(a, 1.0).otherwise(F.col("left"))).alias("base"))
        rows = rows.join(two, "w", "left").filter(b | F.col("n2").isNotNull())
        rows = rows.select("k", "h", "first", (F.col("base") * F.when(b, 1.0).otherwise((F.col("n2") + 1) / F.lit(size))).alias("base"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k, h, first, base = (batch.column(c).to_numpy() for c in ("k", "h", "first", "base"))
                yield _packed(k, h.view(np.uint64), first, base, shards)

        asked = asked.unionByName(materialize(rows.mapInArrow(pack, QUERIES_KIND), "rare-pairs"))
    found = filters.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_probe, "k bigint, gain double")
    return found.groupBy("k").agg(F.sum("gain").alias("gain"))


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training texts are the rows that aren't held out. Null text is empty and has the end as its only token; rows that repeat
    get the same scores and a row each; a null id counts as the text ''; an empty table gives no rows.
    """
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    model, words, filters, shards = train(texts.filter(in_training("_id")))
    shared = df.sparkSession.sparkContext.broadcast(model.state())
    kind = df.schema[id_col].dataType.simpleString()
    keyed = texts.withColumn("_key", F.xxhash64("_id", "_text"))
    parts = keyed.mapInArrow(lambda batches: _score(batches, Model(*shared.value)),
                             f"_id {kind}, _key bigint, n_tokens bigint, n_known bigint, base double, own double, rare array<bigint>, times array<bigint>")
    # rows that repeat are worked on once and counted
    one = parts.groupBy("_id", "_key").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n_tokens", "n_known", "base", "own", "rare", "times")])
    one = materialize(one, "scores")
    open_ = one.select("_id", "_key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("_id", "_key", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    seen = open_.join(words, "h", "left").select("_id", "_key", "times", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("explained", F.lit(0.0)).alias("explained"))
    size = float(model.total + model.distinct + 1)
    logs = F.log10((F.col("n") + 1) / F.lit(size))
    # a token follows each word: it gets what the pairs of that word leave
    left = F.log10(F.greatest(1 - F.col("explained"), F.lit(1e-6)))
    rest = seen.groupBy("_id", "_key").agg(F.sum(F.col("times") * logs).alias("more"), F.sum(F.col("times") * left).alias("after"),
                                           F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("more_known"))
    rest = materialize(rest.select(F.col("_id").alias("_i"), F.col("_key").alias("_k"), "more", "after", "more_known"), "rare-words")
    gains = _gains(keyed, shared, words, filters, shards, _least_known(model.total), size)
    found = one.drop("rare", "times").join(rest, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left")
    found = found.join(gains, F.col("_key") == F.col("k"), "left")
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    more = F.coalesce("more", F.lit(0.0))
    return found.select(F.col("_id").alias(id_col), (~in_training("_id")).alias("held_out"), "n_tokens",
                        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
                        (F.col("base") + more).alias("base_score"), (F.col("own") + more + F.coalesce("after", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0)) / F.col("copies")).alias("score"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op1_lm": op1}
ORACLE: dict[str, str] = {}
