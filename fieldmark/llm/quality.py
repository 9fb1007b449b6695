"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k sampling.

The importance weight of a text is the ratio of its probability under two bags of hashed n-grams (words and runs of
signs, single and in pairs): one fitted on rows labelled as good, one on all text. Adding Gumbel noise to the
logarithm and keeping the largest values draws rows without replacement in proportion to their weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import tokens
from fieldmark.llm.common import fresh, materialize, table

#: Hash buckets of the models.
BUCKETS = 1 << 15
#: The models are fitted on this many labelled rows at most; the raw model counts all rows.
LABELLED_ROWS = 20_000
#: Share of the good labelled rows, kept apart from the fit, whose weight must reach the cut.
KEEP = 0.998
_SAME = np.uint64(0x5851F42D4C957F2D)  # stands for any word that follows itself


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _features(found: tokens.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of single words, then of pairs."""
    text = found.text_of()
    yield text, (found.hash % np.uint64(BUCKETS)).astype(np.int64)
    at, pair = tokens.windows(found, 2)
    pair[found.hash[at] == found.hash[at + 1]] = _SAME
    yield text[at], (pair % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of a partition: all rows, and those labelled good."""
    sums = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        good = batch.column("_good").fill_null(0).to_numpy(zero_copy_only=False) == 1
        for found in tokens.words(batch.column("_text"), signs=True):
            mine = good[found.begin:found.stop]
            for text, bucket in _features(found):
                sums[0] += np.bincount(bucket, minlength=BUCKETS)
                if mine.any():
                    sums[1] += np.bincount(bucket[mine[text]], minlength=BUCKETS)
    for model in range(2):
        at = np.flatnonzero(sums[model])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), model), pa.int32()), pa.array(at, pa.int32()), pa.array(sums[model][at])],
                                             ["model", "bucket", "n"])


def _weights(column: pa.Array, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log weight, number of n-grams) of each text."""
    weight, grams = np.zeros(len(column)), np.zeros(len(column), dtype=np.int64)
    for found in tokens.words(column, signs=True):
        for text, bucket in _features(found):
            n = found.stop - found.begin
            weight[found.begin:found.stop] += np.bincount(text, ratio[bucket], n)
            grams[found.begin:found.stop] += np.bincount(text, minlength=n)
    return weight, grams


def _gumbel(seeds: np.ndarray) -> np.ndarray:
    uniform = ((tokens.mix(seeds.view(np.uint64)) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return -np.log(-np.log(uniform))


class Model:
    """Log ratio of the two models for each bucket, and the cut; the same size whatever the corpus."""

    def __init__(self, ratio: np.ndarray, cut: float):
        self.ratio, self.cut = ratio, cut


def labelled(labels: DataFrame, label: str, id_col: str = "doc_id", rows: int = LABELLED_ROWS) -> DataFrame:
    """(_labelled, _good, _fit): the bounded, hash-random sample of rows with a label that isn't held out.

    One row in four is marked for setting the cut instead of for the fit. Rows without id or label are left out.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col))
    sample = usable.select(F.col(id_col).alias("_labelled"), F.col(label).cast("int").alias("_good")).orderBy(F.xxhash64("_labelled"), "_good").limit(rows)
    one = sample.groupBy("_labelled").agg(F.max("_good").alias("_good"))
    return materialize(one.withColumn("_fit", F.crc32(F.col("_labelled").cast("string").cast("binary")) % 4 != 3), "labelled")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts over all rows of ``docs``; without labelled rows every weight is 1 and nothing is rejected."""
    known = labelled(labels, label, id_col)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    use = known.filter("_fit").select(F.col("_labelled"), "_good")
    rows = texts.join(F.broadcast(use), F.col("_id") == F.col("_labelled"), "left").select("_text", "_good")
    counts = rows.mapInArrow(_count, "model int, bucket int, n bigint").groupBy("model", "bucket").agg(F.sum("n").alias("n"))
    sums = np.zeros((2, BUCKETS))
    for r in counts.collect():  # two models of BUCKETS numbers
        sums[r.model, r.bucket] = r.n
    if not sums[1].any():
        return Model(np.zeros(BUCKETS), 0.0)
    share = np.log((sums + 1.0) / (sums.sum(axis=1, keepdims=True) + BUCKETS))
    ratio = share[1] - share[0]
    good = known.filter("NOT _fit AND _good = 1").select("_labelled")
    own = texts.join(F.broadcast(good), F.col("_id") == F.col("_labelled")).select("_text")
    cut = weigh(own.withColumn("_seed", F.lit(0).cast("bigint")), Model(ratio, 0.0)).agg(F.percentile("log_weight", 1 - KEEP)).first()[0]
    return Model(ratio, 0.0 if cut is None else min(0.0, float(cut)))


def weigh(rows: DataFrame, model: Model) -> DataFrame:
    """Adds n_grams, log_weight and gumbel_key to rows (_seed, _text, others), without the text."""
    ratio = rows.sparkSession.sparkContext.broadcast(model.ratio)
    names = [c for c in rows.columns if c != "_text"]
    fields = [rows.schema[c] for c in names]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, grams = _weights(batch.column("_text"), ratio.value)
            key = weight + _gumbel(batch.column("_seed").to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(grams), pa.array(weight), pa.array(key)],
                                             [*names, "n_grams", "log_weight", "gumbel_key"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(score, f"{kinds}, n_grams bigint, log_weight double, gumbel_key double")


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 1024, few: int = 1000) -> float:
    """The k-th largest value of a written table, by counting in ever finer bins; no sort, no window."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return math.inf
    while True:
        inside = values.filter(F.col(column).between(low, high))
        width = (high - low) / bins
        if inside.count() <= few or width <= 0 or low + width == low:
            top = inside.groupBy(column).count().orderBy(F.col(column).desc()).limit(max(few, bins)).collect()
            for r in top:
                k -= r["count"]
                if k <= 0:
                    return float(r[column])
            return float(low)
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        found = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(found, key=lambda r: -r.bin):
            if r.n >= k:
                low, high = r.low, r.high
                break
            k -= r.n


def resample(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """((_id, n_grams, log_weight, gumbel_key), the smallest key that is selected).

    As many rows are drawn as have a weight of at least the cut.
    """
    seed = F.xxhash64(F.col(id_col))
    rows = docs.select(F.col(id_col).alias("_id"), seed.alias("_seed"), F.col(text_col).alias("_text"))
    scored = materialize(weigh(rows, model).drop("_seed"), "weights")
    k = scored.filter(F.col("log_weight") >= model.cut).count()
    return scored, kth_largest(scored, "gumbel_key", k)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, held_out, n_grams, log_weight, gumbel_key, selected, predicted (0 or 1).

    ``predicted`` compares the weight with the cut alone; ``selected`` is the Gumbel draw. Null and empty texts have weight
    1 (log 0), rows that repeat get the same key and stay together, and an empty table gives no rows.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    scored, least = resample(docs, model, id_col, text_col)
    return scored.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "n_grams", "log_weight", "gumbel_key",
                         (F.col("gumbel_key") >= F.lit(least)).alias("selected"), (F.col("log_weight") >= F.lit(model.cut)).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the draw selects, with all their columns, whatever their names; texts are weighed again, not shuffled.

    Null texts are weighed as empty ones; rows without an id share one draw, as do rows that repeat an id; without labels all
    rows stay; an empty table stays empty.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    _, least = resample(docs, model, id_col, text_col)
    ratio = docs.sparkSession.sparkContext.broadcast(model.ratio)
    names = docs.columns
    where = names.index(text_col)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, _ = _weights(batch.column(where), ratio.value)
            key = weight + _gumbel(batch.column(len(names)).to_numpy())
            yield batch.select(list(range(len(names)))).filter(pa.array(key >= least))

    seeded = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64(F.col(id_col)).alias(fresh(docs, "quality_seed")))
    return seeded.mapInArrow(pick, docs.schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_quality": op8}
ORACLE: dict[str, str] = {}
