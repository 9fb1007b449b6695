"""Which shingles go last is counted over all texts, and any order gives the same links."""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from fieldmark.llm import ngram_join
from fieldmark.llm.common import materialize, text_hash

PASSAGE = " ".join(f"shared{k}" for k in range(30))


def _texts(spark, wanted):
    rows = spark.range(1200).select(F.col("id").alias("doc_id"), F.concat(
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(150)), lambda k: F.concat(F.lit("own"), F.col("id"), F.lit("x"), k)), " "),
        F.lit(" " + PASSAGE)).alias("text"))
    return rows.filter(wanted).limit(100)


def _shared():
    return next(own for _, own in ngram_join._sets(pa.array([PASSAGE])))


@pytest.mark.parametrize("rest", [False, True])
def test_shingles_of_every_text_are_counted(spark, rest):
    """A passage that no text of one eighth (by hash) has, or all of them, counts as what it is: in 100 texts."""
    eighth = F.pmod(text_hash(F.col("text")), F.lit(8)) == 0
    docs = materialize(_texts(spark, ~eighth if rest else eighth))
    texts = docs.select(F.col("doc_id").alias("_id"), text_hash(F.col("text")).alias("_raw"), F.col("text").alias("_text"))
    rows = texts.mapInArrow(ngram_join._profile, "_id bigint, _raw bigint, n bigint, sig bigint, prefix array<bigint>")
    none = rows.select("sig", F.slice("prefix", 1, 0).alias("prefix"))
    got = ngram_join._common_shingles(texts, none, 100 * 177)
    assert got.tolist() == _shared().tolist()


def test_packed_counts_add_up():
    words = [" ".join(f"w{k}" for k in range(a, a + 40)) for a in (0, 0, 5, 5, 5, 900)]
    batch = pa.RecordBatch.from_arrays([pa.array([*words, None, "", "one two"])], ["_text"])
    want = np.concatenate([o for _, o in ngram_join._sets(batch.column("_text"))])
    groups = {}
    for out in ngram_join._counted(iter([batch, batch]), 3):
        for bucket in set(out.column("bucket").to_pylist()):
            groups.setdefault(bucket, []).append(out.filter(pa.compute.equal(out.column("bucket"), bucket)))
    h, k = np.unique(np.concatenate([want, want]), return_counts=True)
    for least in (1, 2, 4, 6, 10, 11):
        got = np.concatenate([ngram_join._frequent(pa.Table.from_batches(g), least).column("h").to_numpy().view(np.uint64) for g in groups.values()])
        assert np.sort(got).tolist() == h[k >= least].tolist(), least


def test_links_do_not_depend_on_the_order(spark, monkeypatch):
    """Every shingle in two texts last, or none: the same components."""
    docs = spark.range(240).select(F.col("id").alias("doc_id"), F.concat(
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(60)), lambda k: F.concat(F.lit("g"), F.floor(F.col("id") / 6), F.lit("x"), k)), " "),
        F.lit(" tail"), F.col("id") % 3, F.lit(" end"), F.when(F.col("id") % 4 == 0, F.lit(" " + PASSAGE)).otherwise(F.lit(""))).alias("text"))
    found = []
    for least in (2, 1 << 40):
        monkeypatch.setattr(ngram_join, "COMMON_TEXTS", least)
        monkeypatch.setattr(ngram_join, "COMMON_LEAST", least)
        found.append(sorted(tuple(r) for r in ngram_join.similarity_join(docs).collect()))
    assert found[0] == found[1] and len({r[2] for r in found[0]}) < 240
