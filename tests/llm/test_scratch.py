"""What is shuffled for a written table goes with the write; pairs are scored part by part."""

import os
import time
from pathlib import Path

from fieldmark import session
from fieldmark.llm import lm
from pyspark.sql import functions as F


def _shuffled(spark):
    folder = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", "/tmp")
    return {str(p) for p in Path(folder).glob("**/blockmgr-*/*/shuffle_*")}


def test_shuffle_files_go_with_the_write(spark):
    before, usual = _shuffled(spark), spark.conf.get(session.CLEANUP)
    made = session.materialize(spark.range(5000).groupBy((F.col("id") % 100).alias("k")).count(), "kept")
    until = time.time() + 20
    while _shuffled(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffled(spark) - before
    assert made.count() == 100 and spark.conf.get(session.CLEANUP) == usual


def test_pairs_are_scored_part_by_part(spark, monkeypatch):
    monkeypatch.setattr(lm, "PAIR_SHARE", 5e-3)
    monkeypatch.setattr(lm, "WORD_SHARE", 4e-3)
    rows = [(i, " ".join(f"w{(i * j * j + j) % (5 + i % 90)}" for j in range(40))) for i in range(60)] + [(None, "w1 w2"), (7, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    written = []
    real = lm.materialize
    monkeypatch.setattr(lm, "materialize", lambda df, label: written.append(label) or real(df, label))
    got = {(r.doc_id, r.n_tokens): r.score for r in lm.score(frame).collect()}
    assert written.count("gains") == written.count("rare-pairs") == lm.PARTS > 1
    monkeypatch.setattr(lm, "PARTS", 1)
    whole = {(r.doc_id, r.n_tokens): r.score for r in lm.score(frame).collect()}
    assert got.keys() == whole.keys() and all(abs(got[k] - whole[k]) < 1e-6 for k in got)
