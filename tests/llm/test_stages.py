"""The stages of the pipeline on rows without ids, shared ids, odd columns and empty tables."""

import random

import pytest

import corpus_pipeline
from fieldmark.llm import common, decontaminate, exact_dedup, ngram_join, quality

NAMES = "gone_id gone_raw _gone _gone_raw _quality_seed quality_seed _raw _id _text key label".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in NAMES)


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *NAMES) for i, t, s in rows], SCHEMA)


def _text(seed, n=60):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randint(0, 5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, _text("item", 30)), (2, None)], "item_id bigint, text string")


def _left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_contaminated_rows_go_for_their_own_text(spark, items):
    bad, good = _text("a") + " " + _text("item", 30), _text("b")
    rows = [(None, bad, "s"), (None, good, "s"), (None, None, "s"), (5, bad, "s"), (5, good, "s"), (6, good, None)]
    got = _left(decontaminate.drop_contaminated(_frame(spark, rows), items))
    assert got == sorted([(i, t) for i, t, _ in rows if t != bad], key=repr)


def test_near_copies_without_ids_go(spark):
    base = _text("near", 200)
    near = base.rsplit(" ", 2)[0] + " other ends"
    rows = [(None, base, "s"), (3, near, "s"), (3, _text("c"), "s"), (None, _text("d"), "s"), (None, None, "s"), (4, "", "s")]
    got = _left(ngram_join.keep_first(_frame(spark, rows)))
    assert got == sorted([(i, t) for i, t, _ in rows if not (i is None and t == base)], key=repr)
    alone = [(None, base, "s"), (None, near, "s")]
    assert len(_left(ngram_join.keep_first(_frame(spark, alone)))) == 1


def test_exact_copies(spark):
    rows = [(1, "Same text", "s"), (2, "same TEXT", "s"), (None, "same text", "s"), (2, "another", "s")]
    assert _left(exact_dedup.drop_copies(_frame(spark, rows))) == [(2, "another"), (2, "same TEXT")]


def test_columns_of_any_name_stay(spark, labels, items):
    df = _frame(spark, [(i, _text(i), "s") for i in range(30)] + [(1, _text(1), "s")])
    for stage in (exact_dedup.drop_copies, ngram_join.keep_first, lambda d: quality.keep_good(d, labels), lambda d: decontaminate.drop_contaminated(d, items)):
        kept = stage(df)
        assert kept.columns == df.columns
        assert {tuple(r[n] for n in NAMES) for r in kept.collect()} <= {tuple(NAMES)}
    assert common.fresh(df, "gone_id") == "gone_id_"


@pytest.mark.parametrize("rows", [[], [(None, None, None)], None])
def test_whole_pipeline_on_odd_tables(spark, tmp_path, labels, items, rows):
    if rows is None:
        near = _text("x", 300)
        rows = [(i, _text(i, 80), ["a", "b", None][i % 3]) for i in range(60)]
        rows += [(100, near, "a"), (101, near + " tail", "b"), (102, near, "a"), (103, _text("y") + " " + _text("item", 30), "b"), (None, "", None), (7, _text(7, 80), "b")]
    _frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = common.table(spark, str(tmp_path), "documents")
    for (name, stage) in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = common.materialize(stage(spark, kept, str(tmp_path)), "test")
        assert kept.columns == _frame(spark, rows).columns and kept.count() <= before, name
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id) for r in mixed)) == sorted(str(r.doc_id) for r in kept.collect())
    assert 103 not in {r.doc_id for r in mixed}
    assert len({100, 101, 102} & {r.doc_id for r in mixed}) <= 1
