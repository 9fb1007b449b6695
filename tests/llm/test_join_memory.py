"""The join hands its tasks bounded batches, and leaves the session's settings as they were."""

from fieldmark import session
from fieldmark.llm import ngram_join
from pyspark.sql import functions as F


def test_settings_come_back_after_an_error(spark):
    usual = spark.conf.get(ngram_join.ARROW_BATCH)
    try:
        with session.settings(spark, {ngram_join.ARROW_BATCH: "12345", "fieldmark.none": "x"}):
            assert spark.conf.get(ngram_join.ARROW_BATCH) == "12345" and spark.conf.get("fieldmark.none") == "x"
            raise ValueError
    except ValueError:
        pass
    assert spark.conf.get(ngram_join.ARROW_BATCH) == usual and spark.conf.get("fieldmark.none", None) is None


def test_the_join_hands_tasks_bounded_batches(spark, monkeypatch):
    """No batch of 4,000 texts of 10 kB each is larger than a few MB while the join runs."""
    def run(df, id_col, text_col):
        rows = df.repartition(1).mapInArrow(lambda batches: (b.select([0]).slice(0, 1).set_column(0, "n", [b.nbytes]) for b in batches), "n bigint")
        return rows.agg(F.max("n")).first()[0]

    texts = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))
    monkeypatch.setattr(ngram_join, "_found", run)
    assert ngram_join._components(texts, "doc_id", "text") < 2 * ngram_join.BATCH_BYTES
