"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Fixed masks choose some words of a window and ignore the others, so a substituted word only breaks the seeds that look at
it. Hashes of the chosen words join benchmark and documents; around each hit the two texts are laid side by side and the
overlap is counted word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm.common import SPACE, if_small, materialize, table, without

#: Positions that each mask looks at; 0 is the first word of the window.
MASKS = ((0, 1, 2, 4, 7), (0, 2, 4, 5, 8), (0, 1, 5, 7, 8))
SPAN = 9
#: An overlap counts when OVERLAP words in a row (or the whole item, if shorter) agree in SHARE of them or more.
OVERLAP = 13
SHARE = 0.8
_USED = tuple(sorted({p for mask in MASKS for p in mask}))


def _words(text: Column) -> Column:
    """Lower-cased words as 64-bit hashes."""
    plain = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.transform(F.split(plain, SPACE), lambda x: F.xxhash64(x))


def seeds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at, seed) for every window and mask of rows (keys, words)."""
    shifted = [F.slice("words", p + 1, F.greatest(F.size("words"), F.lit(1))).alias(f"w{p}") for p in _USED]
    laid = rows.filter(F.size("words") >= SPAN).select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias("at", "w"))
    laid = laid.filter(F.col(f"w.w{SPAN - 1}").isNotNull())
    hashed = [F.xxhash64(F.lit(k), *[F.col(f"w.w{p}") for p in mask]) for k, mask in enumerate(MASKS)]
    return laid.select(*keys, "at", F.explode(F.array(*hashed)).alias("seed"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
             item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item that overlap: ids, doc_start, n_words, n_equal.

    ``n_words`` is the length of the overlap of the two texts laid side by side and ``n_equal`` counts its equal words;
    of several placements the one with most equal words counts. Items with the same words count as the one with the
    smallest id; items of fewer than ``SPAN`` words aren't searched. Null and short texts have no overlap, rows that repeat
    give one result, a null id stays null, and an empty side gives no rows.
    """
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text)
    best = found.select("_id", "_item", F.struct(_total(F.col("same")).alias("n_equal"), (-F.col("doc_start")).alias("m"), "n_words").alias("b"))
    best = best.groupBy("_id", "_item").agg(F.max("b").alias("b"))
    return best.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), (-F.col("b.m")).cast("bigint").alias("doc_start"),
                       F.col("b.n_words").cast("bigint").alias("n_words"), F.col("b.n_equal").cast("bigint").alias("n_equal"))


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(_id, _raw, _item, doc_start, n_words, run, same): the placements that count, with the hash of the document's text."""
    items = benchmark.select(F.col(item_col).alias("_item"), _words(F.col(item_text)).alias("words")).filter(F.size("words") >= SPAN)
    items = materialize(items.groupBy("words").agg(F.min("_item").alias("_item")), "items")
    sought = materialize(seeds(items, ["_item"]).select("_item", F.col("at").alias("item_at"), F.col("seed").alias("_seed")), "seeds")
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_raw"), F.col(text_col).alias("_text"))
    spread = seeds(texts.select("_id", "_raw", _words(F.col("_text")).alias("words")), ["_id", "_raw"])
    hits = spread.join(if_small(sought, 32), F.col("seed") == F.col("_seed"))
    hits = materialize(hits.select("_id", "_raw", "_item", (F.col("at") - F.col("item_at")).alias("_place")).distinct(), "hits")
    # lay the texts side by side
    mine = hits.select(F.col("_id").alias("_of"), F.col("_raw").alias("_of_raw"), "_item", "_place")
    laid = texts.join(if_small(mine, 40), F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_raw") == F.col("_of_raw")))
    laid = laid.select("_id", "_raw", "_item", "_place", _words(F.col("_text")).alias("doc_words"))
    laid = laid.join(if_small(items.withColumnRenamed("words", "item_words"), 8192), "_item")
    start = F.greatest(F.lit(0), F.col("_place"))
    skip = start - F.col("_place")
    length = F.least(F.size("doc_words") - start, F.size("item_words") - skip)
    pairs = laid.select("_id", "_raw", "_item", start.alias("doc_start"), length.alias("n_words"), F.least(F.lit(OVERLAP), F.size("item_words")).alias("run"),
                        F.zip_with(F.slice("doc_words", start + 1, length), F.slice("item_words", skip + 1, length),
                                   lambda x, y: (x == y).cast("int")).alias("same"))
    need = F.ceil(F.col("run") * F.lit(SHARE))
    runs = F.exists(F.sequence(F.lit(1), F.col("n_words") - F.col("run") + 1), lambda s: _total(F.slice("same", s, F.col("run"))) >= need)
    return pairs.filter(F.col("n_words") >= F.col("run")).filter(runs)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have no overlap with ``benchmark``, with all their columns, whatever their names.

    Null and short texts stay; a row goes for its own text alone, also if it has no id or shares one; repeated rows go
    together; with an empty benchmark all rows stay, an empty table stays empty.
    """
    return without(docs, _found(docs, benchmark, id_col, text_col).select("_id", "_raw"), id_col, text_col)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", F.lit(True))


def overlaps_sql(documents: str) -> str:
    """DuckDB text for :func:`overlaps`, as common table expressions ending in ``overlapping``."""
    word = r"'[^\x20\x09-\x0D]+'"
    keys = [f"list_transform(range(len(w) - {SPAN - 1}), lambda i: concat_ws(' ', '{k}', " + ", ".join(f"w[i + {p + 1}]" for p in mask) + "))" for k, mask in enumerate(MASKS)]
    seeded = " UNION ALL ".join("SELECT {id}, unnest(" + key + f") AS seed, unnest(range(len(w) - {SPAN - 1})) AS at FROM {{rel}}" for key in keys)
    return f"""
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {word}) AS w FROM {documents}),
iw AS (SELECT w, min(item_id) AS item_id FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), {word}) AS w FROM benchmark) b
       WHERE len(w) >= {SPAN} GROUP BY w),
ds AS ({seeded.format(id="doc_id", rel=f"(SELECT * FROM dw WHERE len(w) >= {SPAN})")}),
bs AS ({seeded.format(id="item_id", rel="iw")}),
places AS (SELECT DISTINCT doc_id, item_id, ds.at - bs.at AS place FROM ds JOIN bs USING (seed)),
laid AS (SELECT p.doc_id, p.item_id, greatest(0, place) AS doc_start, greatest(0, place) - place AS skip, dw.w AS d, iw.w AS i FROM places p
         JOIN dw ON p.doc_id = dw.doc_id JOIN iw ON p.item_id = iw.item_id),
sized AS (SELECT *, least(len(d) - doc_start, len(i) - skip) AS n_words, least({OVERLAP}, len(i)) AS run FROM laid),
marked AS (SELECT *, list_transform(range(n_words), lambda k: CASE WHEN d[doc_start + k + 1] = i[skip + k + 1] THEN 1 ELSE 0 END) AS same FROM sized WHERE n_words >= run),
counted AS (SELECT doc_id, item_id, doc_start, n_words, CAST(list_sum(same) AS BIGINT) AS n_equal FROM marked
            WHERE list_max(list_transform(range(n_words - run + 1), lambda s: list_sum(same[s + 1:s + run]))) >= ceil(run * {SHARE})),
overlapping AS (SELECT doc_id, item_id, doc_start, n_words, n_equal FROM counted
                QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, doc_start, n_words DESC) = 1)"""


QUERIES = {"op3_decontaminate": op3}
ORACLE = {"op3_decontaminate": f"WITH {overlaps_sql('documents')} SELECT *, true AS contaminated FROM overlapping"}
