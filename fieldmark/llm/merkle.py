"""Merkle manifest of a dataset, built level by level with sibling-shift self-joins.

Leaves are numbered inside their group by a range sort and offsets of its pieces. A level meets itself: each node computes
the numbers of its siblings (its own with the last bit flipped for two children, slot offsets otherwise) and finds them by
an equijoin; the nodes in slot zero then emit the parents. The roots of the groups are the leaves of a second tree. Paths
come down the same levels, one equijoin of nodes with the paths of their parents each. Keys are single nodes, so no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import if_small, materialize, table

#: Levels of paths between two cuts of the lineage.
CUT = 6
_NODE = ["g", "idx", "n", "digest"]
_PATH = "array<struct<before:string,after:string>>"


def encoded(*values: Column) -> Column:
    """Each value as its byte count, a colon and its text, `-` for null; one after the other."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def record_hash(*values: Column) -> Column:
    """SHA-256 of :func:`encoded`, in lowercase hex."""
    return F.sha2(encoded(*values), 256)


def _group_key(group: Column) -> Column:
    """Never null, and in the order of the group: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``idx``, the place of a row in its group from 0 on, and ``n``, the size of the group; nulls come first.

    Rows are sorted over ranges, numbered inside each range, and moved on by the sizes of the pieces before theirs. Only the
    sizes of pieces, one row for each range and group, are added up in a window.
    """
    keys = [F.col(c).asc_nulls_first() for c in [group, *order]]
    by_range = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_seq", F.monotonically_increasing_id())
    by_range = materialize(by_range, "numbered").withColumn("_piece", F.shiftright("_seq", 33))
    pieces = by_range.groupBy(group, "_piece").agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(group)
    before = F.sum("_rows").over(whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select(group, "_piece", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    found = by_range.join(if_small(materialize(pieces, "pieces"), 80), [group, "_piece"])
    return found.withColumn("idx", F.col("_seq") + F.col("_shift")).drop("_seq", "_piece", "_shift")


def _met(level: DataFrame, fanout: int) -> DataFrame:
    """``level`` with the digests of the siblings ``before`` and ``after`` each node, both joined left to right."""
    nodes = level.filter("n > 1")
    slot = F.col("idx") % fanout
    siblings = []
    for shift in range(1, fanout):
        place = (slot + shift) % fanout
        number = F.expr("idx ^ 1") if fanout == 2 else F.col("idx") - slot + place
        other = level.filter("n > 1").select(F.col("g").alias("_g"), F.col("idx").alias("_at"), F.col("digest").alias(f"_d{shift}"))
        nodes = nodes.withColumn("_number", number).join(other, (F.col("g") == F.col("_g")) & (F.col("_number") == F.col("_at")), "left")
        nodes = nodes.drop("_g", "_at", "_number")
        siblings.append((place, F.col(f"_d{shift}")))

    def side(is_before: bool) -> Column:
        texts = [F.struct(place.alias("place"), F.when((place < slot) == F.lit(is_before), d).alias("digest")) for place, d in siblings]
        ordered = F.array(*texts) if fanout == 2 else F.array_sort(F.array(*texts))
        return F.array_join(F.transform(ordered, lambda s: s["digest"]), "")  # leaves out nulls

    return nodes.select(*level.columns, side(True).alias("before"), side(False).alias("after"))


def _parents(met: DataFrame, fanout: int) -> DataFrame:
    """Nodes in slot zero emit the hash of their run."""
    heads = met.filter(F.col("idx") % fanout == 0)
    return heads.select("g", F.expr(f"idx DIV {fanout}").alias("idx"), F.expr(f"(n + {fanout - 1}) DIV {fanout}").alias("n"),
                        F.sha2(F.concat("digest", "after"), 256).alias("digest"))


def climb(leaves: DataFrame, fanout: int = 2) -> tuple[list[DataFrame], DataFrame]:
    """The levels with their siblings, leaves first, and (g, height, digest) of the root of each group.

    ``leaves`` is a written table of g, idx, n, digest and any more columns, which the first level keeps. A node left over at the
    end of a level is hashed by itself.
    """
    widest = leaves.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    roots = leaves.filter("n = 1").select("g", F.lit(0).alias("height"), "digest")
    level = leaves
    while widest > 1:
        met = materialize(_met(level, fanout), f"level-{len(levels)}")
        levels.append(met)
        level = _parents(met, fanout)
        roots = roots.unionByName(level.filter("n = 1").select("g", F.lit(len(levels)).alias("height"), "digest"))
        widest = -(-widest // fanout)
    return levels, materialize(roots, "roots")


def descend(levels: list[DataFrame], tops: DataFrame, fanout: int = 2) -> DataFrame:
    """``path`` for each leaf of groups with two leaves or more: the siblings of each level from the leaf up, then the path in ``tops``.

    ``tops`` is a table (g, height, path) that says how the path of a root goes on.
    """
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        above = tops.filter(F.col("height") == k + 1).select("g", F.lit(0).cast("bigint").alias("idx"), "path")
        if paths is not None:
            above = above.unionByName(paths.select("g", "idx", "path"))
        above = above.select(F.col("g").alias("_g"), F.col("idx").alias("_up"), F.col("path").alias("_path"))
        met = levels[k].withColumn("_parent", F.expr(f"idx DIV {fanout}"))
        joined = met.join(above, (F.col("g") == F.col("_g")) & (F.col("_parent") == F.col("_up")))
        step = F.array(F.struct("before", "after"))
        keep = [c for c in levels[k].columns if c not in ("before", "after")] if k == 0 else ["g", "idx"]
        paths = joined.select(*keep, F.concat(step, "_path").alias("path"))
        if k and k % CUT == 0:
            paths = materialize(paths, f"paths-{k}")
    return paths


def fold(leaf: Column, path: Column) -> Column:
    """Root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


def path_hash(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(df: DataFrame, id_col: str, group_col: str, leaf: Column, also: dict[str, Column] | None = None, fanout: int = 2) -> DataFrame:
    """One row for each row of ``df``: the id, ``leaf``, ``subroot``, ``root``, ``path`` (before, after) and the columns of ``also``.

    ``leaf`` is the digest of a row. Leaves of a group ascend by id, null ids first, equal ids by digest; equal rows are
    interchangeable and each keeps a place of its own. Groups are ordered by bytes, the null group first. A lone leaf is its
    group's root, a lone group root is the root. An empty table gives no rows. Names of the columns of ``df`` don't matter.
    """
    also = also or {}
    extra = [F.col(f"also.{name}").alias(name) for name in also]
    more = F.struct(*[c.alias(name) for name, c in also.items()]) if also else F.struct(F.lit(0).alias("none"))
    rows = df.select(_group_key(F.col(group_col)).alias("g"), F.col(id_col).alias("id"), leaf.alias("digest"), more.alias("also"))
    rows = materialize(rows.withColumn("copy", F.monotonically_increasing_id()), "leaves")
    leaves = materialize(numbered(rows, "g", ["id", "digest", "copy"]).select(*_NODE, "id", "also"), "places")
    levels, roots = climb(leaves, fanout)

    second = roots.select(F.lit("").alias("g"), F.col("g").alias("of"), "height", "digest")
    second = materialize(numbered(second, "g", ["of"]).select(*_NODE, "of", "height"), "second")
    upper, top = climb(second, fanout)
    none = F.array().cast(_PATH)
    lone = second.filter("n = 1").withColumn("path", none)
    tops = descend(upper, top.select("g", "height", none.alias("path")), fanout) if upper else lone
    tops = materialize(tops.select(F.col("of").alias("g"), "height", F.col("digest").alias("subroot"), "path"), "tops")
    root = top.select(F.col("digest").alias("root"))

    singles = leaves.filter("n = 1").join(tops.select("g", "path"), "g").select(*_NODE, "id", "also", "path")
    paths = singles.unionByName(descend(levels, tops, fanout)) if levels else singles
    subroots = tops.select(F.col("g").alias("_g"), "subroot")
    done = paths.join(if_small(subroots, 100), F.col("g") == F.col("_g"))
    # a table of one row
    done = done.withColumn("root", root.scalar())
    return done.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "path", *extra)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    leaf = record_hash(*[F.col(c) for c in FIELDS])
    touched = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = F.when(touched, record_hash(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]))
    rows = manifest(docs, "doc_id", "lang", leaf, {"changed": changed})
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", path_hash(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {"op11_merkle": op11}

_CRC = """list_reduce([4294967295::BIGINT] || list_transform(range(length(s) * 8), lambda i: CASE WHEN i % 8 = 0 THEN ascii(s[(i // 8 + 1)::INT])::BIGINT ELSE 0 END),
  lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)))"""
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


ORACLE = {"op11_merkle": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, {_leaf_sql('n_chars')} AS leaf, {_leaf_sql('(n_chars + 1)')} AS other,
    coalesce(doc_id::VARCHAR, '') AS s, row_number() OVER (ORDER BY doc_id) AS copy FROM documents),
l AS (SELECT *, xor({_CRC}, 4294967295) % 7 = 0 AND doc_id IS NOT NULL AS touched,
    row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, copy) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM d),
a (g, h, idx, n, digest) AS (
  SELECT g, 0, idx, n, leaf FROM l
  UNION ALL SELECT g, h + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM a WHERE n > 1 GROUP BY g, h, idx // 2, n),
r AS (SELECT g, h, digest, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM a WHERE n = 1),
b (h, idx, n, digest) AS (
  SELECT 0, idx, n, digest FROM r
  UNION ALL SELECT h + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM b WHERE n > 1 GROUP BY h, idx // 2, n),
o AS (
  SELECT l.copy, a.h AS step, a.digest, a.idx % 2 = 0 AS first
  FROM l JOIN a ON a.g = l.g AND a.n > 1 AND a.idx = xor(l.idx >> a.h, 1)
  UNION ALL
  SELECT l.copy, 1000 + b.h, b.digest, b.idx % 2 = 0
  FROM l JOIN r ON r.g = l.g JOIN b ON b.n > 1 AND b.idx = xor(r.idx >> b.h, 1)),
steps AS (
  SELECT l.copy, a.h AS step FROM l JOIN a ON a.g = l.g AND a.n > 1 AND a.idx = l.idx >> a.h
  UNION ALL SELECT l.copy, 1000 + b.h FROM l JOIN r ON r.g = l.g JOIN b ON b.n > 1 AND b.idx = r.idx >> b.h),
p AS (
  SELECT s.copy, row_number() OVER (PARTITION BY s.copy ORDER BY s.step) AS k, o.digest, o.first
  FROM steps s LEFT JOIN o ON o.copy = s.copy AND o.step = s.step),
f (copy, k, digest) AS (
  SELECT copy, 0, CASE WHEN touched THEN other ELSE leaf END FROM l
  UNION ALL SELECT f.copy, f.k + 1, sha256(CASE WHEN p.first THEN coalesce(p.digest, '') || f.digest ELSE f.digest || coalesce(p.digest, '') END)
  FROM f JOIN p ON p.copy = f.copy AND p.k = f.k + 1),
q AS (SELECT copy, string_agg(digest, '' ORDER BY k) AS proof FROM p GROUP BY copy)
SELECT l.doc_id, l.leaf, r.digest AS subroot, t.digest AS root, sha256(coalesce(q.proof, '')) AS proof_sha256, e.digest AS folded_root, e.digest = t.digest AS verified
FROM l JOIN r ON r.g = l.g CROSS JOIN (SELECT digest FROM b WHERE n = 1) t LEFT JOIN q ON q.copy = l.copy
JOIN (SELECT copy, max_by(digest, k) AS digest FROM f GROUP BY copy) e ON e.copy = l.copy
"""}
