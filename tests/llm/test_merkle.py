"""Merkle manifest against a plain reading of its definition."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from fieldmark.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, path string, g string, idx bigint"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves, k=2):
    """(root, the siblings of each leaf by level as (before, after))."""
    paths, owner, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(level) > 1:
        up, owners = [], []
        for s in range(0, len(level), k):
            run = level[s:s + k]
            for j in range(len(run)):
                for leaf in owner[s + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(H("".join(run)))
            owners.append(sum(owner[s:s + k], []))
        level, owner = up, owners
    return level[0], paths


def brute(rows, k=2):
    """(id, leaf, subroot, root, path) of each row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], k) for g in order}
    root, upper = tree([trees[g][0] for g in order], k)
    out = []
    for g, above in zip(order, upper):
        for x, path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            out.append((x[3][0], x[2], trees[g][0], root, path + above))
    return out


def _rows():
    rows = [(i, f"text {i} é😀", "en", "web", i % 50) for i in range(1, 300)]
    rows += [(i, None if i % 5 else "", "de", None, None) for i in range(300, 337)]
    rows += [(1000, "alone", "fr", "a", 5), (None, "x", None, "b", 1), (None, "x", None, "b", 1), (None, "y", None, "b", 1), (7, "again", "en", "web", 3),
             (7, "again", "en", "web", 3), (7, "other", "en", "web", 4), (1001, "w " * 30_000, "", "b", 2), (14, "blank language", "", "", 0)]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "l", "p", "g", 0) for r in rows], SCHEMA)


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_matches_plain_trees(spark, fanout):
    rows = _rows()
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    got = merkle.manifest(_frame(spark, rows), "doc_id", "lang", merkle.record_hash(*[F.col(c) for c in fields]), fanout=fanout).collect()
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.path]) for r in got]
    assert sorted(got, key=repr) == sorted(brute(rows, fanout), key=repr)


def test_query_folds_changed_leaves(spark, tmp_path):
    rows = _rows()
    _frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    by_leaf = {leaf_of(*r): r for r in rows}
    want = []
    for doc_id, leaf, subroot, root, path in brute(rows):
        r = list(by_leaf[leaf])
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and r[4] is not None:
            r[4] += 1
        digest = leaf_of(*r)
        for before, after in path:
            digest = H(before + digest + after)
        want.append((doc_id, leaf, subroot, root, H("".join(a + b for a, b in path)), digest, digest == root))
    got = [tuple(r) for r in merkle.op11(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("count", [0, 1, 2])
def test_small_tables(spark, count):
    rows = _rows()[:count]
    got = merkle.manifest(_frame(spark, rows), "doc_id", "lang", merkle.record_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text")))
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.path]) for r in got.collect()]
    assert sorted(got) == sorted(brute(rows) if rows else [])
