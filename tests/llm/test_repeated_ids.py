"""Rows that share an id, or have none, are told apart by their text."""

import hashlib
import random
import re

import pytest

from fieldmark.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string"


def _run(spark, rows, group=substring_dedup.GROUP):
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), group=group).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr)


def _kept(text, gone=()):
    return hashlib.sha256(" ".join(w for i, w in enumerate(WORD.findall(text)) if i not in gone).encode()).hexdigest()


@pytest.mark.parametrize("group", [substring_dedup.GROUP, 5])
def test_null_and_repeated_ids_lose_only_their_own_words(spark, group):
    passage = " ".join(f"p{i}" for i in range(30))
    repeating = passage + " x y z " + passage
    short, other = "one two three", " ".join(f"d{i}" for i in range(300))
    rows = [(None, repeating), (None, short), (7, other), (8, other[::-1]), (8, "a b"), (8, "a b"), (None, None)]
    want = [(None, 63, 30, _kept(repeating, range(33, 63))), (None, 3, 0, _kept(short)), (7, 300, 0, _kept(other)), (8, 300, 0, _kept(other[::-1])),
            (8, 2, 0, _kept("a b")), (8, 2, 0, _kept("a b")), (None, 0, 0, _kept(""))]
    assert _run(spark, rows, group) == sorted(want, key=repr)
    assert _run(spark, rows[:2], group) == sorted(want[:2], key=repr)


@pytest.mark.parametrize("group", [substring_dedup.GROUP, 5])
def test_rows_that_share_an_id_but_not_the_text_are_documents(spark, group):
    draw = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(f"u{k}x{i}" for i in range(draw.randint(3, 12))) + " " + passage for k in range(4)]
    rows = [(5, t) for t in texts] + [(5, texts[0])]  # and one row twice
    got = _run(spark, rows, group)
    whole = [r for r in got if r[2] == 0]
    assert len({r[3] for r in whole}) == 1  # one document keeps the passage
    assert len(whole) == (2 if whole[0][3] == _kept(texts[0]) else 1)
    assert all(r[2] in (0, 40) for r in got)
