"""Runs of words against a brute force over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np

from fieldmark.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, key string, runs string"


def brute(words, least=12):
    """Every (start, length, period), the smallest period of each maximal stretch."""
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                best.setdefault((i, j + p), p)
            i = j
    return sorted((s, e - s, p) for (s, e), p in best.items())


def collapse(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()


def _numbers(words):
    return np.array([hash(w) & (2 ** 64 - 1) for w in words], dtype=np.uint64)


def _same(texts, least):
    words = np.concatenate([_numbers(t) for t in texts])
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first = np.r_[0, np.cumsum([len(t) for t in texts])]
    start, end, period = periodic.runs_of(words, text, least)
    got = [[] for _ in texts]
    for s, e, p in zip(start, end, period):
        k = text[s]
        got[k].append((int(s - first[k]), int(e - s), int(p)))
    for t, g in zip(texts, got):
        assert g == brute(t, least), t


def test_runs_of_random_words_match_brute_force():
    draw = random.Random(5)
    for _ in range(150):
        letters = "ab" if draw.random() < 0.6 else "abc"
        texts = []
        for _ in range(draw.randint(1, 6)):
            text = [draw.choice(letters) for _ in range(draw.randint(0, 60))]
            for _ in range(draw.randint(0, 3)):  # plant powers, also powers of powers
                root = [draw.choice(letters) for _ in range(draw.randint(1, 9))]
                k = draw.randint(0, len(text))
                text[k:k] = (root * draw.randint(2, 5) + root[:draw.randint(0, len(root))]) * draw.randint(1, 2)
            texts.append(text)
        _same(texts, draw.choice([2, 4, 12]))


def test_highly_periodic_texts():
    fibonacci = ["a", "b"]
    for _ in range(8):
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    morse = "a"
    for _ in range(7):
        morse += morse.translate(str.maketrans("ab", "ba"))
    block = "aab" * 9
    for text in (fibonacci[-1], morse, "a" * 200, "ab" * 90, block + "a" + block + "a" + block, (block + "a") * 3):
        for least in (2, 12):
            _same([list(text), list(text[3:])], least)


def _plant(doc_id, words):
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_query_matches_brute_force_on_odd_rows(spark, tmp_path):
    draw = random.Random(7)
    rows = [(None, "a b " * 30), (None, None), (3, ""), (3, " \t\n "), (4, "é ß 漢 😀 " * 7 + "x"), (4, "é ß 漢 😀 " * 7 + "x")]
    rows += [(i, "  ".join(f"w{draw.randint(0, 3 + i % 40)}" for _ in range(draw.randint(0, 220)))) for i in range(10, 150)]
    rows += [(9, "w " * 5000), (8, " ".join(f"v{i % 3001}" for i in range(20_000)))]
    spark.createDataFrame([(*r, "k", None) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in periodic.op13(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for doc_id, text in rows:
        words = _plant(doc_id, WORD.findall(text or ""))
        if doc_id == 8:
            runs = [(0, 20_000, 3001)] if words == [f"v{i % 3001}" for i in range(20_000)] else None
            assert runs, "choose an id that isn't changed"
        else:
            runs = brute(words) if len(words) < 1000 else [(0, len(words), 1)]
        s, n, p = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        want.append((doc_id, len(runs), s, n, p, 1000 * n // p if runs else None, hashlib.sha256(listed.encode()).hexdigest(), collapse(words, runs)))
    assert got == sorted(want, key=repr)
    assert any(r[1] for r in want if r[0] and r[0] >= 10)


def test_empty_table(spark):
    assert periodic.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0
