"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, and context windows around each hit.

Words and word stems that labelled text ties to the label form a small lexicon. Its trie is walked with the automaton of
every distinct word, so that misspelled terms are found in one pass. A window around the hit tells quotation from
abuse, and a logistic model turns the weights of a text's hits into a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import tokens
from fieldmark.llm.common import materialize, table
from fieldmark.llm.quality import held_out, labelled

#: Terms of the lexicon at most; lengths of the stems that are tried beside whole words.
TERMS = 400
STEMS = (4, 5, 6)
#: Terms shorter than this must match exactly; others may differ by one edit. Stems match exactly.
FUZZY_LEAST = 5
#: Words on either side that are searched for quotation marks and address.
WINDOW = 6
#: Distinct words whose match a task remembers.
REMEMBERED = 400_000
# Quotation marks and words of address.
QUOTES = "\"“”„«»‹›‘’"
ADDRESS = frozenset("you your youre u du dich dir dein tu te toi ton vous usted tú ti".split())
FEATURES = ("exact", "fuzzy", "quoted", "addressed")


def _insert(nodes: list[dict[str, int]], text: str) -> int:
    at = 0
    for sign in text:
        if sign not in nodes[at]:
            nodes[at][sign] = len(nodes)
            nodes.append({})
        at = nodes[at][sign]
    return at


class Trie:
    """Terms (text, weight) in a trie.

    Terms that end in ``*`` are stems and match any word that begins with them. Whole terms of ``FUZZY_LEAST`` letters or
    more are also in a trie of their own for automata, and reversed in another one.
    """

    def __init__(self, terms: list[tuple[str, float]]):
        self.weights = [weight for _, weight in terms]
        self.nodes: list[dict[str, int]] = [{}]
        self.whole: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        self.forward: tuple[list[dict[str, int]], dict[int, int]] = ([{}], {})
        self.backward: tuple[list[dict[str, int]], dict[int, int]] = ([{}], {})
        for k, (term, _) in enumerate(terms):
            text = term.rstrip("*")
            end = _insert(self.nodes, text)
            if term.endswith("*"):
                self.stem[end] = k
                continue
            self.whole[end] = k
            if len(text) >= FUZZY_LEAST:
                for (nodes, ends), signs in ((self.forward, text), (self.backward, text[::-1])):
                    ends[_insert(nodes, signs)] = k

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the best term: exact words and stems first, then words one edit away."""
        at, best = 0, None
        for k, sign in enumerate(word):
            at = self.nodes[at].get(sign, -1)
            if at < 0:
                break
            if at in self.stem and (best is None or self.weights[self.stem[at]] > self.weights[best]):
                best = self.stem[at]
            if k == len(word) - 1 and at in self.whole and (best is None or self.weights[self.whole[at]] >= self.weights[best]):
                best = self.whole[at]
        if best is not None:
            return best, 0
        if len(word) < FUZZY_LEAST - 1:
            return None
        # one edit leaves either the first or the second half of the word as it is
        half = len(word) // 2
        found = [self._automaton(*self.forward, word, half), self._automaton(*self.backward, word[::-1], len(word) - half)]
        best = max((k for k in found if k is not None), key=lambda k: self.weights[k], default=None)
        return None if best is None else (best, 1)

    def _automaton(self, nodes: list[dict[str, int]], ends: dict[int, int], word: str, same: int) -> int | None:
        """The best term one edit away that begins with the first ``same`` signs of the word: walk the trie below these with
        the states of the automaton of the rest, for each prefix of the rest the edits used so far."""
        at = 0
        for sign in word[:same]:
            at = nodes[at].get(sign, -1)
            if at < 0:
                return None
        found: int | None = None
        rest = word[same:]
        stack = [(at, tuple(min(i, 2) for i in range(len(rest) + 1)))]
        while stack:
            node, row = stack.pop()
            term = ends.get(node)
            if term is not None and row[-1] == 1 and (found is None or self.weights[term] > self.weights[found]):
                found = term
            for sign, child in nodes[node].items():
                new = [min(row[0] + 1, 2)]
                for i, own in enumerate(rest):
                    new.append(min(row[i] + (own != sign), row[i + 1] + 1, new[i] + 1, 2))
                if min(new) <= 1:
                    stack.append((child, tuple(new)))
        return found


def _words_of(text: Column) -> Column:
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"))
    return F.array_distinct(F.concat(F.filter(words, lambda w: F.length(w) >= 4), *[_stems(words, k) for k in STEMS]))


def _stems(words: Column, k: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))


def term_counts(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(term, p0, n0, p1, n1): labelled toxic and other texts with the term, for each half of the labelled rows."""
    rows = texts.join(F.broadcast(known), F.col("_id") == F.col("_labelled")).select("_good", "_half", F.explode(_words_of(F.col("_text"))).alias("term"))
    sums = [F.count(F.when((F.col("_half") == h) & (F.col("_good") == g), 1)).alias(f"{c}{h}") for h in (0, 1) for c, g in (("p", 1), ("n", 0))]
    return materialize(rows.groupBy("term").agg(*sums).filter("p0 + p1 >= 3"), "terms")


def learn_lexicon(counts: DataFrame, sizes: dict[tuple[int, int], int], halves: tuple[int, ...]) -> list[tuple[str, float]]:
    """Terms whose share among the toxic texts of the halves is far above their share among the others, with log odds."""
    toxic, clean = (sum(sizes.get((h, g), 0) for h in halves) for g in (1, 0))
    if not toxic or not clean:
        return []
    p, n = (sum((F.col(f"{c}{h}") for h in halves), F.lit(0)) for c in "pn")
    odds = F.log((p / F.lit(toxic)) / ((n + 0.5) / F.lit(clean + 1)))
    strong = counts.filter(p >= max(3, math.ceil(0.005 * toxic))).select("term", p.alias("p"), odds.alias("odds")).filter(F.col("odds") >= math.log(10))
    best = strong.orderBy((F.col("p") * F.col("odds")).desc(), "term").limit(TERMS)
    return [(r.term, float(r.odds)) for r in best.collect()]


class _Matcher:
    """Matches of distinct words, remembered within a task."""

    def __init__(self, trie: Trie):
        self.trie, self.seen = trie, {}

    def hits(self, found: tokens.Words) -> list[tuple[int, int, int]]:
        """(word, term, edits) of every hit among the words."""
        distinct, first, back = np.unique(found.hash, return_index=True, return_inverse=True)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        seen, codes = self.seen, np.full(len(distinct), -1, dtype=np.int64)
        for k, h in enumerate(distinct.tolist()):
            code = seen.get(h)
            if code is None:
                match = self.trie.match(found.word(first[k]).lower().strip(QUOTES))
                code = -1 if match is None else match[0] * 2 + match[1]
                seen[h] = code
            codes[k] = code
        at = np.flatnonzero(codes[back] >= 0)
        return [(int(i), int(c) // 2, int(c) % 2) for i, c in zip(at, codes[back][at])]


def _features(column: pa.Array, matcher: _Matcher) -> np.ndarray:
    """Weights of the hits of each text, by FEATURES."""
    out = np.zeros((len(column), len(FEATURES)))
    for found in tokens.words(column, signs=True):
        text = found.text_of()
        for i, term, edits in matcher.hits(found):
            own = text[i]
            low, high = max(int(found.first[own]), i - WINDOW), min(int(found.first[own + 1]), i + WINDOW + 1)
            before, after = [found.word(k) for k in range(low, i)], [found.word(k) for k in range(i + 1, high)]
            quoted = _marked(found.word(i)) or any(map(_marked, before)) and any(map(_marked, after))
            addressed = any(w.lower() in ADDRESS for w in before + after)
            weight = matcher.trie.weights[term]
            row = out[found.begin + own]
            row[2 if quoted else edits] += weight
            if addressed and not quoted:
                row[3] += weight
    return np.log1p(out)


def _marked(word: str) -> bool:
    return any(sign in QUOTES for sign in word)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps on a bounded sample; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], 0.1)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, terms: list[tuple[str, float]], weights: np.ndarray):
        self.terms, self.weights = terms, weights


def _run(texts: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """names, and the features of ``_text``."""
    shared = texts.sparkSession.sparkContext.broadcast(model.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(Trie(shared.value))
        for batch in batches:
            x = _features(batch.column("_text"), matcher)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(x[:, k]) for k in range(len(FEATURES))]], [*names, *FEATURES])

    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in names)
    return texts.select(*names, "_text").mapInArrow(run, kinds + "".join(f", {f} double" for f in FEATURES))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Lexicon and score from the bounded labelled sample; held-out rows are never read.

    The score is fitted on hits of lexicons that each half of the sample learned from the other half. Without labelled
    rows of both kinds the lexicon is empty and every score is the share of toxic rows (or 0).
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    half = F.when(F.crc32(F.col("_labelled").cast("string").cast("binary")) % 2 == 0, 0).otherwise(1)
    known = labelled(labels, label, id_col).select("_labelled", "_good", half.alias("_half"))
    sizes = {(r["_half"], r["_good"]): r["count"] for r in known.groupBy("_half", "_good").count().collect()}
    counts = term_counts(texts, known)
    x, y = [], []
    for own in (0, 1):
        terms = learn_lexicon(counts, sizes, (1 - own,))
        rows = texts.join(F.broadcast(known.filter(F.col("_half") == own)), F.col("_id") == F.col("_labelled"))
        for r in _run(rows, Model(terms, np.zeros(0)), ["_good"]).collect():  # half of the sample
            x.append([r[f] for f in FEATURES])
            y.append(float(r["_good"]))
    terms = learn_lexicon(counts, sizes, (0, 1))
    if not any(y) or all(y) or not terms:
        share = sum(y) / len(y) if y else 0.0
        bias = math.log(min(max(share, 1e-6), 1 - 1e-6) / max(1 - share, 1e-6))
        return Model(terms, np.array([0.0] * len(FEATURES) + [bias]))
    return Model(terms, _logistic(np.array(x), np.array(y)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, held_out, score, predicted and the features.

    Null and empty texts have no hits and get the score of a text without any; every row is scored by itself, so rows that
    repeat get the same score, null ids stay, and an empty table gives no rows.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = _run(texts, model, ["_id"])
    linear = F.lit(float(model.weights[-1]))
    for name, weight in zip(FEATURES, model.weights):
        linear = linear + F.col(name) * F.lit(float(weight))
    chance = 1 / (1 + F.exp(-linear))
    return found.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), chance.alias("score"),
                        F.when(chance >= 0.5, 1).otherwise(0).alias("predicted"), *FEATURES)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_toxicity": op10}
ORACLE: dict[str, str] = {}
