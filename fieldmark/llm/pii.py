"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score. DataFrame functions only.

Patterns are written for linear time and bounded stack: runs are possessive, may only begin where a run begins, and
repeated groups have a small upper bound.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm.common import table

SPAN = "array<struct<kind:string,start:int,end:int,found:string,score:double>>"
#: Code points on either side that are searched for context words.
WINDOW = 40
#: Kinds outside the base are reported from this score on.
LEAST_SCORE = 0.6
#: A dot that doesn't begin a domain label is turned into this sign while e-mail addresses are searched for.
_NO_LABEL, _TAKEN = "", ""


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(found: Column) -> Column:
    digits = _digits(found)
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return n.between(16, 19) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0)


def mod97(found: Column) -> Column:
    """The check of an international account number: letters count as 10 to 35, the first four signs go last."""
    plain = F.regexp_replace(found, "[^A-Z0-9]", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def octets(found: Column) -> Column:
    def fits(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+", "")
        return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(found, r"\."), fits)


def phone_length(found: Column) -> Column:
    return F.length(_digits(found)).between(8, 15)


@dataclass(frozen=True)
class Kind:
    """A pattern, a cheap test that texts without it fail, the check of a proposed span and the words that speak for it."""

    name: str
    pattern: str
    hint: Callable[[Column], Column]
    check: Callable[[Column], Column] | None
    score: float
    words: tuple[str, ...]
    base: bool = True
    prepared: Callable[[Column], Column] = field(default=lambda text: text)
    #: If given, the pattern finds only where spans begin; this makes of (text, start) the span, or '' if there is none.
    grown: Callable[[Column, Column], Column] | None = None


def _has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


def _labels(text: Column) -> Column:
    free = F.when(text.contains(_NO_LABEL), F.translate(text, _NO_LABEL, _TAKEN)).otherwise(text)
    return F.regexp_replace(free, r"\.(?![A-Za-z0-9-])", _NO_LABEL)


#: Ends of an account number after its first four signs: groups of four, and signs left over.
_ENDS = [rf"^[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{k}}}{tail}(?![A-Za-z0-9])"
         for k in range(7, 1, -1) for tail in (r"\x20?[A-Z0-9]{3}", r"\x20?[A-Z0-9]{2}", r"\x20?[A-Z0-9]", "")]


def longest_account(text: Column, start: Column) -> Column:
    """The longest account number at ``start`` whose check holds, '' if there is none; words after it may look like part of it."""
    piece = F.substring(text, start + 1, F.lit(48))
    ends = F.array(*[F.regexp_extract(piece, end, 0) for end in _ENDS])
    return F.coalesce(F.get(F.filter(ends, lambda x: (x != "") & mod97(x)), F.lit(0)), F.lit(""))


KINDS = (
    Kind("email", rf"(?:(?<![A-Za-z0-9._%+{_NO_LABEL}-])|\G)[A-Za-z0-9._%+{_NO_LABEL}-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++",
         lambda t: t.contains("@"), None, 0.8, ("mail", "contact", "write", "reach"), prepared=_labels),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"), octets, 0.6, ("ip", "host", "server", "address")),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", _has_digit, luhn, 0.7,
         ("card", "visa", "credit", "pay", "charge")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.rlike(r"\+[0-9]"), phone_length, 0.6, ("phone", "call", "tel", "mobile", "fax")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]{4}){2})", _has_digit, None, 0.7,
         ("iban", "account", "bank", "transfer"), base=False, grown=longest_account),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _has_digit, None, 0.4, ("ssn", "social", "security", "tax"), base=False),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _located(text: Column, pattern: str) -> Column:
    """array<struct<start, found>> of the matches: the pieces between them give the positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,found:string>>").alias("out"))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        return F.struct((start + F.length(x["found"])).alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), x["found"].alias("found")))).alias("out"))

    laid = F.zip_with(pieces, found, lambda p, f: F.struct(F.length(p).alias("gap"), f.alias("found")))
    return F.aggregate(laid, begin, add, lambda s: s["out"])


def _apart(spans: Column) -> Column:
    """The spans that aren't empty, without those that begin inside an earlier one."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,found:string>>").alias("out"))

    def add(state: Column, x: Column) -> Column:
        use = (x["found"] != "") & (x["start"] >= state["at"])
        return F.struct(F.when(use, x["start"] + F.length(x["found"])).otherwise(state["at"]).alias("at"),
                        F.when(use, F.concat(state["out"], F.array(x))).otherwise(state["out"]).alias("out"))

    return F.aggregate(spans, begin, add, lambda s: s["out"])


def spans_of(text: Column, kind: Kind) -> Column:
    """Confirmed and scored spans of one kind; positions are code points, ends are exclusive."""
    ready = kind.prepared(text)
    spans = F.when(kind.hint(text) & ready.rlike(kind.pattern), _located(ready, kind.pattern))
    if kind.grown:
        spans = _apart(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), kind.grown(text, x["start"]).alias("found"))))
    if kind.check:
        spans = F.filter(spans, lambda x: kind.check(x["found"]))

    def scored(x: Column) -> Column:
        length = F.length(x["found"])
        start = F.greatest(F.lit(0), x["start"] - WINDOW)
        around = F.lower(F.substring(text, start + 1, length + 2 * WINDOW))
        near = F.lit(False)
        for word in kind.words:
            near = near | around.contains(word)
        score = F.lit(kind.score) + F.when(near, 0.2).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), (x["start"] + length).alias("end"),
                        F.substring(text, x["start"] + 1, length).alias("found"), score.alias("score"))

    spans = F.transform(spans, scored)
    if not kind.base:
        spans = F.filter(spans, lambda x: x["score"] >= LEAST_SCORE)
    return F.coalesce(spans, F.array().cast(SPAN))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: the id column and ``spans`` (kind, start, end, found, score), by kind as listed, then start.

    Null text counts as empty and has no spans; every row is worked on by itself, so repeated rows and null ids stay, and an
    empty table gives no rows.
    """
    texts = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return texts.select(F.col("_id").alias(id_col), F.concat(*[spans_of(F.col("_text"), k) for k in KINDS]).alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, redacted): every span of the texts replaced by its kind; overlapping spans are covered once."""
    texts = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    spans = F.array_sort(F.concat(*[F.transform(spans_of(F.col("_text"), k), lambda x: F.struct(x["start"], x["end"], x["kind"])) for k in KINDS]))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(state: Column, x: Column) -> Column:
        gap = F.greatest(F.lit(0), x["start"] - state["at"])
        before = F.substring(F.col("_text"), state["at"] + 1, gap)
        mark = F.when(x["start"] >= state["at"], F.concat(F.lit("<"), x["kind"], F.lit(">"))).otherwise("")
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.concat(state["out"], before, mark).alias("out"))

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substring(F.col("_text"), state["at"] + 1, F.length("_text")))

    return texts.select(F.col("_id").alias(id_col), F.aggregate(spans, start, add, finish).alias("redacted"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of_kind(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[_of_kind(k.name).alias(f"n_{k.name}") for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"), F.array_max(F.transform("spans", lambda x: x["score"])).alias("max_score"))


QUERIES = {"op4_pii": op4}
ORACLE: dict[str, str] = {}
