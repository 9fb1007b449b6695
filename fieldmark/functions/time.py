"""Partial dates as closed intervals."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Calendar units from coarse to fine; a text pins the finest one that has all coarser ones pinned, too.
UNITS = ("year", "month", "day", "hour", "minute", "second", "microsecond")


class Directive(NamedTuple):
    """What one date directive contributes: its Spark pattern and the units that it pins."""

    pattern: str
    units: tuple[str, ...]


#: Weeks and weekdays, which Spark's parser doesn't read: the text they match; dates follow by calendar arithmetic.
WEEKLY = {"%a": r"[A-Za-z]{3}", "%A": r"[A-Za-z]+", "%w": r"[0-6]", "%u": r"[1-7]", "%U": r"\d{1,2}", "%W": r"\d{1,2}", "%V": r"\d{1,2}", "%G": r"\d{4}"}
#: Their text depends on the locale of whoever wrote it.
LOCALE = ("%c", "%x", "%X", "%Z", "%z")

# The meaning of the date directives in use.
DIRECTIVES = {
    "%Y": Directive("yyyy", ("year",)), "%y": Directive("yy", ("year",)),
    "%m": Directive("MM", ("month",)), "%b": Directive("MMM", ("month",)), "%B": Directive("MMMM", ("month",)),
    "%d": Directive("dd", ("day",)), "%j": Directive("DDD", ("month", "day")),
    "%H": Directive("HH", ("hour",)), "%I": Directive("hh", ("hour",)), "%p": Directive("a", ()),
    "%M": Directive("mm", ("minute",)), "%S": Directive("ss", ("second",)), "%f": Directive("SSSSSS", ("microsecond",)),
}


def _parts(fmt: str) -> list[str]:
    """Directives and the text between them."""
    parts = [p for p in re.split(r"(%.)", fmt) if p]
    unknown = [p for p in parts if p.startswith("%") and p not in DIRECTIVES and p not in WEEKLY and p != "%%"]
    if unknown and unknown[0] in LOCALE:
        raise ValueError(f"{unknown[0]} in {fmt} depends on a locale or time zone, which a file name doesn't tell")
    if unknown:
        raise ValueError(f"unsupported date directive {unknown[0]} in {fmt}")
    return parts


def resolution(fmt: str) -> str | None:
    """Finest unit that a format pins, None when it has no year."""
    parts = _parts(fmt)
    pinned = {unit for part in parts if part in DIRECTIVES for unit in DIRECTIVES[part].units}
    if "%G" in parts and "%V" not in parts:
        raise ValueError(f"%G in {fmt} needs %V")
    if any(p in parts for p in ("%U", "%W", "%V")):
        if not any(p in parts for p in ("%a", "%A", "%w", "%u")):
            raise ValueError(f"a week without a weekday in {fmt} is neither a month nor a day")
        if "%V" in parts and "%G" not in parts:
            raise ValueError(f"%V in {fmt} needs %G")
        pinned |= {"year", "month", "day"} if "%G" in parts else {"month", "day"}
    finest = None
    for unit in UNITS:
        if unit not in pinned:
            break
        finest = unit
    return finest


def spark_pattern(fmt: str) -> str:
    plain = lambda text: re.sub(r"[A-Za-z']+", lambda m: "'" + m.group().replace("'", "''") + "'", text)
    return "".join(DIRECTIVES[p].pattern if p in DIRECTIVES else "%" if p == "%%" else plain(p) for p in _parts(fmt))


_TEXTS = {"%Y": r"\d{4}", "%j": r"\d{3}", "%b": r"[A-Za-z]{3}", "%B": r"[A-Za-z]+", "%p": r"[AaPp][Mm]", "%f": r"\d{6}"}
_DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def _weekly(text: Column, fmt: str) -> Column:
    """Timestamp of a text whose format names weeks or weekdays, NULL if it doesn't match.

    A regular expression takes the text apart; what Spark's parser reads goes there, weeks become days of the year. A weekday
    beside a full date says nothing more and isn't held against it.
    """
    parts = _parts(fmt)
    groups = [p for p in parts if p in DIRECTIVES or p in WEEKLY]
    expression = "^" + "".join(f"({WEEKLY.get(p) or _TEXTS.get(p, '[0-9]{2}')})" if p in groups else re.escape("%" if p == "%%" else p) for p in parts) + "$"
    piece = {p: F.regexp_extract(text, expression, k + 1) for k, p in enumerate(groups)}
    plain = [p for p in groups if p in DIRECTIVES]
    matched = F.regexp_like(text, F.lit(expression))
    read = F.try_to_timestamp(F.concat_ws("|", *[piece[p] for p in plain]), F.lit("|".join(DIRECTIVES[p].pattern for p in plain))) if plain else None
    week = next((p for p in ("%V", "%U", "%W") if p in piece), None)
    if week is None:
        return F.when(matched, read)

    def number(p: str) -> Column:
        return piece[p].try_cast("int")

    if "%u" in piece:
        weekday = number("%u") - 1  # 0 is Monday
    elif "%w" in piece:
        weekday = (number("%w") + 6) % 7
    else:
        named = F.lower(F.substring(piece["%a" if "%a" in piece else "%A"], 1, 3))
        weekday = F.array_position(F.array(*[F.lit(d) for d in _DAYS]), named).cast("int") - 1
        weekday = F.when(weekday >= 0, weekday)
    if week == "%V":
        fourth = F.make_date(number("%G"), F.lit(1), F.lit(4))  # always in week one
        day = F.date_add(fourth, 7 * (number("%V") - 1) + weekday - F.weekday(fourth))
        inside = number("%V").between(1, 53)
    else:
        first = F.to_date(read) if "%Y" in piece or "%y" in piece else F.lit(None).cast("date")
        first = F.trunc(first, "year")
        shift = F.lit(0) if week == "%W" else F.lit(1)  # weeks begin on Monday or Sunday
        opening, place = (F.weekday(first) + shift) % 7, (weekday + shift) % 7
        before = F.when(number(week) == 0, place - opening).otherwise((7 - opening) % 7 + 7 * (number(week) - 1) + place)
        day = F.date_add(first, before)
        inside = number(week).between(0, 53)
    clock = F.when(F.lit(read is not None), read - F.date_trunc("day", read)) if read is not None else F.expr("INTERVAL 0 SECONDS")
    return F.when(matched & inside, day.cast("timestamp") + F.coalesce(clock, F.expr("INTERVAL '0 00:00:00' DAY TO SECOND")))


def interval_of(text: Column, fmt: str) -> Column:
    """STRUCT<mint, maxt>: [start - 1 us, next start - 1 us] of the part of time the text leaves open.

    A format without a year stands for all time: a struct whose ends are NULL. A text that doesn't parse has no interval:
    the struct itself is NULL, so filter on it before joining on time.
    """
    unit = resolution(fmt)
    if unit is None:
        nothing = F.lit(None).cast("timestamp_ntz")
        return F.struct(nothing.alias("mint"), nothing.alias("maxt"))
    parsed = _weekly(text, fmt) if any(p in WEEKLY for p in _parts(fmt)) else F.try_to_timestamp(text, F.lit(spark_pattern(fmt)))
    start = parsed.cast("timestamp_ntz")
    micro = F.expr("INTERVAL 1 MICROSECOND")
    found = F.struct((start - micro).alias("mint"), (start + F.expr(f"INTERVAL 1 {unit.upper()}") - micro).alias("maxt"))
    return F.when(start.isNotNull(), found)
