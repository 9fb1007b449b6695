"""Words of an Arrow string column as 64-bit hashes, without a Python object for each word.

Used inside ``mapInArrow`` tasks. Words are maximal runs of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return; a text is worked on whole, in groups of texts of about ``CHUNK`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: 0 blank, 1 letters and digits (and every byte of other scripts), 2 other signs
_KIND = np.where(_BLANK, 0, 2).astype(np.uint8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_EXACT = mix(np.arange(1, 257, dtype=np.uint64))
_LOWER = _EXACT.copy()
_LOWER[65:91] = _LOWER[97:123]
#: Powers of an odd number and of its inverse modulo 2 ** 64, longer when a text needs it.
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(max(n, CHUNK + 1), base)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair, the same wherever the span stands."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


@dataclass
class Words:
    """Words of some texts: hash, byte span in ``data``, and for each text its first word (one entry more than texts)."""

    data: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    begin: int  # of these texts in the batch
    stop: int

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def word(self, k: int) -> str:
        return self.data[self.start[k]:self.end[k]].tobytes().decode("utf-8", "replace")


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), offsets


def words(column: pa.Array, lower: bool = True, signs: bool = False, chunk: int = CHUNK) -> Iterator[Words]:
    """The words of each group of texts in turn; hashes ignore the case of A-Z if ``lower``.

    With ``signs``, runs of signs are words of their own.
    """
    if not len(column):
        return
    data, offsets = column_bytes(column)
    begin = 0
    while begin < len(column):
        stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + chunk, "right")) - 1)
        stop = min(stop, len(column))
        yield _words(data[offsets[begin]:offsets[stop]], offsets[begin:stop + 1] - offsets[begin], lower, signs, begin, stop)
        begin = stop


def _words(data: np.ndarray, offsets: np.ndarray, lower: bool, signs: bool, begin: int, stop: int) -> Words:
    none = np.zeros(0, dtype=np.int64)
    if not len(data):
        return Words(data, np.zeros(len(offsets), dtype=np.int64), none.astype(np.uint64), none, none, begin, stop)
    solid = ~_BLANK[data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    if signs:
        turn = np.flatnonzero(np.diff(_KIND[data]))
        closes[turn] = solid[turn]
        opens[turn + 1] = solid[turn + 1]
    full = np.flatnonzero(np.diff(offsets))
    edge = offsets[full]
    opens[edge] = solid[edge]
    edge = offsets[full + 1] - 1
    closes[edge] = solid[edge]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = _spans((_LOWER if lower else _EXACT)[data], start, end)
    return Words(data, np.searchsorted(start, offsets), hashes, start, end, begin, stop)


def windows(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``n`` words inside one text."""
    total = len(found.hash)
    if total < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    text = found.text_of()
    at = np.flatnonzero(text[:total - n + 1] == text[n - 1:])
    return at, _spans(found.hash, at, at + n)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    flat = pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), flat)
