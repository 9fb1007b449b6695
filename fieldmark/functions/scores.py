"""Cell-level score terms and row-level ranking scores.

``y`` is the target and ``p`` the prediction. Logarithms follow IEEE rules (ln 0 = -inf, ln of a negative = NaN)
because Spark's ``ln`` returns NULL there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmark.functions import arrays

# Fixed value: the offset of the smoothed cross entropy.
EPSILON = 1e-7


def _const(v: float) -> Column:
    return F.lit(float(v))


def ieee_ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).when(x == 0, _const("-inf")).otherwise(_const("nan"))


def skip_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def kl_bernoulli(y: Column, p: Column) -> Column:
    """y ln(y/p) + (1-y) ln((1-y)/(1-p)); a part whose weight is 0 counts 0, an impossible event counts infinity."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a == 0, 0.0).when(b == 0, _const("inf")).otherwise(a * F.ln(a / F.when(b != 0, b)))

    return part(y, p) + part(1 - y, 1 - p)


def cross_entropy(y: Column, p: Column, present: float = 1.0, absent: float = 1.0, eps: float = 0.0) -> Column:
    e = _const(eps)
    return _const(-present) * y * ieee_ln(p + e) - _const(absent) * (1 - y) * ieee_ln(1 - p + e)


def checklist_weight(n: Column, kind: str) -> Column:
    return {"sqrt": F.sqrt(n), "log": F.ln(n), "nchklists": n.cast("double")}[kind]


def squared_log_error(y: Column, p: Column) -> Column:
    d = F.log1p(p) - F.log1p(y)
    return d * d


def agreement(y: Column, p: Column, threshold: float) -> Column:
    t = _const(threshold)
    return F.when((p > t) == (y > t), 1.0).otherwise(0.0)


def clipped_cross_entropy(y: Column, p: Column) -> Column:
    """Cross entropy after lifting negative predictions to 0; undefined cells are skipped."""
    return skip_nan(cross_entropy(y, F.greatest(p, F.lit(0.0))))


def binary_log_loss(y: Column, p: Column) -> Column:
    q = F.when(p >= 0.5, 0.999).otherwise(0.001)
    b = F.when(y > 0, 1.0).otherwise(0.0)
    return -b * F.ln(q) - (1 - b) * F.ln(1 - q)


def focal(mean_ce: Column, alpha: float = 1.0, gamma: float = 2.0) -> Column:
    return _const(alpha) * F.pow(1 - F.exp(-mean_ce), _const(gamma)) * mean_ce


def top_overlap(y: Column, p: Column, limit: int | None = None, both: bool = False) -> Column:
    """Share of the target's leading species found among the prediction's, NULL without a non-zero target.

    k = number of non-zero targets. ``limit`` bounds the target side and the denominator; the prediction always takes
    ``limit`` species, or min(k, limit) when ``both``. Ties rank by position.
    """
    k = arrays.nonzero_count(y)
    bounded = k if limit is None else F.least(k, F.lit(limit))
    taken = bounded if limit is None or both else F.lit(limit)
    shared = F.size(F.array_intersect(arrays.top_positions(p, taken), arrays.top_positions(y, bounded)))
    return F.when(k > 0, shared / bounded)


def hits_in_present(y: Column, p: Column) -> Column:
    """Share of the k leading predictions that are non-zero targets, -1 without any."""
    k = arrays.nonzero_count(y)
    positions = F.filter(F.transform(y, lambda v, i: F.when(v != 0, i)), lambda i: i.isNotNull())
    return F.when(k > 0, F.size(F.array_intersect(arrays.top_positions(p, k), positions)) / k).otherwise(-1.0)


def ranks(values: Column) -> Column:
    """1-based rank per position by falling value, ties by position."""
    placed = F.transform(arrays.argsort_desc(values), lambda idx, r: F.struct(idx.alias("idx"), (r + 1).alias("rank")))
    return F.transform(F.sort_array(placed), lambda s: s["rank"])


def display_band(topk: Column) -> Column:
    """Band 0-7 of a per-hotspot score; later rules win over earlier ones."""
    band = F.lit(7)
    for limit, number in ((0.85, 6), (0.75, 5), (0.65, 4), (0.55, 3), (0.45, 2)):
        band = F.when(topk < limit, number).otherwise(band)
    return F.when(topk == 0, 1).when(topk == -1, 0).otherwise(band)
