"""Row-level column expressions: banding, recoding, averaging, scaling.

Everything here returns a plain ``Column`` built from Spark's own functions, so it
stays inside whole-stage code generation and can be pushed around by Catalyst.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

# Score cut points and band names, level cut points and names.
SCORE_CUTS = (482.0, 607.0)
SCORE_BANDS = ("low", "middle", "high")
LEVEL_CUTS = (33.33, 66.67)
LEVEL_NAMES = ("low", "medium", "high")


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing(c: str | Column) -> Column:
    """True for null and for NaN; the argument must be numeric."""
    x = as_column(c)
    return x.isNull() | F.isnan(x)


def present(c: str | Column) -> Column:
    """The value, with NaN as null; the argument must be numeric."""
    x = as_column(c)
    return F.when(~F.isnan(x), x)


def band(
    value: str | Column,
    cuts: Sequence[float | Column],
    labels: Sequence[str],
    invalid: str = "null",
) -> Column:
    """Label half-open ranges: below ``cuts[0]``, ``[cuts[0], cuts[1])``, ..., the rest.

    A null or NaN value gets a null band; ``invalid="top"`` sends it to the last label.
    """
    if len(labels) != len(cuts) + 1:
        raise ValueError(f"{len(cuts)} cuts need {len(cuts) + 1} labels, got {len(labels)}")
    if invalid not in ("null", "top"):
        raise ValueError("invalid must be 'null' or 'top'")
    x = as_column(value)
    below = [(x < cut, label) for cut, label in zip(cuts, labels)]
    tests = below if invalid == "top" else [(is_missing(x), None), *below]
    first, *others = tests
    out = F.when(first[0], F.lit(first[1]))
    for test, label in others:
        out = out.when(test, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def score_band(score: str | Column, invalid: str = "null") -> Column:
    """low / middle / high by the two score cut points."""
    return band(score, SCORE_CUTS, SCORE_BANDS, invalid)


def index_level(index: str | Column, cuts: Sequence[float] = LEVEL_CUTS, invalid: str = "null") -> Column:
    """low / medium / high on a 0-100 index."""
    return band(index, cuts, LEVEL_NAMES, invalid)


def recode_missing(value: str | Column, codes: Sequence) -> Column:
    """Turn sentinel codes into null."""
    x = as_column(value)
    return F.when(~x.isin(list(codes)), x) if codes else x


def reflect(value: str | Column, top: float | Column) -> Column:
    """Reverse an item scored 1..top: ``top + 1 - x``; NaN gives null."""
    return (F.lit(top) + F.lit(1.0)) - present(value)


def map_labels(key: str | Column, labels: Mapping, default: str | None = None) -> Column:
    """Replace ids by labels; unknown ids become ``default``."""
    x = as_column(key)
    if not labels:
        return F.lit(default).cast("string")
    items = iter(labels.items())
    k, v = next(items)
    out = F.when(x == k, F.lit(v))
    for k, v in items:
        out = out.when(x == k, F.lit(v))
    return out.otherwise(F.lit(default).cast("string"))


def position_of(key: str | Column, ordered: Sequence) -> Column:
    """1-based place of a value in a short ordered list, null when absent."""
    pos = F.array_position(F.array(*[F.lit(v) for v in ordered]), as_column(key))
    return F.when(pos > 0, pos.cast("int"))


def row_mean(columns: Sequence[str | Column]) -> Column:
    """Mean across columns of one row, null when any of them is null."""
    cols = [as_column(c) for c in columns]
    return reduce(add, cols) / F.lit(float(len(cols)))


def linear_combination(weights: Mapping[str, float]) -> Column:
    return reduce(add, [F.lit(float(w)) * F.col(c) for c, w in weights.items()])


def product(a: str | Column, b: str | Column) -> Column:
    return as_column(a) * as_column(b)


def percent(part: str | Column, total: str | Column) -> Column:
    """``part / total * 100``, or 0 when the total is 0."""
    t = as_column(total)
    return F.when(t != 0, as_column(part) / t * 100.0).otherwise(F.lit(0.0))


def standardized(value: str | Column, mean: float | Column | None, sd: float | Column | None) -> Column:
    """``(x - mean) / sd``. Without spread a present value is 0; null and NaN give null."""
    x = present(value)
    if not isinstance(sd, Column):
        if sd is None or not sd > 0:
            return F.when(x.isNotNull(), F.lit(0.0))
        return (x - F.lit(mean)) / F.lit(sd)
    return F.when(x.isNotNull(), F.when(sd > 0, (x - mean) / sd).otherwise(F.lit(0.0)))


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    """Aggregate ``sum(x*w) / sum(w)``, counting only weights of rows that have a value.

    NaN is missing, as a value and as a weight.
    """
    x, w = present(value), present(weight)
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))
