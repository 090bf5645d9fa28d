"""Z-scores, dimension scores, composite 0-100 indices and scaled matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.functions.columns import linear_combination, present as present_value, row_mean, standardized
from surveyloom.operators.checks import complete_rows, require_columns
from surveyloom.operators.lookup import attach_aggregate, one_row

MISSING = ("impute_mean", "impute_zero", "drop", "keep")


@dataclass(frozen=True)
class Moments:
    mean: float | None
    sd: float | None


@dataclass(frozen=True)
class Dimension:
    """A named group of indicators. ``reverse`` flips the sign of all of them, and
    ``flip`` that of single columns on top of it."""

    name: str
    columns: tuple[str, ...]
    weight: float = 0.25
    reverse: bool = False
    flip: frozenset[str] = field(default_factory=frozenset)


@dataclass(frozen=True)
class IndexSpec:
    dimensions: tuple[Dimension, ...]
    missing: str = "impute_mean"
    standardize: bool = True
    output: str = "index"

    def __post_init__(self):
        if self.missing not in MISSING:
            raise ValueError(f"missing must be one of {', '.join(MISSING)}")

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for d in self.dimensions for c in d.columns))

    @property
    def names(self) -> list[str]:
        return [d.name for d in self.dimensions]


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, Moments]:
    """Mean and sample standard deviation of many columns from one aggregate; NaN is missing."""
    cols = list(dict.fromkeys(columns))
    require_columns(df, cols)
    values = [present_value(c) for c in cols]
    aggs = [a for i, c in enumerate(values) for a in (F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"))]
    r = one_row(df.agg(*aggs))
    return {c: Moments(r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(cols)}


def zscore(
    df: DataFrame, columns: Sequence[str] | str, suffix: str = "_z", by: Sequence[str] | str | None = None
) -> DataFrame:
    """Standardize columns over the table, or within groups when ``by`` is given."""
    cols = [columns] if isinstance(columns, str) else list(columns)
    require_columns(df, cols)
    if not by:
        m = moments(df, cols)
        return df.withColumns({f"{c}{suffix}": standardized(c, m[c].mean, m[c].sd) for c in cols})
    keys = [by] if isinstance(by, str) else list(by)
    values = [present_value(c) for c in cols]
    aggs = [a for i, c in enumerate(values) for a in (F.avg(c).alias(f"__m{i}"), F.stddev_samp(c).alias(f"__s{i}"))]
    joined = attach_aggregate(df, df.groupBy(*keys).agg(*aggs), keys)
    new = [
        standardized(c, F.col(f"__m{i}"), F.col(f"__s{i}")).alias(f"{c}{suffix}") for i, c in enumerate(cols)
    ]
    return joined.select(*df.columns, *new)


def _indicator(column: str, m: Moments, standardize: bool, missing: str) -> Column:
    """One indicator, standardized and filled. The mean of a z-score is 0."""
    x = standardized(column, m.mean, m.sd) if standardize else present_value(F.col(column).cast("double"))
    if missing == "impute_zero" or (missing == "impute_mean" and standardize):
        return F.coalesce(x, F.lit(0.0))
    if missing == "impute_mean" and m.mean is not None:
        return F.coalesce(x, F.lit(m.mean))
    return x


def _dimension(d: Dimension, present: Sequence[str], stats: Mapping[str, Moments], standardize: bool, missing: str) -> Column:
    parts = []
    for c in present:
        x = _indicator(c, stats[c], standardize, missing)
        parts.append(-x if d.reverse != (c in d.flip) else x)
    return row_mean(parts)


def dimension_score(
    df: DataFrame, dimension: Dimension, standardize: bool = True, missing: str = "impute_mean"
) -> DataFrame:
    """Average of a dimension's indicators; columns the table lacks are left out."""
    if missing not in MISSING:
        raise ValueError(f"missing must be one of {', '.join(MISSING)}")
    present = [c for c in dimension.columns if c in df.columns]
    if not present:
        raise ValueError(f"No columns of dimension '{dimension.name}' are present")
    data = complete_rows(df, present) if missing == "drop" else df
    return data.withColumn(dimension.name, _dimension(dimension, present, moments(data, present), standardize, missing))


def composite_index(df: DataFrame, spec: IndexSpec) -> DataFrame:
    """Dimension scores and their weighted sum, stretched to 0-100; 50 if it is constant.

    Two small aggregates (all moments, then the range) and one projection, whatever the
    number of indicators. Source columns are never overwritten.
    """
    require_columns(df, spec.columns)
    data = complete_rows(df, spec.columns) if spec.missing == "drop" else df
    stats = moments(data, spec.columns)
    scored = data.withColumns(
        {d.name: _dimension(d, d.columns, stats, spec.standardize, spec.missing) for d in spec.dimensions}
    )
    raw = linear_combination({d.name: d.weight for d in spec.dimensions})
    span = one_row(scored.agg(F.min(raw).alias("lo"), F.max(raw).alias("hi")))
    return scored.withColumn(spec.output, _stretch(raw, span["lo"], span["hi"]))


def _stretch(raw: Column, lo: float | None, hi: float | None) -> Column:
    if lo is None or lo == hi:
        return F.when(raw.isNotNull(), F.lit(50.0))
    return (raw - F.lit(lo)) / F.lit(hi - lo) * 100.0


def composite_score(
    df: DataFrame,
    columns: Sequence[str],
    output: str = "composite",
    negate: Sequence[str] = (),
    standardize: bool = True,
    by: Sequence[str] | str | None = None,
) -> DataFrame:
    """Mean of standardized items, some of them negated; null when any item is null.

    Columns the table lacks are left out. ``by`` standardizes within groups.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        raise ValueError("None of the composite's columns are present")
    suffix = "__item"
    if standardize:
        scored = zscore(df, present, suffix=suffix, by=by)
    else:
        scored = df.withColumns({f"{c}{suffix}": present_value(F.col(c).cast("double")) for c in present})
    items = [-F.col(f"{c}{suffix}") if c in negate else F.col(f"{c}{suffix}") for c in present]
    return scored.select(*df.columns, row_mean(items).alias(output))


def minmax_cells(df: DataFrame, value: str, output: str = "scaled") -> DataFrame:
    """Stretch a result table's values to 0-1; all 0 when they are equal.

    Meant for tables of cells, such as a cross-tab, whose range is one cheap aggregate.
    """
    x = present_value(value)
    span = one_row(df.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi")))
    lo, hi = span["lo"], span["hi"]
    if lo is None or lo == hi:
        return df.withColumn(output, F.when(x.isNotNull(), F.lit(0.0)))
    return df.withColumn(output, (x - F.lit(lo)) / F.lit(hi - lo))
