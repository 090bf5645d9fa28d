"""Weighted statistics per band, segment, cluster or cell.

All of these are algebraic aggregates: Spark combines them on the map side, so a group
with a third of the rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from surveyloom.functions.columns import is_missing, percent, present, weighted_mean
from surveyloom.operators.checks import require_columns
from surveyloom.operators.lookup import attach, attach_aggregate, one_row
from surveyloom.operators.quantiles import quantile_values, quantiles


def _keys(by: Sequence[str] | str) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def share_of_total(table: DataFrame, value: str) -> Column:
    """Percent of the total of ``table``, an already aggregated one of one row per group.

    The total is a scalar subquery: a sum in parts and one row, so groups never meet in a task.
    """
    return percent(value, table.agg(F.sum(value)).scalar())


def band_statistics(df: DataFrame, score: str, weight: str, by: Sequence[str] | str) -> DataFrame:
    """Rows, valid scores, weight, mean, weighted mean, range and population share per group."""
    keys = _keys(by)
    require_columns(df, [score, weight, *keys])
    x, w = present(score), present(weight)
    table = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(x).alias("sample_count"),
        F.sum(w).alias("weighted_count"),
        F.avg(x).alias("mean_score"),
        weighted_mean(score, weight).alias("weighted_mean_score"),
        F.min(x).alias("min_score"),
        F.max(x).alias("max_score"),
    )
    return table.withColumn("population_percentage", share_of_total(table, "weighted_count"))


def segment_statistics(df: DataFrame, weight: str, by: Sequence[str] | str) -> DataFrame:
    """Rows, weight and population share per segment."""
    keys = _keys(by)
    require_columns(df, [weight, *keys])
    table = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"), F.sum(present(weight)).alias("weighted_count")
    )
    return table.withColumn("population_percentage", share_of_total(table, "weighted_count"))


def group_sizes(df: DataFrame, by: Sequence[str] | str) -> DataFrame:
    keys = _keys(by)
    require_columns(df, keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def index_by_group(
    df: DataFrame,
    index: str,
    weight: str,
    by: str,
    dimensions: Sequence[str] = (),
    method: str = "approx",
    accuracy: int = 10_000,
) -> DataFrame:
    """Distribution of an index per group, with quartiles and dimension means.

    With ``method="approx"`` the quartiles come out of the same aggregate as the rest.
    """
    require_columns(df, [index, weight, by, *dimensions])
    aggs = [
        F.count(F.lit(1)).alias("sample_count"),
        F.sum(present(weight)).alias("weighted_count"),
        F.avg(present(index)).alias("mean_index"),
        weighted_mean(index, weight).alias("weighted_mean_index"),
        F.stddev_samp(present(index)).alias("std_index"),
        *[F.avg(present(d)).alias(f"mean_{d}") for d in dimensions],
    ]
    probs, names = (0.25, 0.5, 0.75), ("q25", "median", "q75")
    head = ["sample_count", "weighted_count", "mean_index", "weighted_mean_index", "std_index"]
    tail = [f"mean_{d}" for d in dimensions]
    if method == "approx":
        table = df.groupBy(by).agg(*aggs, F.percentile_approx(present(index), list(probs), accuracy).alias("__q"))
        return table.select(by, *head, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)], *tail)
    cuts = quantiles(df, index, probs, by=by, method=method, names=names)
    return attach(df.groupBy(by).agg(*aggs), cuts, by, null_safe=True).select(by, *head, *names, *tail)


def dimension_means(df: DataFrame, dimensions: Sequence[str], by: str) -> DataFrame:
    """Mean of every dimension per group as ``(group, dimension, mean)`` rows."""
    require_columns(df, [by, *dimensions])
    wide = df.groupBy(by).agg(*[F.avg(present(d)).alias(d) for d in dimensions])
    return wide.unpivot([by], list(dimensions), "dimension", "mean_value")


def share_above(
    df: DataFrame, index: str, by: str, prob: float = 0.75, method: str = "approx", weight: str | None = None
) -> DataFrame:
    """Share of each group above a percentile of the whole table."""
    require_columns(df, [index, by])
    cut = quantile_values(df, index, [prob], method=method)[0]
    above = F.when(present(index) > F.lit(cut), 1.0).when(present(index).isNotNull(), 0.0)
    value = weighted_mean(above, weight) if weight else F.avg(above)
    return df.groupBy(by).agg(F.lit(cut).cast("double").alias("threshold"), value.alias("share_above"))


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int, weight: str | None = None) -> DataFrame:
    """Fixed-width bins over ``[lo, hi]``; the upper edge belongs to the last bin.

    Values outside fall into bin 0 and bin ``bins + 1``; empty bins have no row.
    """
    require_columns(df, [column])
    x = F.col(column).cast("double")
    place = F.width_bucket(x, F.lit(float(lo)), F.lit(float(hi)), F.lit(bins))
    number = F.when(x == hi, F.lit(bins).cast("bigint")).otherwise(place)
    width = (hi - lo) / bins
    aggs = [F.count(F.lit(1)).alias("n")]
    if weight:
        aggs.append(F.sum(present(weight)).alias("weighted_count"))
    edge = lambda i: F.lit(lo) + F.lit(width) * i
    counted = df.where(~is_missing(x)).groupBy(number.cast("int").alias("bin")).agg(*aggs)
    return counted.select(
        "bin", edge(F.col("bin") - 1).alias("lower"), edge(F.col("bin")).alias("upper"), *counted.columns[1:]
    )


def cluster_profile(df: DataFrame, by: Sequence[str] | str, dimensions: Sequence[str], weight: str) -> DataFrame:
    """Rows, weight and dimension means per cluster."""
    keys = _keys(by)
    require_columns(df, [weight, *keys, *dimensions])
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.sum(present(weight)).alias("weighted_count"),
        *[F.avg(present(d)).alias(f"mean_{d}") for d in dimensions],
    )


def outcomes(df: DataFrame, by: Sequence[str] | str, score: str, weight: str) -> DataFrame:
    """Mean, weighted mean, sd and range of a score per cluster."""
    keys = _keys(by)
    require_columns(df, [score, weight, *keys])
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(present(score)).alias("mean_score"),
        weighted_mean(score, weight).alias("weighted_mean_score"),
        F.stddev_samp(present(score)).alias("std_score"),
        F.min(present(score)).alias("min_score"),
        F.max(present(score)).alias("max_score"),
    )


def cell_means(df: DataFrame, a: str, b: str, score: str, weight: str) -> DataFrame:
    """Rows, weight and score means per cell of two groupings."""
    require_columns(df, [a, b, score, weight])
    return df.groupBy(a, b).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(present(weight)).alias("weighted_n"),
        weighted_mean(score, weight).alias("weighted_mean_score"),
        F.avg(present(score)).alias("mean_score"),
        F.stddev_samp(present(score)).alias("std_score"),
    )


def top_groups(df: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` groups with the most rows; ties go to the smaller key."""
    require_columns(df, [by])
    return group_sizes(df.where(F.col(by).isNotNull()), by).orderBy(F.desc("n"), F.asc(by)).limit(n)


def repeatable_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded hash of their keys: the same rows on any layout.

    A first pass counts rows per power of two of the hash. Only rows below the smallest power
    that holds ``n`` of them are sorted, about ``2n``, instead of ``n`` from every task.
    """
    require_columns(df, keys)
    place = F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]).bitwiseAND(F.lit(2**63 - 1))
    level = F.floor(F.log2(place.cast("double") + 1.0)).cast("int")
    counts = df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()  # 64 at most
    seen, top = 0, 63
    for row in sorted(counts, key=lambda r: r["level"]):
        seen += row["rows"]
        if seen >= n:
            top = row["level"]
            break
    return df.where(level <= top).orderBy(place, *keys).limit(n)


def demean(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] | str,
    suffix: str = "_within",
    weight: str | None = None,
) -> DataFrame:
    """``x - mean(x)`` within each group, for many columns.

    The means are one aggregate, attached to the rows by a broadcast of checked size or a
    salted join, so rows of a hot group are never gathered in one task. ``weight`` uses
    weighted means; null group keys form a group of their own, and NaN counts as null.
    """
    keys = _keys(by)
    require_columns(df, [*columns, *keys, *([weight] if weight else [])])
    mean = (lambda c: weighted_mean(c, weight)) if weight else (lambda c: F.avg(present(c)))
    means = df.groupBy(*keys).agg(*[mean(c).alias(f"__mean_{i}") for i, c in enumerate(columns)])
    joined = attach_aggregate(df, means, keys)
    new = [(present(c) - F.col(f"__mean_{i}")).alias(f"{c}{suffix}") for i, c in enumerate(columns)]
    return joined.select(*df.columns, *new)


def range_of(df: DataFrame, column: str) -> tuple[float | None, float | None]:
    r = one_row(df.agg(F.min(present(column)).cast("double").alias("lo"), F.max(present(column)).cast("double").alias("hi")))
    return r["lo"], r["hi"]
