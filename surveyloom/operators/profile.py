"""Column profiles and missingness. Every function is one aggregate over the table."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from surveyloom.functions.columns import percent, present
from surveyloom.operators.checks import numeric_columns, require_columns
from surveyloom.operators.lookup import attach, one_row, settle


def _absent(df: DataFrame, column: str, nan: bool) -> Column:
    c = F.col(column)
    floating = isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType))
    return (c.isNull() | F.isnan(c)) if nan and floating else c.isNull()


def _tall(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn a one-row frame of same-typed structs into one row per struct."""
    return df.select(F.inline(F.array(*structs)))


def column_mean(df: DataFrame, column: str) -> DataFrame:
    """Mean of a column as one row; null on an empty table."""
    require_columns(df, [column])
    return df.agg(F.avg(column).alias("mean")).select(F.lit(column).alias("column"), "mean")


def column_statistics(df: DataFrame, columns: Sequence[str] | str) -> DataFrame:
    """count, mean, stddev, min, max, nulls, rows and null percentage, one row per column."""
    names = [columns] if isinstance(columns, str) else list(columns)
    require_columns(df, names)
    aggs = [F.count(F.lit(1)).alias("rows")]
    # NaN is missing
    x = [present(c) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(c) for c in names]
    for i, c in enumerate(names):
        aggs += [
            F.count(x[i]).alias(f"n{i}"),
            F.avg(x[i]).cast("double").alias(f"mean{i}"),
            F.stddev_samp(x[i]).alias(f"sd{i}"),
            F.min(x[i]).cast("double").alias(f"lo{i}"),
            F.max(x[i]).cast("double").alias(f"hi{i}"),
        ]
    nulls = lambda i: F.col("rows") - F.col(f"n{i}")
    return _tall(
        df.agg(*aggs),
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("count"),
                F.col(f"mean{i}").alias("mean"),
                F.col(f"sd{i}").alias("stddev"),
                F.col(f"lo{i}").alias("min"),
                F.col(f"hi{i}").alias("max"),
                nulls(i).alias("null_count"),
                F.col("rows").alias("total_rows"),
                percent(nulls(i), "rows").alias("null_percentage"),
            )
            for i, c in enumerate(names)
        ],
    )


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Profile the chosen columns, by default every numeric one, with the table's shape."""
    names = list(columns) if columns else numeric_columns(df)
    if not names:
        raise ValueError("No numeric columns to describe")
    return column_statistics(df, names).withColumn("total_columns", F.lit(len(df.columns)))


def missing_report(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    names: Mapping[str, str] | None = None,
    nan: bool = False,
    decimals: int | None = None,
) -> DataFrame:
    """Missing and valid counts and the missing rate of every column, in one pass.

    ``names`` adds a display name per column; ``nan=True`` counts NaN as missing too;
    ``decimals`` rounds the rate.
    """
    cols = list(columns) if columns else df.columns
    require_columns(df, cols)
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(_absent(df, c, nan)).alias(f"m{i}") for i, c in enumerate(cols)]
    rate = lambda i: percent(f"m{i}", "rows")
    shown = (lambda i: F.round(rate(i), decimals)) if decimals is not None else rate
    label = [F.lit(c) for c in cols] if names is None else [F.lit(names.get(c, c)) for c in cols]
    return _tall(
        df.agg(*aggs),
        [
            F.struct(
                label[i].alias("variable"),
                F.lit(c).alias("column"),
                F.col("rows").alias("total_count"),
                (F.col("rows") - F.col(f"m{i}")).alias("valid_count"),
                F.col(f"m{i}").alias("missing_count"),
                shown(i).alias("missing_rate"),
            )
            for i, c in enumerate(cols)
        ],
    )


def sample_loss(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """What list-wise deletion on ``columns`` would remove: rows, and weight if given."""
    require_columns(df, [*columns, *([weight] if weight else [])])
    lost = F.lit(False)
    for c in columns:
        lost = lost | _absent(df, c, nan=True)
    measures = [("unweighted", F.lit(1).cast("double"))]
    if weight:
        measures.append(("weighted", F.coalesce(F.col(weight).cast("double"), F.lit(0.0))))
    aggs = []
    for kind, amount in measures:
        aggs.append(F.coalesce(F.sum(amount), F.lit(0.0)).alias(f"{kind}_before"))
        aggs.append(F.coalesce(F.sum(F.when(~lost, amount)), F.lit(0.0)).alias(f"{kind}_after"))
    one = df.agg(*aggs)
    rows = []
    for kind, _ in measures:
        before, after = F.col(f"{kind}_before"), F.col(f"{kind}_after")
        rows.append(
            F.struct(
                F.lit(kind).alias("measure"),
                before.alias("before"),
                after.alias("after"),
                (before - after).alias("removed"),
                percent(before - after, before).alias("loss_rate"),
            )
        )
    return _tall(one, rows)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def correlation(df: DataFrame, a: str, b: str, method: str = "pearson") -> DataFrame:
    """Correlation of two columns over rows that have both, as one row."""
    require_columns(df, [a, b])
    if method == "pearson":
        value = F.corr(F.col(a).cast("double"), F.col(b).cast("double"))
        return df.agg(value.alias("correlation")).select(
            F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(method).alias("method"), "correlation"
        )
    if method == "spearman":
        return _spearman(df, a, b)
    raise ValueError("method must be 'pearson' or 'spearman'")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs, both directions, as ``(x, y, correlation)`` rows from one aggregate."""
    require_columns(df, columns)
    pairs = list(combinations_with_replacement(columns, 2))
    one = df.agg(
        *[F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias(f"r{i}") for i, (x, y) in enumerate(pairs)]
    )
    rows = []
    for i, (x, y) in enumerate(pairs):
        for p, q in {(x, y), (y, x)}:
            rows.append(F.struct(F.lit(p).alias("x"), F.lit(q).alias("y"), F.col(f"r{i}").alias("correlation")))
    return _tall(one, rows)


def average_ranks(df: DataFrame, column: str, bucket_values: int = 1_000_000) -> DataFrame:
    """``(value, ties, avg_rank)`` for each distinct value, ties sharing their mean rank.

    Equal values collapse to one row first, so a value held by a third of the table costs
    one row. The distinct values are then cut into ordered buckets of about
    ``bucket_values`` each; the running count restarts in every bucket and is shifted by
    the totals of the buckets before it, so no single task orders the whole column.
    """
    counts = settle(
        df.select(F.col(column).cast("double").alias("value"))
        .na.drop()
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("ties"))
    )
    buckets = max(1, math.ceil(counts.count() / bucket_values))
    rank = (F.col("upto") - (F.col("ties") - 1) / 2.0).alias("avg_rank")
    order = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    if buckets == 1:
        # at most ``bucket_values`` rows
        return counts.withColumn("upto", F.sum("ties").over(order)).select("value", "ties", rank)
    probs = [i / buckets for i in range(1, buckets)]
    inner = sorted(set(counts.approxQuantile("value", probs, 0.25 / buckets)))
    splits = [-math.inf, *inner, math.inf]
    placed = Bucketizer(splits=splits, inputCol="value", outputCol="bucket").transform(counts)
    # one row per bucket, never more than the number of splits above
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("bucket")
        .agg(F.sum("ties").alias("in_bucket"))
        .select("bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    )
    running = Window.partitionBy("bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(F.broadcast(offsets), "bucket")
        .withColumn("upto", F.col("offset") + F.sum("ties").over(running))
        .select("value", "ties", rank)
    )


def _spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of average ranks, on distinct value pairs with their counts."""
    pairs = df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).na.drop()
    weighted = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    for v in ("x", "y"):
        ranks = average_ranks(pairs, v).select(F.col("value").alias(v), F.col("avg_rank").alias(f"rank_{v}"))
        weighted = attach(weighted, ranks, v, how="inner")
    total = one_row(pairs.agg(F.count(F.lit(1)).alias("n")))["n"]
    dx, dy = (F.col(f"rank_{v}") - F.lit((total + 1) / 2.0) for v in ("x", "y"))
    c = F.col("c")
    moments = weighted.agg(
        F.sum(c * dx * dy).alias("xy"), F.sum(c * dx * dx).alias("xx"), F.sum(c * dy * dy).alias("yy")
    )
    value = F.try_divide(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy")))
    return moments.select(
        F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit("spearman").alias("method"), value.alias("correlation")
    )
