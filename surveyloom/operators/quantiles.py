"""Percentiles: Spark's sketch, and an exact selection that stays distributed.

``percentile`` keeps every distinct value of a group in one buffer, which a hot group
cannot afford. The exact method here narrows instead: each pass counts the rows of every
group in equal-width slices of the bracket that still holds a wanted rank and moves to
that slice. Brackets are a table of their own, so any number of groups goes. A pass shuffles
only slice counts; once a bracket is small its distinct values are counted and the ranks
read off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from surveyloom.operators.checks import require_columns
from surveyloom.operators.lookup import attach_aggregate, settle

SLICES = 2048
SMALL_BRACKET = 10_000


def percentile_names(probs: Sequence[float]) -> list[str]:
    """q25, q50, q67, ... ; 1/3 becomes q33 and 2/3 q67."""
    return [f"q{round(p * 100):02d}" for p in probs]


def approx_percentiles(value: str | Column, probs: Sequence[float], accuracy: int = 10_000) -> Column:
    """All probabilities from one sketch, as an array aggregate."""
    return F.percentile_approx(value, list(probs), accuracy)


def quantiles(
    df: DataFrame,
    column: str,
    probs: Sequence[float],
    by: Sequence[str] | str | None = None,
    method: str = "approx",
    accuracy: int = 10_000,
    kind: str = "continuous",
    names: Sequence[str] | None = None,
) -> DataFrame:
    """One row per group with a column per probability.

    ``method="approx"`` is one lazy aggregate. ``method="exact"`` runs a few passes; ``kind``
    then chooses between interpolation (``continuous``) and an existing value (``discrete``).
    Both take any number of groups.
    """
    keys = [by] if isinstance(by, str) else list(by or [])
    require_columns(df, [column, *keys])
    labels = list(names or percentile_names(probs))
    if len(set(labels)) != len(probs):
        raise ValueError(f"Percentile names are not unique: {labels}")
    if method == "approx":
        sketch = approx_percentiles(F.col(column).cast("double"), probs, accuracy).alias("__q")
        grouped = df.where(~F.isnan(F.col(column).cast("double"))).groupBy(*keys).agg(sketch)
        return grouped.select(*keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(labels)])
    if method != "exact":
        raise ValueError("method must be 'approx' or 'exact'")
    if kind not in ("continuous", "discrete"):
        raise ValueError("kind must be 'continuous' or 'discrete'")
    return _exact(df, column, probs, keys, kind, labels)


def quantile_values(df: DataFrame, column: str, probs: Sequence[float], **options) -> list[float | None]:
    """Cut points of the whole table, for use as literals."""
    row = quantiles(df, column, probs, **options).first()
    return [None] * len(probs) if row is None else list(row)


def _exact(df, column, probs, keys, kind, labels) -> DataFrame:
    data = df.select(
        F.struct(*[F.col(k) for k in keys], F.lit(0).alias("__all")).alias("__g"), F.col(column).cast("double").alias("__v")
    ).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    summary = settle(
        data.groupBy("__g").agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    )
    # the ranks that each probability needs, from 0, and how far between the two its value lies
    wanted = summary.select("__g", "n", "lo", "hi", F.posexplode(F.lit([float(p) for p in probs])).alias("i", "p"))
    if kind == "discrete":
        low = F.greatest(F.lit(0), F.ceil(F.col("n") * F.col("p")) - 1).cast("bigint")
        wanted = wanted.select("*", low.alias("low"), low.alias("high"), F.lit(0.0).alias("part"))
    else:
        at = (F.col("n") - 1) * F.col("p")
        low = F.floor(at).cast("bigint")
        wanted = wanted.select(
            "*", low.alias("low"), F.least(low + 1, F.col("n") - 1).alias("high"), (at - low).alias("part")
        )
    wanted = settle(wanted)
    ranks = wanted.select("__g", F.col("low").alias("rank"), "lo", "hi", "n").union(
        wanted.select("__g", "high", "lo", "hi", "n")
    )
    # a bracket: values from lo to hi, with the rows below it and inside
    brackets = settle(ranks.distinct().withColumn("below", F.lit(0).cast("bigint")))
    open_ = (F.col("hi") / 2 - F.col("lo") / 2 > 0) & (F.col("n") > SMALL_BRACKET)
    while not brackets.where(open_).isEmpty():
        narrowed = _narrow(data, brackets.where(open_))
        brackets = settle(brackets.where(~open_).unionByName(narrowed))
    found = brackets.where("lo = hi").select("__g", "rank", F.col("lo").alias("value"))
    found = settle(found.unionByName(_read_off(data, brackets.where("lo < hi"))))
    a = found.select(F.col("__g").alias("__ga"), F.col("rank").alias("low"), F.col("value").alias("a"))
    b = found.select(F.col("__g").alias("__gb"), F.col("rank").alias("high"), F.col("value").alias("b"))
    both = wanted.join(a, F.col("__g").eqNullSafe(F.col("__ga")) & (wanted["low"] == a["low"]))
    both = both.join(b, F.col("__g").eqNullSafe(F.col("__gb")) & (wanted["high"] == b["high"]))
    value = F.when((F.col("part") == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise(
        F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    )
    table = both.groupBy("__g").agg(*[F.max(F.when(F.col("i") == i, value)).alias(n) for i, n in enumerate(labels)])
    if not keys:
        # one row even without values
        return table.agg(*[F.max(n).alias(n) for n in labels])
    return table.select(*[F.col("__g")[k].alias(k) for k in keys], *labels)


def _inside(data: DataFrame, brackets: DataFrame) -> DataFrame:
    """Rows that lie in a bracket of their group, with its bounds.

    A group has at most two brackets per probability; they come to the rows as one list.
    """
    spans = brackets.groupBy("__g").agg(F.collect_set(F.struct("lo", "hi")).alias("__spans"))
    held = attach_aggregate(data, spans, "__g", how="inner")
    each = held.select("__g", "__v", F.explode("__spans").alias("s"))
    return each.where(F.col("__v").between(F.col("s.lo"), F.col("s.hi"))).select("__g", "__v", "s.lo", "s.hi")


def _narrow(data: DataFrame, brackets: DataFrame) -> DataFrame:
    """Each bracket becomes the slice of it that holds its rank."""
    # halves keep the difference finite for the widest doubles
    place = (F.col("__v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    piece = F.least(F.floor(place * SLICES), F.lit(SLICES - 1))
    slices = (
        _inside(data, brackets)
        .groupBy("__g", "lo", "hi", piece.alias("piece"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("first"), F.max("__v").alias("last"))
    )
    order = Window.partitionBy("__g", "lo", "hi").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    slices = slices.withColumn("upto", F.sum("n").over(order)).select(
        F.col("__g").alias("__sg"), F.col("lo").alias("slo"), F.col("hi").alias("shi"), "first", "last",
        F.col("n").alias("sn"), "upto",
    )
    same = F.col("__g").eqNullSafe(F.col("__sg")) & (F.col("lo") == F.col("slo")) & (F.col("hi") == F.col("shi"))
    inside = (F.col("rank") - F.col("below") < F.col("upto")) & (F.col("rank") - F.col("below") >= F.col("upto") - F.col("sn"))
    return brackets.join(slices, same & inside).select(
        "__g", "rank", F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("sn").alias("n"),
        (F.col("below") + F.col("upto") - F.col("sn")).alias("below"),
    )


def _read_off(data: DataFrame, brackets: DataFrame) -> DataFrame:
    """The value at each rank of brackets that hold few rows, from counts of distinct values."""
    order = Window.partitionBy("__g", "lo", "hi").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    counted = (
        _inside(data, brackets)
        .groupBy("__g", "lo", "hi", "__v")
        .agg(F.count(F.lit(1)).alias("m"))
        .withColumn("upto", F.sum("m").over(order))
    ).select(F.col("__g").alias("__sg"), F.col("lo").alias("slo"), F.col("hi").alias("shi"), "__v", "m", "upto")
    same = F.col("__g").eqNullSafe(F.col("__sg")) & (F.col("lo") == F.col("slo")) & (F.col("hi") == F.col("shi"))
    here = F.col("rank") - F.col("below")
    return brackets.join(counted, same & (here < F.col("upto")) & (here >= F.col("upto") - F.col("m"))).select(
        "__g", "rank", F.col("__v").alias("value")
    )
