"""Preparing columns: bands, reversed items, labels, imputation, dummies, strata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window, functions as F

from surveyloom.functions.columns import (
    SCORE_BANDS,
    SCORE_CUTS,
    LEVEL_CUTS,
    LEVEL_NAMES,
    band,
    map_labels,
    present,
    product,
    recode_missing,
    reflect,
)
from surveyloom.operators.checks import complete_rows, require_columns
from surveyloom.operators.lookup import attach, one_row, settle

def add_score_band(
    df: DataFrame,
    score: str,
    output: str = "band",
    cuts: Sequence[float] = SCORE_CUTS,
    labels: Sequence[str] = SCORE_BANDS,
    invalid: str = "null",
) -> DataFrame:
    require_columns(df, [score])
    return df.withColumn(output, band(score, cuts, labels, invalid))


def add_index_level(
    df: DataFrame,
    index: str,
    output: str = "level",
    cuts: Sequence[float] = LEVEL_CUTS,
    labels: Sequence[str] = LEVEL_NAMES,
    invalid: str = "null",
) -> DataFrame:
    return add_score_band(df, index, output, cuts, labels, invalid)


def recode_sentinels(df: DataFrame, codes: Mapping[str, Sequence]) -> DataFrame:
    """Null out the listed codes, column by column."""
    require_columns(df, list(codes))
    return df.withColumns({c: recode_missing(c, v) for c, v in codes.items()})


def recode_from_codebook(df: DataFrame, codebook: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null out the codes that a ``(column, code, is_missing)`` codebook marks as missing.

    The codebook rows of the named columns come to the driver: one per code of a
    questionnaire item, independent of the number of observations.
    """
    require_columns(codebook, ["column", "code", "is_missing"])
    marked = codebook.where(F.col("is_missing") & F.col("column").isin(list(columns))).select("column", "code")
    codes: dict[str, list] = {}
    for r in marked.distinct().collect():
        codes.setdefault(r["column"], []).append(r["code"])
    return recode_sentinels(df, codes) if codes else df


def decode_labels(df: DataFrame, codebook: DataFrame, column: str, output: str) -> DataFrame:
    """Value labels by lookup in a ``(column, code, label)`` codebook."""
    require_columns(df, [column])
    labels = codebook.where(F.col("column") == column).select(
        F.col("code").cast(df.schema[column].dataType).alias(column), F.col("label").alias(output)
    )
    return attach(df, labels, column, how="left")


def reverse_item(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """``max + 1 - x`` with the maximum seen in the column; NaN is missing."""
    require_columns(df, [column])
    top = one_row(df.agg(F.max(present(column)).cast("double").alias("top")))["top"]
    if top is None:
        raise ValueError(f"Column '{column}' has no values to reverse")
    return df.withColumn(output or f"{column}_reversed", reflect(column, top))


def label_ids(df: DataFrame, column: str, labels: Mapping, output: str, default: str | None = None) -> DataFrame:
    require_columns(df, [column])
    return df.withColumn(output, map_labels(column, labels, default))


def impute(df: DataFrame, columns: Sequence[str], strategy: str = "mean", suffix: str = "") -> DataFrame:
    """``mean``: one aggregate for all columns; ``zero``; ``drop`` removes incomplete rows; ``keep``.

    NaN is missing and filled like null.
    """
    require_columns(df, columns)
    if strategy == "keep":
        return df
    if strategy == "drop":
        return complete_rows(df, columns)
    if strategy == "zero":
        fill = {c: 0.0 for c in columns}
    elif strategy == "mean":
        fill = one_row(df.agg(*[F.avg(present(c)).alias(c) for c in columns])).asDict()
    else:
        raise ValueError("strategy must be 'mean', 'zero', 'drop' or 'keep'")
    return df.withColumns(
        {f"{c}{suffix}": F.coalesce(present(c), F.lit(v).cast("double")) for c, v in fill.items()}
    )


def add_interaction(df: DataFrame, a: str, b: str, output: str | None = None) -> DataFrame:
    require_columns(df, [a, b])
    return df.withColumn(output or f"{a}_x_{b}", product(a, b))


def category_levels(df: DataFrame, column: str, limit: int | None = None) -> list:
    """Sorted distinct non-null values of a column, to become columns of a wide table.

    There are as many of them as the caller wants columns; ``limit`` raises beyond a number.
    """
    levels = df.select(column).where(F.col(column).isNotNull()).distinct()
    rows = (levels if limit is None else levels.limit(limit + 1)).collect()
    if limit is not None and len(rows) > limit:
        raise ValueError(f"'{column}' has more than {limit} levels: demean within groups instead")
    return sorted(r[0] for r in rows)


def add_dummies(df: DataFrame, column: str, prefix: str | None = None, levels: Sequence | None = None) -> DataFrame:
    """0/1 columns for every level but the smallest; a null group gets nulls.

    For thousands of levels use ``add_dummy_vector``, or absorb the group in the model.
    """
    require_columns(df, [column])
    known = list(levels) if levels is not None else category_levels(df, column)
    base = prefix or column
    return df.withColumns({f"{base}_{v}": (F.col(column) == F.lit(v)).cast("double") for v in known[1:]})


def level_positions(df: DataFrame, column: str) -> DataFrame:
    """Each distinct non-null value with its place in sorted order, as a table of any length.

    Values are cut into sorted ranges; places inside a range are added to the sizes of those before it.
    """
    levels = df.select(F.col(column).alias("level")).where("level IS NOT NULL").distinct()
    cut = settle(levels.repartitionByRange("level").withColumn("part", F.spark_partition_id()))
    # one row per range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    bases = bases.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("level")) - 1
    ranked = attach(cut.withColumn("inside", inside), settle(bases), "part", how="inner")
    return ranked.select("level", (F.col("base") + F.col("inside")).alias("place"))


def add_dummy_vector(df: DataFrame, column: str, output: str) -> DataFrame:
    """The same as one sparse vector for any number of levels; a null group gets a null.

    Levels stay a table that is joined to the rows; none of them reaches the driver.
    """
    require_columns(df, [column])
    if output in df.columns:
        raise ValueError(f"Column {output} exists")
    places = settle(level_positions(df, column))
    n = places.count()
    if n == 0:
        return df.withColumn(output, F.lit(None).cast(VectorUDT()))
    # the smallest level is the base: the encoder leaves out the last place
    places = places.select(F.col("level").alias(column), F.when(F.col("place") == 0, n - 1).otherwise(F.col("place") - 1).cast("double").alias("__at"))
    rows = attach(df, places, column).withColumn("__seen", F.coalesce("__at", F.lit(n - 1.0)))
    encoder = OneHotEncoder(inputCol="__seen", outputCol="__dummies", dropLast=True)
    model = encoder.fit(df.sparkSession.createDataFrame([(n - 1.0,)], "__seen double"))
    return model.transform(rows).select(*df.columns, F.when(F.col("__at").isNotNull(), F.col("__dummies")).alias(output))


def add_strata(
    df: DataFrame, column: str, cuts: Sequence[float | None], labels: Sequence[str], output: str = "stratum"
) -> DataFrame:
    """Half-open strata of a column as one labelled column, instead of one filter per stratum."""
    if any(c is None for c in cuts):
        raise ValueError(f"'{column}' has no values to cut")
    return df.withColumn(output, band(column, cuts, labels))
