"""Writing results: Parquet for rows, CSV for result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from surveyloom.functions.columns import map_labels


def _plain(df: DataFrame) -> DataFrame:
    """Without ML vectors, which only Spark can read back."""
    vectors = [f.name for f in df.schema.fields if f.dataType.typeName() == "vectorudt"]
    return df.drop(*vectors)


def write_rows(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Labelled or segmented rows as Parquet, in as many files as there are tasks."""
    writer = _plain(df).write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _flat(df: DataFrame) -> DataFrame:
    """CSV holds scalars only: nested columns are written as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    plain = _plain(df)
    return plain.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in plain.schema.fields]
    )


def write_table(df: DataFrame, path: str, order_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """A result table as CSV with a header. One file: these have one row per group or term."""
    table = _flat(df)
    table = table.orderBy(*order_by) if order_by else table
    table.coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> list[str]:
    """Each named result table as its own CSV folder; returns the paths."""
    paths = []
    for name, table in tables.items():
        path = f"{folder.rstrip('/')}/{name}"
        write_table(table, path)
        paths.append(path)
    return paths


def missing_value_table(
    missing: DataFrame, loss: DataFrame, names: Mapping[str, str] | None = None, decimals: int = 2
) -> DataFrame:
    """The missing report followed by the sample-loss summary, in one layout."""
    shown = map_labels("column", names) if names else F.col("variable")
    per_variable = missing.select(
        F.coalesce(shown, F.col("column")).alias("variable"),
        "column",
        F.col("total_count").cast("double").alias("total"),
        F.col("valid_count").cast("double").alias("valid"),
        F.col("missing_count").cast("double").alias("missing"),
        F.round("missing_rate", decimals).alias("missing_rate"),
    )
    summary = loss.select(
        F.concat(F.lit("Sample loss ("), F.col("measure"), F.lit(")")).alias("variable"),
        F.lit("all").alias("column"),
        F.col("before").alias("total"),
        F.col("after").alias("valid"),
        F.col("removed").alias("missing"),
        F.round("loss_rate", decimals).alias("missing_rate"),
    )
    return reduce(DataFrame.unionByName, [per_variable, summary])
