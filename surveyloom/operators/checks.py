"""Column presence, column types and row filters that guard an analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T


def missing_columns(df: DataFrame, columns: Sequence[str]) -> tuple[bool, list[str]]:
    """``(all present, absent names in the order asked for)``."""
    have = set(df.columns)
    absent = [c for c in columns if c not in have]
    return not absent, absent


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    ok, absent = missing_columns(df, columns)
    if not ok:
        raise ValueError(f"Missing columns: {', '.join(absent)}")


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of byte to decimal columns, decided by type and not by type name."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """List-wise deletion: keep rows where none of the columns is null or NaN.

    Written as separate null tests, which reach the Parquet scan.
    """
    require_columns(df, columns)
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    tests = [F.col(c).isNotNull() & ~F.isnan(c) if c in floating else F.col(c).isNotNull() for c in dict.fromkeys(columns)]
    # joined in pairs: a chain of hundreds of tests is too deep for the optimizer
    while len(tests) > 1:
        tests = [a & b for a, b in zip(tests[::2], tests[1::2])] + tests[len(tests) - len(tests) % 2 :]
    return df.where(tests[0]) if tests else df


def non_empty(df: DataFrame) -> bool:
    return bool(df.columns) and not df.isEmpty()


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """A many-to-one join keeps its row count only if the lookup side is unique."""
    again = duplicate_keys(df, keys).first()
    if again is not None:
        raise ValueError(f"Lookup key {tuple(again[k] for k in keys)} occurs {again['rows']} times")


def preview(df: DataFrame, n: int = 5, columns: Sequence[str] | None = None) -> DataFrame:
    """The first rows, for a look; a limit is the point of this one."""
    return df.select(*(columns or df.columns)).limit(n)
