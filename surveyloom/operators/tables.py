"""Tables behind charts: fixed display order, display names, matrices, fitted lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from surveyloom.functions.columns import map_labels, position_of
from surveyloom.operators.checks import require_columns
from surveyloom.operators.grouped import share_of_total

# Display order and names of score bands.
BAND_ORDER = ("low", "middle", "high")
BAND_NAMES = {"low": "Low (< 482)", "middle": "Middle (482-606)", "high": "High (≥ 607)"}


def ordered_table(
    table: DataFrame, key: str, order: Sequence, names: Mapping | None = None
) -> DataFrame:
    """Add each key's position and display name, and sort by position.

    Keys that are not listed, null too, come last with the next position and their own name.
    """
    require_columns(table, [key])
    own = F.col(key).cast("string")
    shown = F.coalesce(map_labels(key, names), own) if names else own
    return (
        table.withColumn("position", F.coalesce(position_of(key, order), F.lit(len(order) + 1)))
        .withColumn("display_name", shown)
        .orderBy("position", key)
    )


def band_table(statistics: DataFrame, band: str = "band") -> DataFrame:
    return ordered_table(statistics, band, BAND_ORDER, BAND_NAMES)


def segment_table(statistics: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
    return ordered_table(statistics, label, order)


def share_comparison(statistics: DataFrame, key: str) -> DataFrame:
    """Sample percent next to population percent per segment."""
    require_columns(statistics, [key, "sample_count", "weighted_count"])
    return statistics.select(
        key,
        share_of_total(statistics, "sample_count").alias("sample_percentage"),
        share_of_total(statistics, "weighted_count").alias("population_percentage"),
    )


def cell_matrix(cells: DataFrame, a: str, b: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Pivot cell values, one column per label of ``b``, missing cells 0."""
    require_columns(cells, [a, b, value])
    return cells.groupBy(a).pivot(b, list(columns)).agg(F.first(value)).na.fill(0.0, list(columns))


def fitted_lines(
    lines: DataFrame, group: str, lo: float = -2.0, hi: float = 2.0, points: int = 100
) -> DataFrame:
    """Points of each ``(group, intercept, slope)`` line on an even grid."""
    require_columns(lines, [group, "intercept", "slope"])
    x = F.lit(lo) + F.lit((hi - lo) / (points - 1)) * F.col("step")
    return (
        lines.select(group, "intercept", "slope", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("step"))
        .select(group, "step", x.alias("x"), (F.col("intercept") + F.col("slope") * x).alias("y"))
    )
