"""Weighted cross-tabulation, its presentation forms, and the test of independence."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from surveyloom.functions.columns import percent, present
from surveyloom.functions.tails import chi2_tail
from surveyloom.operators.checks import require_columns
from surveyloom.operators.lookup import attach, one_row, settle
from surveyloom.operators.prep import category_levels

TOTAL = "total"
#: Column labels that a task opens at a time when it makes empty cells.
BLOCK_LABELS = 8192
#: Cells that a task makes in a large grid, as long as these are so many tasks at most.
TASK_CELLS, MAX_TASKS = 2**25, 20_000
#: Row labels per task from which a row label's cells stay in one task.
WHOLE_ROWS = 16
#: The largest value of an ``int``.
INT_MAX = 2**31 - 1


def weighted_cells(df: DataFrame, row: str, column: str, weight: str) -> DataFrame:
    """``(row, column, weighted_count, n)``, one row per cell that occurs."""
    require_columns(df, [row, column, weight])
    return df.groupBy(row, column).agg(F.sum(weight).alias("weighted_count"), F.count(F.lit(1)).alias("n"))


def crosstab(
    df: DataFrame, row: str, column: str, weight: str, column_values: Sequence | None = None
) -> DataFrame:
    """Weighted count per row label and column label, empty cells 0.

    Passing ``column_values`` saves the pass that lists them and fixes their order; other labels get
    no column then.
    """
    require_columns(df, [row, column, weight])
    values = list(column_values) if column_values is not None else category_levels(df, column)
    return df.groupBy(row).pivot(column, values).agg(F.sum(weight)).na.fill(0.0, [str(v) for v in values])


def filled_cells(
    df: DataFrame, row: str, column: str, weight: str, column_values: Sequence | None = None
) -> DataFrame:
    """The cross-tab in long form with its empty cells as 0, for any number of labels.

    ``column_values`` adds labels that do not occur; all that occur are kept. What is moved are the
    cells that occur, each as its place among the labels of its block, and one line per row label
    and block. A line reaches up to the next cell that occurs, so tasks count the empty cells off
    without looking any up.
    """
    cells = settle(df.groupBy(row, column).agg(F.sum(present(weight)).alias("weighted_count")))
    kind = df.schema[column].dataType
    found = cells.select(F.col(column).alias("__column")).where("__column IS NOT NULL")
    if column_values is not None:
        found = found.union(df.sparkSession.createDataFrame([(v,) for v in column_values], T.StructType([T.StructField("__column", kind)])))
    found = settle(found.distinct())
    rows = settle(cells.select(F.col(row).alias("__row")).distinct())
    n_columns, n_rows = found.count(), rows.count()
    blocks = max(1, math.ceil(n_columns / BLOCK_LABELS))
    block = F.pmod(F.xxhash64("__column"), F.lit(blocks))
    # written, since a label's place and the label at a place come from different readings
    labels = settle(found.groupBy(block.alias("__block")).agg(F.collect_list("__column").alias("__labels")))
    places = labels.select("__block", F.posexplode("__labels").alias("__at", "__column"))
    own = cells.select(F.col(row).alias("__row"), F.col(column).alias("__column"), "weighted_count").where("__column IS NOT NULL")
    own = attach(own, places, "__column", how="inner").select("__row", "__block", "__at", "weighted_count")
    # a line before the first place, for every row label and every block
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    starts = rows.select("__row", every.alias("__block"))
    lines = starts.select("__row", "__block", F.lit(-1).alias("__at"), F.lit(None).cast(own.schema["weighted_count"].dataType).alias("weighted_count"))
    lines = lines.union(own)
    # Spark deals lines out by their bytes, but the work is in the cells that they open
    tasks = min(MAX_TASKS, math.ceil(n_rows * n_columns / TASK_CELLS))
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        # row labels have the same number of cells, so many of them go evenly; sums per row label then move nothing more
        lines = lines.repartition(tasks, "__row", *([] if n_rows >= WHOLE_ROWS * tasks else ["__block"]))
    until = F.lead("__at").over(Window.partitionBy("__row", "__block").orderBy("__at"))
    lines = attach(lines.withColumn("__until", until), labels, "__block", how="inner", keyed=starts)
    first, last = F.greatest("__at", F.lit(0)), F.coalesce("__until", F.size("__labels")) - 1
    run = F.posexplode(F.when(first <= last, F.sequence(first, last))).alias("__step", "__place")
    grid = lines.select("__row", "__labels", "weighted_count", run)
    # only the first cell of a line can be one that occurs
    value = F.coalesce(F.when(F.col("__step") == 0, F.col("weighted_count")), F.lit(0.0))
    return grid.select(F.col("__row").alias(row), F.get("__labels", F.col("__place")).alias(column), value.alias("weighted_count"))


def crosstab_with_totals(df: DataFrame, row: str, column: str, weight: str) -> DataFrame:
    """Cells, row totals, column totals and the grand total from one ``cube``."""
    cells = weighted_cells(df, row, column, weight)
    # the cube repeats cells, not observations
    cubed = cells.cube(row, column).agg(
        F.sum("weighted_count").alias("weighted_count"), F.grouping(row).alias("__r"), F.grouping(column).alias("__c")
    )
    name = lambda c, g: F.when(F.col(g) == 1, F.lit(TOTAL)).otherwise(F.col(c).cast("string")).alias(c)
    return cubed.select(name(row, "__r"), name(column, "__c"), "weighted_count")


def row_percent(cells: DataFrame, row: str, value: str = "weighted_count") -> DataFrame:
    """Add each cell's percent of its row; takes cells, not observations."""
    return cells.withColumn("row_percent", percent(value, F.sum(value).over(Window.partitionBy(row))))


def expected_cells(
    df: DataFrame,
    row: str,
    column: str,
    weight: str,
    column_values: Sequence | None = None,
    rescale: bool = False,
) -> DataFrame:
    """Observed and expected counts of every cell with non-zero margins.

    ``rescale=True`` scales the weights so that they sum to the number of rows, which
    keeps the statistic from growing with the population the weights stand for.
    """
    data = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    cells = filled_cells(data, row, column, weight, column_values)
    observed = F.col("weighted_count")
    if rescale:
        # the table has few cells, but its size in rows is only known from the data
        size = data.agg((F.count(F.lit(1)) / F.sum(weight)).alias("f")).first()["f"]
        observed = observed * F.lit(size)
    cells = cells.select(row, column, observed.alias("observed"))
    return (
        cells.withColumn("row_total", F.sum("observed").over(Window.partitionBy(row)))
        .withColumn("column_total", F.sum("observed").over(Window.partitionBy(column)))
        .withColumn("grand_total", cells.agg(F.sum("observed")).scalar())
        .where("row_total > 0 AND column_total > 0")
        .withColumn("expected", F.col("row_total") * F.col("column_total") / F.col("grand_total"))
    )


@F.pandas_udf(T.DoubleType())
def _chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(
        [chi2_tail(a, int(k)) if not math.isnan(a) and k > 0 else math.nan for a, k in zip(x, dof)]
    )


def chi_square(
    df: DataFrame,
    row: str,
    column: str,
    weight: str,
    rescale: bool = False,
    correction: bool = True,
    alpha: float = 0.05,
) -> DataFrame:
    """Statistic, p-value, degrees of freedom, Cramér's V and significance, as one row.

    Rows and columns without weight are left out. ``correction`` applies the continuity
    correction, and only to a table with one degree of freedom. Works on the cells that occur,
    whatever their number. ``dof`` is an ``int``, or a ``bigint`` where it does not fit.
    """
    data = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    cells = settle(weighted_cells(data, row, column, weight))
    grand = cells.agg(F.sum("weighted_count").alias("w"), F.sum("n").alias("n"))
    # margins are result-sized tables of their own; empty cells never become rows
    rows = cells.groupBy(row).agg(F.sum("weighted_count").alias("row_total")).where("row_total > 0")
    columns = cells.groupBy(column).agg(F.sum("weighted_count").alias("column_total")).where("column_total > 0")
    total = grand.select("w").scalar()
    filled = cells.join(rows, row).join(columns, column)
    expected = F.col("row_total") * F.col("column_total") / F.col("total")
    filled = filled.withColumn("total", total).withColumn("expected", expected)
    gap = F.abs(F.col("weighted_count") - F.col("expected"))
    table = settle(
        filled.agg(
            F.count_distinct(row).alias("r"),
            F.count_distinct(column).alias("c"),
            # an empty cell adds all that is expected in it
            (F.sum(gap * gap / F.col("expected")) + F.first("total") - F.sum("expected")).alias("plain"),
            F.max(gap).alias("gap"),
            F.first("total").alias("total"),
        )
    )
    free = (F.col("r") - 1) * (F.col("c") - 1)
    kind = "int" if one_row(table.select(free.alias("dof")))["dof"] <= INT_MAX else "bigint"
    table = table.withColumn("dof", free.cast(kind))
    # weights that sum to the number of rows shrink every cell, and so the statistic, alike
    scale = grand.select(F.col("n") / F.col("w")).scalar() if rescale else F.lit(1.0)
    table = table.withColumns({m: F.col(m) * scale for m in ("plain", "gap", "total")})
    # the four gaps of a table with one degree of freedom are equal
    shrunk = F.when(F.col("gap") > 0, (F.col("gap") - F.least("gap", F.lit(0.5))) / F.col("gap")).otherwise(F.lit(0.0))
    table = table.withColumn("plain", F.greatest("plain", F.lit(0.0))).withColumn("corrected", F.col("plain") * shrunk * shrunk)
    value = F.when((F.col("dof") == 1) & F.lit(correction), F.col("corrected")).otherwise(F.col("plain"))
    table = table.withColumn("statistic", value)
    spread = F.col("total") * (F.least("r", "c") - 1)
    return table.select(
        "statistic",
        _chi2_p("statistic", "dof").alias("p_value"),
        "dof",
        F.col("total").alias("total_weight"),
        F.sqrt(F.try_divide(F.col("plain"), spread)).alias("cramers_v"),
    ).withColumn("significant", F.col("p_value") < F.lit(alpha))
