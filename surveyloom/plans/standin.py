"""A survey-shaped view of the order tables: one line item is one observation.

Only the tables behind the roles asked for are joined. Lookup tables are attached after a
measurement of their size, so a larger one moves from broadcast to the salted join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from surveyloom.operators.lookup import attach, fits_broadcast, settle
from surveyloom.operators.models import InteractionSpec
from surveyloom.operators.normalize import Dimension, IndexSpec, composite_index
from surveyloom.operators.prep import add_score_band

SCORE, WEIGHT, GROUP, CONTROL, FLAG, INDEX = "score", "wt", "grp", "control", "flag", "idx"
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
FLAGS = ["A", "N", "R"]
ITEMS = ["discount", "effort", "item"]

INDEX_SPEC = IndexSpec(
    (
        Dimension("dim_resources", ("quantity", "site"), 0.25, reverse=True),
        Dimension("dim_access", ("discount",), 0.25, reverse=True),
        Dimension("dim_learning", ("psize", "tax"), 0.25),
        Dimension("dim_location", ("price",), 0.25, reverse=True),
    ),
    output=INDEX,
)
DIMENSIONS = INDEX_SPEC.names
INTERACTION = InteractionSpec(
    score=SCORE, index=INDEX, attitude_items=tuple(ITEMS), group=GROUP, weight=WEIGHT, control=CONTROL, negate=("item",)
)

# Roles as SQL expressions over the table that holds them.
_LINE_ROLES = {
    SCORE: "l_extendedprice / 100",
    WEIGHT: "CAST(l_linenumber AS DOUBLE)",
    FLAG: "l_returnflag",
    "quantity": "NULLIF(l_quantity, 50D)",
    "discount": "l_discount",
    "tax": "l_tax",
    "effort": "NULLIF(l_tax, 0.08D)",
    "item": "CAST(1 + l_partkey % 4 AS DOUBLE)",
}
_SITE_ROLES = {"site": "s_acctbal", GROUP: "n_name"}
_PART_ROLES = {"psize": "CAST(NULLIF(p_size, 50) AS DOUBLE)", "price": "p_retailprice"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def observations(spark: SparkSession, folder: str, *roles: str, keys: bool = False) -> DataFrame:
    """One row per line item with the named roles; ``keys=True`` keeps the line's own keys."""
    asked = list(dict.fromkeys(roles))
    df = lines = table(spark, folder, "lineitem")
    # Large lookups move every line, so they come first, while a line is no more than its own columns; what
    # follows from those is worked out at the end.
    if CONTROL in asked:
        orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        customers = table(spark, folder, "customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias(CONTROL)
        )
        held = attach(orders, customers, "o_custkey").select("l_orderkey", CONTROL)
        df = attach(df, held, "l_orderkey", small=fits_broadcast(orders))
    if any(r in _PART_ROLES for r in asked):
        parts = table(spark, folder, "part").select(
            F.col("p_partkey").alias("l_partkey"), *[F.expr(e).alias(r) for r, e in _PART_ROLES.items() if r in asked]
        )
        df = attach(df, parts, "l_partkey", keyed=lines)
    if any(r in _SITE_ROLES for r in asked):
        sites = table(spark, folder, "supplier")
        if GROUP in asked:
            sites = sites.join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        names = [F.col(c).alias(r) for r, c in _SITE_ROLES.items() if r in asked]
        df = attach(df, sites.select(F.col("s_suppkey").alias("l_suppkey"), *names), "l_suppkey", keyed=lines)
    own = [F.expr(_LINE_ROLES[r]).alias(r) if r in _LINE_ROLES else F.col(r) for r in asked]
    return df.select(*(KEYS if keys else []), *own)


def indexed(spark: SparkSession, folder: str, *roles: str, keys: bool = False) -> DataFrame:
    """Observations with dimension scores, the 0-100 index and the score band.

    The joined roles are settled first: the index needs two passes before its rows exist,
    and every later pass would otherwise repeat the joins.
    """
    wanted = [SCORE, WEIGHT, *INDEX_SPEC.columns, *roles]
    joined = settle(observations(spark, folder, *wanted, keys=keys))
    return add_score_band(composite_index(joined, INDEX_SPEC), SCORE)


def interaction_input(spark: SparkSession, folder: str) -> DataFrame:
    roles = [GROUP, CONTROL, *ITEMS]
    data = indexed(spark, folder, *roles)
    return data.select(SCORE, WEIGHT, INDEX, *roles)
