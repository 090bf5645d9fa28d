"""Many-to-one lookups that survive hot keys and large lookup tables.

``attach`` first measures the lookup side. A table that is proven small is broadcast, so
the big side never moves. Anything larger is joined through one shuffle in which the
frequent keys of the big side are spread over salts and the matching lookup rows are
repeated once per salt; all other lookup rows stay single.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F, types as T

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def one_row(df: DataFrame) -> Row:
    """Fetch an ungrouped aggregate. Its size does not depend on the data."""
    return df.first()


def checkpoint_home(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or one in the warehouse if none is named.

    Executors of a cluster do not see the driver's disk, so there a local warehouse is refused.
    """
    home = spark.conf.get("spark.checkpoint.dir", None)
    if home:
        return home
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    local = warehouse.startswith("file:") or "://" not in warehouse
    if local and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("Name a folder that all executors share in spark.checkpoint.dir")
    return f"{warehouse.rstrip('/')}/scratch"


def scratch_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return f"{checkpoint_home(spark).rstrip('/')}/surveyloom-{spark.conf.get('spark.app.id')}"


def settle(df: DataFrame) -> DataFrame:
    """Compute once, write as Parquet to shared storage, and go on from there.

    Later passes read the columns they need and repeat neither joins nor aggregates, and
    losing an executor costs nothing that was written. ``clear_scratch`` removes the files.
    """
    return settle_measured(df, [])[0]


def settle_measured(df: DataFrame, measures: Sequence[Column]) -> tuple[DataFrame, dict]:
    """``settle``, with aggregates of the rows observed while they are being written.

    The observation sits on the writing stage, where a repeated task counts once.
    """
    path = f"{scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    seen = Observation()
    (df.observe(seen, *measures) if measures else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), (seen.get if measures else {})


def clear_scratch(spark: SparkSession) -> bool:
    """Delete this application's settled tables; frames that read them stop working."""
    return delete_folder(scratch_folder(spark))


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    local = path.removeprefix("file:")
    if ":" not in local:
        return fs.LocalFileSystem(), "/" + local.lstrip("/") if path.startswith("file:") else local
    return fs.FileSystem.from_uri(path)


def delete_folder(path: str) -> bool:
    """Delete a folder and what is in it; False if there is none."""
    from pyarrow import fs

    system, own = file_system(path)
    if system.get_file_info(own).type != fs.FileType.Directory:
        return False
    system.delete_dir(own)
    return True


def _width(field: T.StructField) -> Column | None:
    """Bytes of a row beyond the fixed 8 per column, for types of variable size."""
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(F.col(field.name)))), F.lit(0))
    return None


def _size_measures(df: DataFrame) -> list[Column]:
    widths = [w for w in map(_width, df.schema.fields) if w is not None]
    fixed = F.count(F.lit(1)) * F.lit(8 * len(df.columns))
    total = fixed + F.coalesce(F.sum(sum(widths, F.lit(0).cast("long"))), F.lit(0)) if widths else fixed
    return [F.count(F.lit(1)).alias("__rows"), total.alias("__bytes")]


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Measure the table: its rows from the file footers, its strings by their lengths."""
    seen = one_row(df.agg(*_size_measures(df)))
    return seen["__rows"] <= rows and seen["__bytes"] <= size


def _match(left: DataFrame, right: DataFrame, on: Sequence[str], aliases: Sequence[str], null_safe: bool) -> Column:
    tests = [
        left[k].eqNullSafe(right[a]) if null_safe else left[k] == right[a] for k, a in zip(on, aliases)
    ]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def hot_key_hashes(df: DataFrame, on: Sequence[str], share: float | None = None) -> list[int]:
    """Hashes of keys that hold at least ``share`` of the rows: at most a few per ``1/share``.

    By default that is a quarter of what a task of an even shuffle gets.
    """
    if share is None:
        share = max(1e-5, 0.25 / int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = df.select(F.xxhash64(*on).alias("k"))
    return sorted(set(one_row(keyed.stat.freqItems(["k"], share))[0] or []))


def attach(
    facts: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    null_safe: bool = False,
    rows: int = BROADCAST_ROWS,
    size: int = BROADCAST_BYTES,
    salts: int | None = None,
    small: bool | None = None,
    keyed: DataFrame | None = None,
) -> DataFrame:
    """Join ``lookup`` (unique on ``on``) to ``facts``; the keys appear once in the result.

    ``small`` passes on a measurement that was already made. ``keyed`` is a table with the same
    keys as ``facts`` that is cheaper to read, for finding the frequent ones: where ``facts`` is
    itself a join, looking there would run that join once more.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    keys = [on] if isinstance(on, str) else list(on)
    payload = [c for c in lookup.columns if c not in keys]
    clash = [c for c in payload if c in facts.columns]
    if clash:
        raise ValueError(f"Columns on both sides: {', '.join(clash)}")
    aliases = [f"__key_{i}" for i in range(len(keys))]
    side = lookup.select(*[F.col(k).alias(a) for k, a in zip(keys, aliases)], *payload)
    out = [*[facts[c] for c in facts.columns], *[F.col(c) for c in payload]]

    if small is None:
        small = fits_broadcast(lookup, rows, size)
    if small:
        return facts.join(F.broadcast(side), _match(facts, side, keys, aliases, null_safe), how).select(*out)

    n = salts or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_key_hashes(keyed if keyed is not None else facts, keys)
    fact_hot, side_hot = F.xxhash64(*keys).isin(hot), F.xxhash64(*aliases).isin(hot)
    if not null_safe:
        # null keys never match, so they may go anywhere
        for k in keys:
            fact_hot = fact_hot | F.col(k).isNull()
    # the task number is stable when a task is retried, and cuts up a key that fills many tasks
    salted = facts.withColumn("__salt", F.when(fact_hot, F.pmod(F.spark_partition_id(), F.lit(n))).otherwise(0))
    spread = side.withColumn(
        "__slot", F.explode(F.when(side_hot, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0))))
    )
    match = _match(salted, spread, keys, aliases, null_safe) & (salted["__salt"] == spread["__slot"])
    # Spark's size estimate does not see the repeated rows, so rule out a broadcast by name
    return salted.join(spread.hint("merge"), match, how).select(*facts.columns, *payload)


def attach_aggregate(
    facts: DataFrame,
    aggregate: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    null_safe: bool = True,
    rows: int = BROADCAST_ROWS,
    size: int = BROADCAST_BYTES,
) -> DataFrame:
    """``attach`` for per-group results: they are computed once and measured as they are written."""
    held, seen = settle_measured(aggregate, _size_measures(aggregate))
    small = seen["__rows"] <= rows and seen["__bytes"] <= size
    return attach(facts, held, on, how, null_safe, small=small)


def add_site_columns(
    observations: DataFrame,
    sites: DataFrame,
    key: str,
    observation_columns: Sequence[str] | None = None,
    site_columns: Sequence[str] | None = None,
    check_unique: bool = True,
) -> DataFrame:
    """Left many-to-one join of site-level indicators, after pruning both sides."""
    from surveyloom.operators.checks import require_columns, require_unique

    left = observations.select(*(observation_columns or observations.columns))
    right = sites.select(*(site_columns or sites.columns))
    require_columns(left, [key])
    require_columns(right, [key])
    if check_unique:
        require_unique(right, [key])
    return attach(left, right, key, how="left")
