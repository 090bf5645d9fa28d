"""Tables that are kept per source file, in versions that readers resolve without a gap.

A table folder has two parts. ``data`` holds Parquet, one partition per run and source file;
``versions`` holds one small Parquet folder per version, which lists the live partitions. An
ingest reads only the files that are new or changed, writes their partitions beside the older
ones, and then writes the next version; a version counts once its writer has left the marker of
success. Nothing that a reader may hold is moved or overwritten, so no rename is needed, a failed
run leaves the older version in place, and unchanged files are neither read nor written again.
"""

from __future__ import annotations

import re
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from surveyloom.operators.checks import non_empty
from surveyloom.operators.lookup import attach_aggregate, delete_folder, file_system, one_row, settle
from surveyloom.sources.ingest import READERS, Source, list_files

RUN, FILE = "__run", "__file"
LIVE_SCHEMA = "path string, modified timestamp, size bigint, file string, run string, rows bigint"


def _home(target: str) -> str:
    return target.rstrip("/")


def version_numbers(target: str) -> list[int]:
    """Numbers of the complete versions of a table, oldest first."""
    system, own = file_system(f"{_home(target)}/versions")
    if system.get_file_info(own).type != fs.FileType.Directory:
        return []
    names = [i.base_name for i in system.get_file_info(fs.FileSelector(own)) if re.fullmatch(r"v\d{12}", i.base_name)]
    done = system.get_file_info([f"{own}/{n}/_SUCCESS" for n in names])
    return sorted(int(n[1:]) for n, i in zip(names, done) if i.type == fs.FileType.File)


def _folder(target: str, version: int) -> str:
    return f"{_home(target)}/versions/v{version:012d}"


def live_files(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """The source files of a version (by default the newest) and where their rows are."""
    if version is None:
        numbers = version_numbers(target)
        if not numbers:
            return spark.createDataFrame([], LIVE_SCHEMA)
        version = numbers[-1]
    return spark.read.schema(LIVE_SCHEMA).parquet(_folder(target, version))


def read_version(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the newest.

    Partitions are found by the list of live ones, which is a small table: a broadcast semi-join
    on partition columns, so partitions of other versions are pruned before they are read. What
    a running or failed ingest has written is in no list.
    """
    numbers = version_numbers(target)
    if not numbers:
        raise ValueError(f"{target} has no version")
    live = live_files(spark, target, version if version is not None else numbers[-1])
    data = spark.read.option("mergeSchema", "true").parquet(f"{_home(target)}/data")
    live = live.filter("rows > 0").select(F.col("run").alias(RUN), F.col("file").alias(FILE))
    return data.join(live, [RUN, FILE], "left_semi").drop(RUN, FILE)


def _decoded(path):
    """The path of a file as listings have it, from the one that Spark's readers report."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _key(path):
    """A name for a file's partition; schemes without a host are spelled in two ways."""
    return F.sha2(F.regexp_replace(path, "^(\\w+):/+", "$1:/"), 256)


def _read_paths(spark: SparkSession, source: Source, paths: list[str]) -> DataFrame:
    if source.format not in READERS:
        raise ValueError(f"format must be one of {', '.join(READERS)}")
    reader = spark.read.options(**{k: v for k, v in source.options.items() if k.lower() != "recursivefilelookup"})
    return (reader.schema(source.schema) if source.schema else reader).format(source.format).load(paths)


def ingest_incremental(spark: SparkSession, source: Source, compression: str = "snappy") -> dict:
    """Bring ``source.target`` up to its source files; returns what was done and the version.

    Files count as changed if their time or size differs. Only new and changed ones are read;
    rows of removed ones are in no later version. Without any difference no version is made. A
    file without rows is listed with 0 rows; a table that would have none at all is refused, and
    the older version stays. Two runs at a time write different data, and the one that commits
    last fails on the number of its version.

    The driver holds the paths of the files that are read, as Spark's own file index does.
    """
    target, numbers = _home(source.target), version_numbers(source.target)
    files = settle(list_files(spark, source.path).withColumn("file", _key(F.col("path"))))
    known = live_files(spark, target)
    same = ["path", "modified", "size", "file"]
    fresh = settle(files.join(known, same, "left_anti"))
    new = fresh.join(known, "file", "left_anti").count()
    counts = {"added": new, "changed": fresh.count() - new, "removed": known.join(files, "file", "left_anti").count()}
    if numbers and not any(counts.values()):
        return {"dataset": source.name, "status": "skipped", "version": numbers[-1], **counts}

    run, held = uuid.uuid4().hex, None
    written = f"{target}/data/{RUN}={run}"
    paths = [r["path"] for r in fresh.select("path").collect()]
    try:
        if paths:
            rows = _read_paths(spark, source, paths)
            if not rows.columns:
                raise ValueError(f"Source '{source.name}' has no columns")
            rows = rows.withColumn(FILE, _key(_decoded(F.col("_metadata.file_path"))))
            rows.write.option("compression", compression).partitionBy(FILE, *source.partition_by).parquet(written)
            if non_empty(spark.read.option("basePath", written).parquet(written)) if _has_files(written) else False:
                held = spark.read.parquet(written).groupBy(F.col(FILE).alias("file")).agg(F.count(F.lit(1)).alias("rows"))
        listed = fresh.withColumn("run", F.lit(run))
        listed = attach_aggregate(listed, held, "file") if held is not None else listed.withColumn("rows", F.lit(None).cast("long"))
        listed = listed.withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
        kept = known.join(files, same, "left_semi")
        columns = ["path", "modified", "size", "file", "run", "rows"]
        live = settle(kept.select(*columns).unionByName(listed.select(*columns)))
        total = one_row(live.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")))["n"]
        if not total:
            raise ValueError(f"Source '{source.name}' has no rows")
        version = numbers[-1] + 1 if numbers else 1
        live.coalesce(1).write.mode("errorifexists").parquet(_folder(target, version))
    except Exception:
        delete_folder(written)
        raise
    return {"dataset": source.name, "status": "ingested", "version": version, "rows": total, **counts}


def _has_files(folder: str) -> bool:
    """Whether a folder has partitions; Spark writes none for an input without rows."""
    system, own = file_system(folder)
    return any(i.type == fs.FileType.Directory for i in system.get_file_info(fs.FileSelector(own)))


def drop_old_versions(spark: SparkSession, target: str, keep: int = 2) -> int:
    """Delete all but the newest versions, and the partitions that none of those lists.

    To be run while no ingest runs and no reader uses an older version. Returns the number of
    partitions deleted. The driver holds the names of the partitions, one per source file.
    """
    numbers = version_numbers(target)
    if keep < 1:
        raise ValueError("keep must be 1 or more")
    for n in numbers[:-keep]:
        delete_folder(_folder(target, n))
    live = {(r["run"], r["file"]) for n in numbers[-keep:] for r in live_files(spark, target, n).select("run", "file").collect()}
    system, own = file_system(f"{_home(target)}/data")
    deleted = 0
    for run in system.get_file_info(fs.FileSelector(own, allow_not_found=True)):
        if run.type != fs.FileType.Directory or "=" not in run.base_name:
            continue
        name, left = run.base_name.split("=", 1)[1], 0
        for part in system.get_file_info(fs.FileSelector(run.path)):
            if part.type != fs.FileType.Directory:
                continue
            if (name, part.base_name.split("=", 1)[1]) in live:
                left += 1
            else:
                system.delete_dir(part.path)
                deleted += 1
        if not left:
            system.delete_dir(run.path)
    return deleted
