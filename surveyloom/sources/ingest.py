"""Incremental ingest of files Spark can read into Parquet, with a manifest and checks."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from surveyloom.operators.checks import non_empty
from surveyloom.operators.lookup import delete_folder, file_system, settle

READERS = ("csv", "json", "parquet", "orc", "text")
MANIFEST_SCHEMA = (
    "dataset string, path string, modified timestamp, size bigint, target string, "
    "rows bigint, columns int, ingested_at timestamp"
)
RESULT_SCHEMA = "dataset string, target string, status string, rows bigint, columns int, message string"


@dataclass(frozen=True)
class Source:
    """Where a dataset comes from and how Spark reads it."""

    name: str
    path: str
    target: str
    format: str = "csv"
    options: Mapping[str, str] = field(default_factory=dict)
    schema: str | None = None
    partition_by: tuple[str, ...] = ()

    def read(self, spark: SparkSession) -> DataFrame:
        if self.format not in READERS:
            raise ValueError(f"format must be one of {', '.join(READERS)}")
        reader = spark.read.options(**self.options)
        return (reader.schema(self.schema) if self.schema else reader).format(self.format).load(self.path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, modification time and size of each file; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    )


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).schema
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def replace_folder(new: str, target: str) -> None:
    """Put a finished folder in the place of an older one, which is only deleted after the swap."""
    system, own = file_system(target.rstrip("/"))
    _, made = file_system(new)
    old = f"{own}.old-{uuid.uuid4().hex}"
    there = system.get_file_info(own).type != fs.FileType.NotFound
    if there:
        system.move(own, old)
    system.move(made, own)
    if there:
        system.delete_dir(old)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """All ingest records; an empty table before the first run."""
    if not _exists(spark, path):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(path)


def latest_records(manifest: DataFrame) -> DataFrame:
    """The most recent record of each file of each dataset."""
    newest = Window.partitionBy("dataset", "path").orderBy(F.desc("ingested_at"))
    return manifest.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def changed_files(files: DataFrame, manifest: DataFrame, dataset: str) -> DataFrame:
    """Files that are new, or whose time or size differs from the last record.

    Both sides are listings: one row per file, not per record in a file.
    """
    known = latest_records(manifest.where(F.col("dataset") == dataset)).select("path", "modified", "size")
    return files.join(known, ["path", "modified", "size"], "left_anti")


def removed_files(files: DataFrame, manifest: DataFrame, dataset: str) -> DataFrame:
    """Files the last ingest saw that are gone now."""
    known = latest_records(manifest.where(F.col("dataset") == dataset))
    last = known.agg(F.max("ingested_at").alias("t")).first()["t"]
    if last is None:
        return known.select("path").limit(0)
    return known.where(F.col("ingested_at") == F.lit(last)).select("path").join(files, "path", "left_anti")


def needs_ingest(spark: SparkSession, source: Source, manifest_path: str) -> bool:
    """True if the target is absent or any source file was added, changed or removed."""
    if not _exists(spark, f"{source.target.rstrip('/')}/_SUCCESS"):
        return True
    files, manifest = list_files(spark, source.path), read_manifest(spark, manifest_path)
    return not changed_files(files, manifest, source.name).isEmpty() or not removed_files(
        files, manifest, source.name
    ).isEmpty()


def ingest(
    spark: SparkSession,
    source: Source,
    manifest_path: str,
    force: bool = False,
    compression: str = "snappy",
    max_records_per_file: int | None = None,
) -> dict:
    """Write a dataset as Parquet and record its files; skip it when nothing changed.

    Spark splits the input and commits the output as a whole, so small and large files
    take the same road. The output is written beside the target and swapped in when it is
    whole, so a failed run leaves the old table. The listing is taken before reading: a file that changes meanwhile
    is picked up by the next run.
    """
    if not force and not needs_ingest(spark, source, manifest_path):
        return {"dataset": source.name, "target": source.target, "status": "skipped"}
    files = settle(list_files(spark, source.path))
    data = source.read(spark)
    if not non_empty(data):
        raise ValueError(f"Source '{source.name}' has no rows or no columns")
    # written aside: until it is whole and counted, the old table stays where it is
    aside = f"{source.target.rstrip('/')}.new-{uuid.uuid4().hex}"
    writer = data.write.option("compression", compression)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    if source.partition_by:
        writer = writer.partitionBy(*source.partition_by)
    try:
        writer.parquet(aside)
        rows, columns = spark.read.parquet(aside).count(), len(data.columns)
    except Exception:
        delete_folder(aside)
        raise
    replace_folder(aside, source.target)
    spark.catalog.refreshByPath(source.target)
    records = files.select(
        F.lit(source.name).alias("dataset"),
        "path",
        "modified",
        "size",
        F.lit(source.target).alias("target"),
        F.lit(rows).cast("bigint").alias("rows"),
        F.lit(columns).alias("columns"),
        F.current_timestamp().alias("ingested_at"),
    )
    records.coalesce(1).write.mode("append").parquet(manifest_path)
    return {"dataset": source.name, "target": source.target, "status": "ingested", "rows": rows, "columns": columns}


def ingest_all(
    spark: SparkSession, sources: Sequence[Source], manifest_path: str, force: bool = False, **options
) -> DataFrame:
    """Ingest several datasets; one result row each, with the error of those that failed."""
    results = []
    for source in sources:
        try:
            r = ingest(spark, source, manifest_path, force, **options)
            results.append((r["dataset"], r["target"], r["status"], r.get("rows"), r.get("columns"), None))
        except Exception as error:  # one bad file must not stop the others
            results.append((source.name, source.target, "failed", None, None, str(error)))
    return spark.createDataFrame(results, RESULT_SCHEMA)


def validate_source(df: DataFrame) -> dict:
    """Non-empty rows and columns."""
    problems = []
    if not df.columns:
        problems.append("no columns")
    elif df.isEmpty():
        problems.append("no rows")
    return {"valid": not problems, "problems": problems}


def validate_ingest(source: DataFrame, target: DataFrame, dataset: str = "") -> DataFrame:
    """Row count, column count and schema of source and target, as one row."""
    spark = source.sparkSession
    counts = source.agg(F.count(F.lit(1)).alias("source_rows")).withColumn("__d", F.lit(dataset))
    other = target.agg(F.count(F.lit(1)).alias("target_rows")).withColumn("__d", F.lit(dataset))
    kinds = lambda d: {f.name: f.dataType for f in d.schema.fields}
    same = kinds(source) == kinds(target)
    return counts.join(other, "__d").select(
        F.col("__d").alias("dataset"),
        "source_rows",
        "target_rows",
        F.lit(len(source.columns)).alias("source_columns"),
        F.lit(len(target.columns)).alias("target_columns"),
        F.lit(same).alias("same_schema"),
        (
            (F.col("source_rows") == F.col("target_rows")) & F.lit(len(source.columns) == len(target.columns))
        ).alias("valid"),
    )


def validate_all(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """Compare every source with its Parquet target."""
    checks = [validate_ingest(s.read(spark), spark.read.parquet(s.target), s.name) for s in sources]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def codebook(df: DataFrame, sample_rows: int = 100, samples: int = 5) -> DataFrame:
    """Name, label, type, value labels and first sample values of every column.

    Labels come from the column metadata (``label``, ``value_labels``). Samples are looked
    for in the first ``sample_rows`` rows only, which is what they are: samples.
    """
    head = df.limit(sample_rows)
    found = head.agg(
        *[
            F.slice(F.collect_list(F.col(c).cast("string")), 1, samples).alias(f"v{i}")
            for i, c in enumerate(df.columns)
        ]
    )
    entries = []
    for i, f in enumerate(df.schema.fields):
        labels = f.metadata.get("value_labels") or {}
        pairs = [x for k, v in labels.items() for x in (F.lit(str(k)), F.lit(str(v)))]
        known = F.create_map(*pairs) if pairs else F.create_map().cast(T.MapType(T.StringType(), T.StringType()))
        entries.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.metadata.get("label") or "").alias("label"),
                F.lit(f.dataType.simpleString()).alias("type"),
                known.alias("value_labels"),
                F.col(f"v{i}").alias("samples"),
            )
        )
    return found.select(F.inline(F.array(*entries)))


def write_codebook(df: DataFrame, path: str, **options) -> None:
    """The codebook as one JSON document per column."""
    codebook(df, **options).coalesce(1).write.mode("overwrite").json(path)
