import csv
import json
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F, types as T

from surveyloom.operators import profile as pf
from surveyloom.sources import ingest as ig
from surveyloom.sources import sinks
from surveyloom.sources.catalog import Catalog


def write_csv(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows(rows)


@pytest.fixture
def source(folder):
    write_csv(f"{folder}/in/a.csv", [("id", "x"), (1, 2.5), (2, 3.5)])
    return ig.Source("pupils", f"{folder}/in", f"{folder}/out", options={"header": "true"}, schema="id int, x double")


def test_catalog(spark, folder):
    spark.range(3).write.parquet(f"{folder}/student.parquet")
    c = Catalog(folder, ("student", "school"), paths={"school": "/elsewhere/s"})
    assert c.read(spark, "student").count() == 3 and c.path("school") == "/elsewhere/s"
    with pytest.raises(KeyError, match="student"):
        c.path("teacher")


def test_ingest_runs_once_until_the_files_change(spark, folder, source):
    manifest = f"{folder}/manifest"
    run = lambda **k: ig.ingest(spark, source, manifest, **k)["status"]
    assert run() == "ingested" and run() == "skipped" and run(force=True) == "ingested"
    time.sleep(1.1)
    write_csv(f"{folder}/in/a.csv", [("id", "x"), (1, 2.5), (2, 3.5), (3, 4.5)])
    assert run() == "ingested" and spark.read.parquet(source.target).count() == 3 and run() == "skipped"
    write_csv(f"{folder}/in/b.csv", [("id", "x"), (4, 1.0)])
    changed = ig.changed_files(ig.list_files(spark, source.path), ig.read_manifest(spark, manifest), "pupils")
    assert [os.path.basename(r["path"]) for r in changed.collect()] == ["b.csv"]
    assert run() == "ingested" and spark.read.parquet(source.target).count() == 4
    Path(f"{folder}/in/b.csv").unlink()
    assert run() == "ingested" and run() == "skipped"
    last = ig.latest_records(ig.read_manifest(spark, manifest)).where("path LIKE '%a.csv'").first()
    assert (last["rows"], last["columns"], last["target"]) == (3, 2, source.target)


def test_ingest_all_reports_each_dataset(spark, folder, source):
    write_csv(f"{folder}/empty/e.csv", [("id", "x")])
    empty = ig.Source("empty", f"{folder}/empty", f"{folder}/out2", options={"header": "true"}, schema="id int, x double")
    absent = ig.Source("absent", f"{folder}/nowhere", f"{folder}/out3")
    odd = ig.Source("odd", f"{folder}/in", f"{folder}/out4", format="sav")
    rows = {r["dataset"]: r for r in ig.ingest_all(spark, [source, empty, absent, odd], f"{folder}/m").collect()}
    assert rows["pupils"]["status"] == "ingested" and rows["pupils"]["rows"] == 2
    assert {rows[d]["status"] for d in ("empty", "absent", "odd")} == {"failed"}
    assert "no rows" in rows["empty"]["message"] and "format" in rows["odd"]["message"]


def test_partitioned_target(spark, folder, source):
    part = ig.Source("p", source.path, f"{folder}/part", options=source.options, schema=source.schema, partition_by=("id",))
    ig.ingest(spark, part, f"{folder}/m", compression="zstd", max_records_per_file=1)
    assert {d for d in os.listdir(part.target) if d.startswith("id=")} == {"id=1", "id=2"}


def test_validation(spark, source, folder):
    ig.ingest(spark, source, f"{folder}/m")
    assert ig.validate_all(spark, [source]).first()["valid"]
    a = source.read(spark)
    r = ig.validate_ingest(a, a.limit(1).drop("x"), "d").first()
    assert (r["source_rows"], r["target_rows"], r["same_schema"], r["valid"]) == (2, 1, False, False)
    assert ig.validate_source(a)["valid"]
    assert ig.validate_source(a.where("id > 9"))["problems"] == ["no rows"]


def test_codebook(spark, folder):
    meta = {"label": "Sex", "value_labels": {"1": "Female", "2": "Male"}}
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, None)], "s int, t string")
    df = df.select(F.col("s").alias("s", metadata=meta), "t")
    rows = ig.codebook(df, samples=1).collect()
    assert (rows[0]["label"], rows[0]["type"], rows[0]["samples"]) == ("Sex", "int", ["1"])
    assert rows[0]["value_labels"] == {"1": "Female", "2": "Male"} and rows[1]["value_labels"] == {}
    ig.write_codebook(df, f"{folder}/book")
    part = next(p for p in os.listdir(f"{folder}/book") if p.endswith(".json"))
    assert [json.loads(line)["column"] for line in open(f"{folder}/book/{part}")] == ["s", "t"]


def test_sinks(spark, folder):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(1, "low", Vectors.dense(1.0)), (2, "high", Vectors.dense(2.0))], ["id", "band", "v"])
    sinks.write_rows(df, f"{folder}/rows", partition_by=["band"])
    assert spark.read.parquet(f"{folder}/rows").where("band = 'low'").first()["id"] == 1
    nested = df.withColumn("m", F.create_map(F.lit("k"), F.col("id")))
    paths = sinks.write_tables({"t": nested.orderBy("id")}, folder)
    back = spark.read.option("header", True).csv(paths[0])
    assert back.columns == ["id", "band", "m"] and back.where("id = 1").first()["m"] == '{"k":1}'
    sinks.write_table(df, f"{folder}/sorted", order_by=["band"])
    part = next(p for p in os.listdir(f"{folder}/sorted") if p.endswith(".csv"))
    assert open(f"{folder}/sorted/{part}").read().splitlines() == ["id,band", "2,high", "1,low"]


def test_missing_value_table(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (1.0, 1.0)], "a double, w double")
    table = sinks.missing_value_table(pf.missing_report(df, ["a"]), pf.sample_loss(df, ["a"], "w"), {"a": "Item A"})
    rows = [tuple(r) for r in table.collect()]
    assert rows[0] == ("Item A", "a", 3.0, 2.0, 1.0, 33.33)
    assert rows[2] == ("Sample loss (weighted)", "all", 4.0, 3.0, 1.0, 25.0)
    assert isinstance(table.schema["total"].dataType, T.DoubleType)


def test_failed_ingest_keeps_the_old_table(spark, folder):
    path, target = f"{folder}/in.csv", f"{folder}/out"
    with open(path, "w") as f:
        f.write("a,b\n1,2\n3,4\n")
    source = ig.Source("t", path, target, options={"header": "true", "mode": "FAILFAST"}, schema="a int, b int")
    assert ig.ingest(spark, source, f"{folder}/manifest")["rows"] == 2
    with open(path, "w") as f:
        f.write("a,b\n1,2\nbad,record\n5,6\n")
    with pytest.raises(Exception):
        ig.ingest(spark, source, f"{folder}/manifest")
    assert sorted(tuple(r) for r in spark.read.parquet(target).collect()) == [(1, 2), (3, 4)]
    assert sorted(os.listdir(folder)) == ["in.csv", "manifest", "out"]
    with open(path, "w") as f:
        f.write("a,b\n7,8\n")
    assert ig.ingest(spark, source, f"{folder}/manifest")["rows"] == 1
    assert spark.read.parquet(target).first() == (7, 8)
