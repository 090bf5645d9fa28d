"""Per-file ingest in versions."""

import csv
import os
import time
from pathlib import Path

import pytest

from surveyloom.sources import ingest as ig, versions as vs


def write_csv(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([("id", "x"), *rows])


@pytest.fixture
def source(folder):
    write_csv(f"{folder}/in/a+ b.csv", [(1, 2.5), (2, 3.5)])
    write_csv(f"{folder}/in/b.csv", [(3, 1.0)])
    write_csv(f"{folder}/in/c.csv", [(4, 1.0)])
    return ig.Source("pupils", f"{folder}/in", f"{folder}/out", options={"header": "true"}, schema="id int, x double")


def ids(spark, source, version=None):
    return sorted(r["id"] for r in vs.read_version(spark, source.target, version).collect())


def data_files(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).glob("out/data/*/*/*.parquet")}


def test_only_what_changed_is_written(spark, folder, source):
    done = vs.ingest_incremental(spark, source)
    assert (done["status"], done["version"], done["added"], done["rows"]) == ("ingested", 1, 3, 4)
    assert ids(spark, source) == [1, 2, 3, 4] and vs.read_version(spark, source.target).columns == ["id", "x"]
    before = data_files(folder)
    assert vs.ingest_incremental(spark, source)["status"] == "skipped" and data_files(folder) == before
    time.sleep(1.1)
    write_csv(f"{folder}/in/b.csv", [(30, 1.0), (31, 1.0)])
    write_csv(f"{folder}/in/d.csv", [(5, 1.0)])
    Path(f"{folder}/in/c.csv").unlink()
    done = vs.ingest_incremental(spark, source)
    assert (done["version"], done["added"], done["changed"], done["removed"], done["rows"]) == (2, 1, 1, 1, 5)
    assert ids(spark, source) == [1, 2, 5, 30, 31]
    after = data_files(folder)
    assert {p: t for p, t in after.items() if p in before} == before and len(after) == len(before) + 2
    # the older version is still whole
    assert ids(spark, source, 1) == [1, 2, 3, 4]
    live = {os.path.basename(r["path"]): r["rows"] for r in vs.live_files(spark, source.target).collect()}
    assert live == {"a+ b.csv": 2, "b.csv": 2, "d.csv": 1}


def test_removed_files_alone_make_a_version(spark, folder, source):
    vs.ingest_incremental(spark, source)
    Path(f"{folder}/in/c.csv").unlink()
    assert vs.ingest_incremental(spark, source)["removed"] == 1 and ids(spark, source) == [1, 2, 3]


def test_a_reader_between_write_and_commit_sees_the_older_table(spark, folder, source, monkeypatch):
    vs.ingest_incremental(spark, source)
    held = vs.read_version(spark, source.target)
    write_csv(f"{folder}/in/d.csv", [(5, 1.0)])
    seen = []
    count = vs.one_row

    def look(df):
        # rows are written, the version is not
        seen.append((len(data_files(folder)), ids(spark, source)))
        return count(df)

    monkeypatch.setattr(vs, "one_row", look)
    vs.ingest_incremental(spark, source)
    assert seen == [(4, [1, 2, 3, 4])]
    assert ids(spark, source) == [1, 2, 3, 4, 5] and sorted(r["id"] for r in held.collect()) == [1, 2, 3, 4]


def test_a_failed_run_leaves_the_older_table(spark, folder, source, monkeypatch):
    vs.ingest_incremental(spark, source)
    write_csv(f"{folder}/in/d.csv", [(5, 1.0)])

    def broken(df):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(vs, "one_row", broken)
        with pytest.raises(RuntimeError):
            vs.ingest_incremental(spark, source)
    assert ids(spark, source) == [1, 2, 3, 4] and vs.version_numbers(source.target) == [1]
    # a version without the marker of success does not count
    os.makedirs(f"{folder}/out/versions/v000000000007")
    assert vs.version_numbers(source.target) == [1]
    assert vs.ingest_incremental(spark, source)["added"] == 1 and ids(spark, source) == [1, 2, 3, 4, 5]


def test_empty_files_and_tables(spark, folder, source):
    vs.ingest_incremental(spark, source)
    for name in ("a+ b.csv", "b.csv", "c.csv"):
        Path(f"{folder}/in/{name}").unlink()
    write_csv(f"{folder}/in/e.csv", [])
    with pytest.raises(ValueError, match="no rows"):
        vs.ingest_incremental(spark, source)
    assert ids(spark, source) == [1, 2, 3, 4]
    write_csv(f"{folder}/in/f.csv", [(6, 1.0)])
    assert vs.ingest_incremental(spark, source)["rows"] == 1 and ids(spark, source) == [6]
    with pytest.raises(ValueError, match="no version"):
        vs.read_version(spark, f"{folder}/nowhere")


def test_old_versions_go(spark, folder, source):
    for i in range(3):
        write_csv(f"{folder}/in/b.csv", [(3 + 10 * j, 1.0) for j in range(i + 1)])
        vs.ingest_incremental(spark, source)
    assert vs.version_numbers(source.target) == [1, 2, 3] and len(data_files(folder)) == 5
    assert vs.drop_old_versions(spark, source.target, keep=1) == 2
    assert vs.version_numbers(source.target) == [3] and len(data_files(folder)) == 3
    assert ids(spark, source) == [1, 2, 3, 4, 13, 23]


def test_pruned_by_partition(spark, folder, source):
    vs.ingest_incremental(spark, source)
    plan = vs.read_version(spark, source.target)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "CartesianProduct" not in plan
