import math

import pytest
from pyspark.sql import functions as F

from surveyloom.operators import grouped as gr
from surveyloom.operators import normalize as nm


def test_zscore(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, None)], "x double, k double")
    rows = nm.zscore(df, ["x", "k"]).collect()
    assert [r["x_z"] for r in rows] == [-1.0, 0.0, 1.0]
    assert [r["k_z"] for r in rows] == [0.0, 0.0, None]
    assert nm.zscore(df.where("x > 9"), "x").count() == 0


def test_zscore_within_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 7.0), (None, 1.0), (None, 2.0)], "g string, x double")
    got = sorted((str(r["g"]), r["x"], round(r["x_z"], 6)) for r in nm.zscore(df, "x", by="g").collect())
    half = round(1 / math.sqrt(2), 6)
    assert got == [("None", 1.0, -half), ("None", 2.0, half), ("a", 1.0, -half), ("a", 3.0, half), ("b", 7.0, 0.0)]


def test_dimension_score_signs_and_missing(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, None), (3.0, 30.0)], "x double, y double")
    dim = nm.Dimension("d", ("x", "y", "absent"), reverse=True)
    half = math.sqrt(0.5)
    got = [r["d"] for r in nm.dimension_score(df, dim).collect()]
    assert got == pytest.approx([(1 + half) / 2, 0.0, -(1 + half) / 2])
    flipped = nm.dimension_score(df, nm.Dimension("d", ("x", "y"), reverse=True, flip=frozenset({"y"})))
    assert flipped.first()["d"] == pytest.approx((1 - half) / 2)
    assert nm.dimension_score(df, dim, missing="keep").collect()[1]["d"] is None
    assert nm.dimension_score(df, dim, missing="drop").count() == 2
    raw = nm.dimension_score(df, nm.Dimension("d", ("x", "y")), standardize=False)
    assert [r["d"] for r in raw.collect()] == [5.5, 11.0, 16.5] and raw.columns == ["x", "y", "d"]
    zero = nm.dimension_score(df, nm.Dimension("d", ("x", "y")), standardize=False, missing="impute_zero")
    assert zero.collect()[1]["d"] == 1.0
    with pytest.raises(ValueError):
        nm.dimension_score(df, nm.Dimension("d", ("nope",)))
    with pytest.raises(ValueError):
        nm.dimension_score(df, dim, missing="guess")


@pytest.fixture
def pupils(spark):
    rows = [
        (1, -1.0, 2.0, None, 1.0, 1.0),
        (2, 0.5, None, 3.0, 1.0, 2.0),
        (3, 1.5, 4.0, 5.0, 1.0, 5.0),
        (4, None, 1.0, 2.0, 1.0, 3.0),
        (5, 0.0, 3.0, 4.0, 1.0, 4.0),
    ]
    return spark.createDataFrame(rows, "id int, home double, net double, anx double, flat double, place double")


SPEC = nm.IndexSpec(
    (
        nm.Dimension("d1", ("home", "flat"), reverse=True),
        nm.Dimension("d2", ("net",), reverse=True),
        nm.Dimension("d3", ("anx",)),
        nm.Dimension("d4", ("place",), reverse=True),
    )
)


def test_composite_index(pupils):
    out = nm.composite_index(pupils, SPEC)
    values = [r["index"] for r in out.collect()]
    assert None not in values and min(values) == 0.0 and max(values) == pytest.approx(100.0)
    assert out.drop("d1", "d2", "d3", "d4", "index").collect() == pupils.collect()
    zero = nm.composite_index(pupils, nm.IndexSpec(SPEC.dimensions, missing="impute_zero"))
    assert [r["index"] for r in zero.collect()] == pytest.approx(values)
    assert nm.composite_index(pupils, nm.IndexSpec(SPEC.dimensions, missing="drop")).count() == 2
    keep = [r["index"] for r in nm.composite_index(pupils, nm.IndexSpec(SPEC.dimensions, missing="keep")).collect()]
    assert keep.count(None) == 3
    with pytest.raises(ValueError, match="absent"):
        nm.composite_index(pupils, nm.IndexSpec((nm.Dimension("d", ("absent",)),)))
    with pytest.raises(ValueError):
        nm.IndexSpec(SPEC.dimensions, missing="whatever")


def test_constant_index_is_fifty(pupils):
    spec = nm.IndexSpec((nm.Dimension("d", ("flat",), 1.0),))
    assert {r["index"] for r in nm.composite_index(pupils, spec).collect()} == {50.0}


def test_composite_score(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 3.0, 2.0), (3.0, 2.0, None)], "a double, b double, c double")
    two = [r["composite"] for r in nm.composite_score(df, ["a", "b", "gone"], negate=["b"]).collect()]
    assert two == pytest.approx([0.0, -0.5, 0.5])
    assert nm.composite_score(df, ["a", "c"]).collect()[2]["composite"] is None
    assert nm.composite_score(df, ["a", "b"], standardize=False).first()["composite"] == 1.0
    assert nm.composite_score(df, ["a", "c"]).columns == ["a", "b", "c", "composite"]
    with pytest.raises(ValueError):
        nm.composite_score(df, ["gone"])


def test_minmax_cells(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,), (None,)], "v double")
    assert [r["scaled"] for r in nm.minmax_cells(df, "v").collect()] == [0.0, 0.5, 1.0, None]
    assert [r["scaled"] for r in nm.minmax_cells(df.where("v = 3"), "v").collect()] == [0.0]


def test_demean(spark):
    df = spark.createDataFrame(
        [("A", 100.0, 1.0), ("A", 200.0, 1.0), ("A", 300.0, 2.0), ("B", 400.0, 1.0), ("B", 600.0, 3.0), (None, 5.0, 1.0)],
        "g string, v double, w double",
    )
    plain = sorted((str(r["g"]), r["v_within"]) for r in gr.demean(df, ["v"], "g").collect())
    assert plain == [("A", -100.0), ("A", 0.0), ("A", 100.0), ("B", -100.0), ("B", 100.0), ("None", 0.0)]
    heavy = gr.demean(df, ["v"], "g", weight="w").groupBy("g").agg(F.sum(F.col("v_within") * F.col("w")).alias("s"))
    assert [r["s"] for r in heavy.collect()] == pytest.approx([0.0, 0.0, 0.0])
