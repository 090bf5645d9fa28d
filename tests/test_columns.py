import math

import pytest
from pyspark.sql import functions as F

from surveyloom.functions import columns as c
from surveyloom.functions.tails import chi2_tail, student_t_two_sided
from surveyloom.operators import prep


@pytest.mark.parametrize(
    "score,want",
    [(-5.0, "low"), (481.9, "low"), (482.0, "middle"), (606.0, "middle"), (606.9, "middle"), (607.0, "high"), (750.0, "high")],
)
def test_score_band_edges(spark, score, want):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(c.score_band("s")).first()[0] == want


def test_missing_scores_have_no_band_unless_asked(spark):
    df = spark.createDataFrame([(None,), (math.nan,)], "s double")
    assert [r[0] for r in df.select(c.score_band("s")).collect()] == [None, None]
    assert [r[0] for r in df.select(c.score_band("s", invalid="top")).collect()] == ["high", "high"]


def test_band_arguments_are_checked():
    with pytest.raises(ValueError):
        c.band("x", (1.0, 2.0), ("a", "b"))
    with pytest.raises(ValueError):
        c.band("x", (1.0,), ("a", "b"), invalid="bottom")


def test_index_levels_and_custom_cuts(spark):
    df = spark.createDataFrame([(0.0,), (33.33,), (66.66,), (66.67,), (100.0,)], "i double")
    assert [r[0] for r in df.select(c.index_level("i")).collect()] == ["low", "medium", "medium", "high", "high"]
    assert [r[0] for r in df.select(c.index_level("i", (10.0, 70.0))).collect()] == ["low", "medium", "medium", "medium", "high"]


def test_recode_reflect_labels(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (9.0,), (None,)], "x double")
    assert [r[0] for r in df.select(c.recode_missing("x", [9.0])).collect()] == [1.0, 4.0, None, None]
    assert [r[0] for r in df.select(c.reflect("x", 4.0)).collect()][:2] == [4.0, 1.0]
    assert [r[0] for r in df.select(c.map_labels("x", {1.0: "a", 4.0: "b"})).collect()] == ["a", "b", None, None]
    assert [r[0] for r in df.select(c.position_of("x", [4.0, 1.0])).collect()] == [2, 1, None, None]


def test_row_arithmetic(spark):
    df = spark.createDataFrame([(2.0, 3.0), (-1.0, 4.0), (0.0, 5.0), (1.0, None)], "x double, y double")
    assert [r[0] for r in df.select(c.product("x", "y")).collect()] == [6.0, -4.0, 0.0, None]
    assert [r[0] for r in df.select(c.row_mean(["x", "y"])).collect()] == [2.5, 1.5, 2.5, None]
    assert [r[0] for r in df.select(c.percent("y", "x")).collect()] == [150.0, -400.0, 0.0, None]
    assert df.select(c.linear_combination({"x": 0.5, "y": 0.25})).first()[0] == 1.75


def test_weighted_mean_ignores_weights_of_missing_values(spark):
    df = spark.createDataFrame([(10.0, 1.0), (20.0, 3.0), (None, 100.0)], "x double, w double")
    assert df.agg(c.weighted_mean("x", "w")).first()[0] == 17.5


def test_reverse_item_uses_the_maximum_and_rejects_empty_columns(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (None,)], "x double")
    assert [r["x_reversed"] for r in prep.reverse_item(df, "x").collect()] == [4.0, 1.0, None]
    with pytest.raises(ValueError):
        prep.reverse_item(df.where("x > 10"), "x")


def test_dummies_drop_the_smallest_level(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "g string")
    out = prep.add_dummies(df, "g")
    assert out.columns == ["g", "g_b", "g_c"]
    assert [tuple(r) for r in out.collect()] == [("b", 1.0, 0.0), ("a", 0.0, 0.0), ("c", 0.0, 1.0), (None, None, None)]
    with pytest.raises(ValueError):
        prep.category_levels(df, "g", limit=2)


def test_imputation_strategies(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None), (None, 4.0)], "x double, y double")
    assert [tuple(r) for r in prep.impute(df, ["x", "y"], "mean").collect()] == [(1.0, 2.0), (3.0, 3.0), (2.0, 4.0)]
    assert [tuple(r) for r in prep.impute(df, ["x"], "zero").collect()][2] == (0.0, 4.0)
    assert prep.impute(df, ["x", "y"], "drop").count() == 1
    assert prep.impute(df, ["x", "y"], "keep").count() == 3
    assert prep.impute(df, ["x"], "mean", suffix="_f").columns == ["x", "y", "x_f"]
    with pytest.raises(ValueError):
        prep.impute(df, ["x"], "median")


def test_codebook_recode_and_labels(spark):
    df = spark.createDataFrame([(1, 7), (99, 8)], "a int, b int")
    book = spark.createDataFrame(
        [("a", 99, True, "No answer"), ("a", 1, False, "Yes"), ("b", 8, False, "Eight")],
        "column string, code int, is_missing boolean, label string",
    )
    assert [r["a"] for r in prep.recode_from_codebook(df, book, ["a", "b"]).collect()] == [1, None]
    assert sorted(r["t"] for r in prep.decode_labels(df, book, "a", "t").collect()) == ["No answer", "Yes"]


@pytest.mark.parametrize("x,dof,p", [(3.841458821, 1, 0.05), (9.487729037, 4, 0.05), (5.0, 4, 0.2872974952), (100.0, 7, 9.86e-19)])
def test_chi2_tail(x, dof, p):
    assert chi2_tail(x, dof) == pytest.approx(p, rel=1e-3 if p < 1e-9 else 1e-7)


@pytest.mark.parametrize("t,dof,p", [(2.228138852, 10, 0.05), (-2.0, 10, 0.07338803477), (12.70620474, 1, 0.05), (1.959963985, 1e9, 0.05)])
def test_student_t(t, dof, p):
    assert student_t_two_sided(t, dof) == pytest.approx(p, rel=1e-6)
    assert student_t_two_sided(0.0, dof) == 1.0


def test_interaction_default_name(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    assert prep.add_interaction(df, "a", "b").first()["a_x_b"] == 6.0
    with pytest.raises(ValueError):
        prep.add_interaction(df, "a", "z")


def test_strata_are_half_open(spark):
    df = spark.range(5).select(F.col("id").cast("double").alias("x"))
    rows = prep.add_strata(df, "x", [1.0, 3.0], ["l", "m", "h"]).orderBy("x").collect()
    assert [r["stratum"] for r in rows] == ["l", "m", "m", "h", "h"]
    with pytest.raises(ValueError):
        prep.add_strata(df, "x", [None, 3.0], ["l", "m", "h"])


def test_dummy_vector(spark):
    values = [30, 4, None, 100, 4, 7]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, g int").repartition(3)
    got = {r["i"]: r["d"] for r in prep.add_dummy_vector(df, "g", "d").collect()}
    want = {7: [1, 0, 0], 30: [0, 1, 0], 100: [0, 0, 1], 4: [0, 0, 0]}
    assert {i: None if d is None else list(d.toArray()) for i, d in got.items()} == {i: want.get(v) for i, v in enumerate(values)}
    places = {r["level"]: r["place"] for r in prep.level_positions(spark.range(5000).repartition(7), "id").collect()}
    assert places == {i: i for i in range(5000)}
    one = prep.add_dummy_vector(df.where("g = 4"), "g", "d").first()["d"]
    assert one.size == 0
    assert [r["d"] for r in prep.add_dummy_vector(df.where("g IS NULL"), "g", "d").collect()] == [None]
    assert prep.add_dummy_vector(df.limit(0), "g", "d").count() == 0
