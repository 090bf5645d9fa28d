import pytest
from pyspark.sql import functions as F

from surveyloom.operators import grouped as gr
from surveyloom.operators import tables as tb
from surveyloom.operators.prep import add_score_band


@pytest.fixture
def scores(spark):
    rows = [(350.0, 1.0), (450.5, 1.2), (482.0, 0.9), (500.0, 1.1), (606.0, 1.0), (607.0, 1.3), (620.0, 1.0), (750.0, 0.9)]
    return add_score_band(spark.createDataFrame(rows, "s double, w double"), "s")


def test_band_statistics(scores):
    rows = {r["band"]: r for r in gr.band_statistics(scores, "s", "w", "band").collect()}
    assert {b: r["sample_count"] for b, r in rows.items()} == {"low": 2, "middle": 3, "high": 3}
    assert sum(r["population_percentage"] for r in rows.values()) == pytest.approx(100.0)
    assert rows["low"]["weighted_mean_score"] == pytest.approx((350 + 450.5 * 1.2) / 2.2)
    assert (rows["high"]["min_score"], rows["high"]["max_score"]) == (607.0, 750.0)


def test_band_statistics_with_missing_scores_and_nothing(spark, scores):
    more = add_score_band(spark.createDataFrame([(None, 7.0)], "s double, w double"), "s")
    rows = {r["band"]: r for r in gr.band_statistics(scores.union(more), "s", "w", "band").collect()}
    assert (rows[None]["n_rows"], rows[None]["sample_count"], rows[None]["weighted_mean_score"]) == (1, 0, None)
    assert gr.band_statistics(scores.where("s > 1000"), "s", "w", "band").count() == 0


def test_band_table_is_in_display_order(scores):
    rows = tb.band_table(gr.band_statistics(scores, "s", "w", "band")).collect()
    assert [r["display_name"] for r in rows] == ["Low (< 482)", "Middle (482-606)", "High (≥ 607)"]


def test_index_by_group(scores):
    exact = {r["band"]: r for r in gr.index_by_group(scores, "s", "w", "band", ["w"], "exact").collect()}
    approx = {r["band"]: r for r in gr.index_by_group(scores, "s", "w", "band", ["w"]).collect()}
    assert exact["middle"]["median"] == approx["middle"]["median"] == 500.0
    assert exact["low"]["q25"] == pytest.approx(375.125)
    assert exact["low"].asDict().keys() == approx["low"].asDict().keys()
    means = {(r["band"], r["dimension"]): r["mean_value"] for r in gr.dimension_means(scores, ["w", "s"], "band").collect()}
    assert means["low", "w"] == pytest.approx(1.1) and len(means) == 6


def test_share_above(scores):
    rows = {r["band"]: r["share_above"] for r in gr.share_above(scores, "s", "band", 0.75, "exact").collect()}
    assert rows["low"] == 0.0 and rows["high"] == pytest.approx(2 / 3)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (4.9,), (5.0,), (100.0,), (-1.0,), (101.0,), (None,)], "x double")
    rows = {r["bin"]: r["n"] for r in gr.histogram(df, "x", 0.0, 100.0, 20).collect()}
    assert rows == {0: 1, 1: 2, 2: 1, 20: 1, 21: 1}


def test_cells_profiles_outcomes(scores):
    cells = gr.cell_means(scores, "band", "w", "s", "w")
    assert cells.agg(F.sum("n")).first()[0] == 8
    assert gr.cluster_profile(scores, "band", ["s"], "w").where("band = 'low'").first()["mean_s"] == 400.25
    assert gr.outcomes(scores, "band", "s", "w").where("band = 'low'").first()["std_score"] == pytest.approx(71.0642)
    matrix = tb.cell_matrix(gr.group_sizes(scores, ["band", "w"]).withColumn("k", F.lit("x")), "band", "k", "n", ["x", "y"])
    assert {r["y"] for r in matrix.collect()} == {None} or {r["y"] for r in matrix.collect()} == {0}


def test_top_groups_break_ties_by_key(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), ("a",), ("c",), (None,), (None,), (None,)], "g string")
    assert [tuple(r) for r in gr.top_groups(df, "g", 2).collect()] == [("a", 2), ("b", 2)]


def test_sample_is_the_same_on_any_layout(spark):
    df = spark.range(1000)
    one = gr.repeatable_sample(df, ["id"], 50).collect()
    assert one == gr.repeatable_sample(df.repartition(7), ["id"], 50).collect() and len(one) == 50
    assert one != gr.repeatable_sample(df, ["id"], 50, seed=1).collect()
    whole = df.orderBy(F.xxhash64(F.lit(42), F.col("id")).bitwiseAND(F.lit(2**63 - 1)), "id").limit(50).collect()
    assert one == whole
    assert gr.repeatable_sample(df, ["id"], 5000).count() == 1000
    copies = spark.range(300).select((F.col("id") % 2).alias("id"))
    assert gr.repeatable_sample(copies, ["id"], 160).count() == 160


def test_share_comparison_and_lines(spark):
    stats = spark.createDataFrame([("a", 1, 3.0), ("b", 3, 1.0)], "s string, sample_count long, weighted_count double")
    rows = {r["s"]: r for r in tb.share_comparison(stats, "s").collect()}
    assert (rows["a"]["sample_percentage"], rows["a"]["population_percentage"]) == (25.0, 75.0)
    lines = tb.fitted_lines(spark.createDataFrame([("g", 1.0, 2.0)], "g string, intercept double, slope double"), "g")
    points = [(r["x"], r["y"]) for r in lines.orderBy("step").collect()]
    assert len(points) == 100 and points[0] == (-2.0, -3.0) and points[-1] == pytest.approx((2.0, 5.0))
