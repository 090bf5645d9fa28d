import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import profile as pf
from surveyloom.operators import quantiles as qt


def test_column_statistics(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    r = pf.column_statistics(df, "x").first()
    assert (r["count"], r["mean"], r["stddev"], r["min"], r["max"]) == (3, 2.0, 1.0, 1.0, 3.0)
    assert (r["null_count"], r["total_rows"], r["null_percentage"]) == (1, 4, 25.0)
    assert pf.column_mean(df, "x").first()["mean"] == 2.0
    assert pf.column_mean(df.where("x > 9"), "x").first()["mean"] is None
    assert pf.column_statistics(df.where("x > 9"), "x").first()["null_percentage"] == 0.0
    with pytest.raises(ValueError):
        pf.column_mean(df, "y")


def test_describe_covers_all_numeric_types(spark):
    df = spark.createDataFrame([(1, 2, 3.0, "s")], "a byte, b long, c double, d string")
    rows = pf.describe_numeric(df).collect()
    assert [r["column"] for r in rows] == ["a", "b", "c"] and rows[0]["total_columns"] == 4
    with pytest.raises(ValueError):
        pf.describe_numeric(df.select("d"))


def test_missing_report(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (float("nan"), None), (2.0, "c")], "x double, s string")
    plain = {r["column"]: r for r in pf.missing_report(df).collect()}
    assert (plain["x"]["missing_count"], plain["s"]["missing_count"], plain["s"]["missing_rate"]) == (1, 1, 25.0)
    nan = pf.missing_report(df, ["x"], {"x": "Ex"}, nan=True, decimals=1).first()
    assert (nan["variable"], nan["valid_count"], nan["missing_rate"]) == ("Ex", 2, 50.0)


def test_sample_loss(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, 2.0), (None, 1.0, 3.0), (1.0, None, 5.0), (1.0, 1.0, 10.0)], "a double, b double, w double"
    )
    loss = {r["measure"]: r for r in pf.sample_loss(df, ["a", "b"], "w").collect()}
    assert (loss["unweighted"]["removed"], loss["unweighted"]["loss_rate"]) == (2.0, 50.0)
    assert (loss["weighted"]["before"], loss["weighted"]["after"], loss["weighted"]["loss_rate"]) == (20.0, 12.0, 40.0)


@pytest.fixture(scope="module")
def tied(spark):
    rng = np.random.default_rng(0)
    x = np.where(rng.random(3000) < 0.35, 4.0, rng.integers(0, 200, 3000))
    y = np.round(0.5 * x + rng.normal(0, 20, 3000))
    pdf = pd.DataFrame({"x": x.astype(float), "y": y})
    pdf.loc[::50, "y"] = None
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "x double, y double")


def test_spearman_with_ties_and_nulls(tied):
    pdf, df = tied
    got = pf.correlation(df, "x", "y", "spearman").first()["correlation"]
    both = pdf.dropna()
    want = both["x"].rank().corr(both["y"].rank())
    assert got == pytest.approx(want, abs=1e-12)
    with pytest.raises(ValueError):
        pf.correlation(df, "x", "y", "kendall")


def test_ranks_do_not_depend_on_the_buckets(tied):
    pdf, df = tied
    want = pdf["x"].rank().groupby(pdf["x"]).first().to_dict()
    for size in (7, 50, 10_000):
        got = {r["value"]: r["avg_rank"] for r in pf.average_ranks(df, "x", size).collect()}
        assert got == want


def test_correlation_matrix(tied):
    _, df = tied
    m = {(r["x"], r["y"]): r["correlation"] for r in pf.correlation_matrix(df, ["x", "y"]).collect()}
    assert len(m) == 4 and m["x", "y"] == m["y", "x"] == pytest.approx(
        pf.correlation(df, "x", "y").first()["correlation"]
    )


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    parts = [np.full(4000, 3.25), rng.lognormal(0, 3, 5000), [1e12, -1e12, 0.0, 1e-300]]
    values = np.concatenate(parts)
    rng.shuffle(values)
    groups = np.array(["a", "b", None], object)[rng.choice(3, len(values), p=[0.7, 0.2, 0.1])]
    pdf = pd.DataFrame({"g": groups, "v": values})
    return pdf, spark.createDataFrame(pdf, "g string, v double").union(
        spark.createDataFrame([("a", None), ("b", math.nan), ("empty", None)], "g string, v double")
    )


PROBS = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.67, 0.99, 1.0]


@pytest.mark.parametrize("slices,small", [(16, 20), (2048, 10_000)])
def test_exact_percentiles_per_group(skewed, monkeypatch, slices, small):
    pdf, df = skewed
    monkeypatch.setattr(qt, "SLICES", slices)
    monkeypatch.setattr(qt, "SMALL_BRACKET", small)
    names = [f"p{i}" for i in range(len(PROBS))]
    rows = {r["g"]: r for r in qt.quantiles(df, "v", PROBS, "g", "exact", names=names).collect()}
    assert set(rows) == {"a", "b", None}
    for g, part in pdf.groupby("g", dropna=False):
        key = None if g is None or g != g else g
        want = np.quantile(part["v"], PROBS)
        assert [rows[key][n] for n in names] == pytest.approx(list(want), rel=1e-12)


def test_exact_percentiles_of_the_table(skewed):
    pdf, df = skewed
    got = qt.quantile_values(df, "v", PROBS, method="exact", kind="discrete", names=list("abcdefgh"))
    assert got == list(np.quantile(pdf["v"], PROBS, method="inverted_cdf"))
    assert qt.quantile_values(df.where("v > 1e300"), "v", [0.5], method="exact") == [None]


def test_approximate_percentiles_are_close(spark):
    df = spark.range(10_001).select(F.col("id").cast("double").alias("x"))
    assert qt.quantile_values(df, "x", [0.25, 0.5, 2 / 3]) == pytest.approx([2500, 5000, 6667], abs=2)
    assert qt.percentile_names([1 / 3, 2 / 3, 0.05]) == ["q33", "q67", "q05"]
    for bad in ({"method": "guess"}, {"method": "exact", "kind": "odd"}):
        with pytest.raises(ValueError):
            qt.quantiles(df, "x", [0.5], **bad)
