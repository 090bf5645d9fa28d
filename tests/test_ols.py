import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import models as md
from surveyloom.operators import ols
from surveyloom.operators.prep import add_dummies


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 4000
    g = np.array(["a", "b", "c", "d"])[rng.choice(4, n, p=[0.6, 0.2, 0.15, 0.05])]
    shift = pd.Series(g).map({"a": 0.0, "b": 5.0, "c": -3.0, "d": 9.0}).to_numpy()
    x1, x2 = rng.normal(50, 10, n) + shift, rng.normal(0, 1, n)
    w = rng.uniform(0.5, 3, n)
    y = 400 - 2.0 * x1 + 7.0 * x2 + 4 * shift + rng.normal(0, 5, n)
    pdf = pd.DataFrame({"g": g, "x1": x1, "x2": x2, "w": w, "y": y})
    return pdf, spark.createDataFrame(pdf).repartition(4).cache()


def reference(x, y, w):
    design = np.column_stack([x, np.ones(len(y))])
    root = np.sqrt(w)
    beta = np.linalg.lstsq(design * root[:, None], y * root, rcond=None)[0]
    sse = (w * (y - design @ beta) ** 2).sum()
    sst = (w * (y - np.average(y, weights=w)) ** 2).sum()
    return beta, 1 - sse / sst, np.sqrt(sse / w.sum())


def terms(fits, part="estimate"):
    return {t["term"]: t[part] for t in fits.first()["terms"]}


def test_weighted_fit_matches_least_squares(data):
    pdf, df = data
    fit = ols.fit_ols(df, "y", ["x1", "x2"], "w")
    beta, r2, rmse = reference(pdf[["x1", "x2"]].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())
    row = fit.first()
    assert list(terms(fit).values()) == pytest.approx(list(beta), rel=1e-8)
    assert (row["r2"], row["rmse"], row["n"], row["status"]) == (pytest.approx(r2), pytest.approx(rmse), 4000, "ok")
    assert row["adjusted_r2"] == pytest.approx(1 - (1 - r2) * 3999 / 3997)


def test_errors_match_mllib(data):
    _, df = data
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    ours = ols.fit_ols(df, "y", ["x1", "x2"], "w")
    frame = VectorAssembler(inputCols=["x1", "x2"], outputCol="x").transform(df.dropna())
    lr = LinearRegression(featuresCol="x", labelCol="y", weightCol="w", solver="normal").fit(frame)
    s = lr.summary
    for part, theirs in {
        "estimate": [*lr.coefficients, lr.intercept],
        "std_error": s.coefficientStandardErrors,
        "t_value": s.tValues,
        "p_value": s.pValues,
    }.items():
        assert list(terms(ours, part).values()) == pytest.approx(list(theirs), rel=1e-6, abs=1e-12)
    assert ours.first()["rmse"] == pytest.approx(s.rootMeanSquaredError, rel=1e-8)


def test_absorbed_groups_equal_dummies(data):
    _, df = data
    absorbed = ols.fit_ols(df, "y", ["x1", "x2"], "w", absorb="g")
    dummies = ols.fit_ols(add_dummies(df, "g"), "y", ["x1", "x2", "g_b", "g_c", "g_d"], "w")
    for part in ("estimate", "std_error"):
        a, d = terms(absorbed, part), terms(dummies, part)
        assert [a["x1"], a["x2"]] == pytest.approx([d["x1"], d["x2"]], rel=1e-7)
    for c in ("r2", "adjusted_r2", "rmse"):
        assert absorbed.first()[c] == pytest.approx(dummies.first()[c], rel=1e-8)
    assert absorbed.first()["groups"] == 4
    assert ols.fit_ols(df, "y", ["x1"], "w", absorb="g", min_rows=500).first()["groups"] == 3


def test_strata_equal_separate_fits(data):
    _, df = data
    together = {r["g"]: r for r in ols.fit_ols(df, "y", ["x1"], "w", by="g").collect()}
    for g in "abcd":
        alone = ols.fit_ols(df.where(F.col("g") == g), "y", ["x1"], "w").first()
        assert together[g]["terms"][0]["estimate"] == pytest.approx(alone["terms"][0]["estimate"])
        assert together[g]["n"] == alone["n"]


def test_unusable_strata_report_a_reason(spark):
    rows = [("few", 1.0, 2.0, 3.0)] + [("same", 1.0, float(i), float(i % 3)) for i in range(9)]
    rows += [("twin", float(i), 2.0 * i, float(i % 4)) for i in range(9)]
    rows += [("flat", float(i), float(i * i), 5.0) for i in range(9)] + [(None, 1.0, 1.0, 1.0), ("few", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "s string, a double, b double, y double")
    fits = {r["s"]: r for r in ols.fit_ols(df, "y", ["a", "b"], by="s").collect()}
    assert set(fits) == {"few", "same", "twin", "flat"}
    assert fits["few"]["status"] == "too few rows" and fits["few"]["n"] == 1
    assert fits["twin"]["status"] == "collinear predictors"
    assert fits["same"]["status"] == "no usable variation: a"
    assert fits["same"]["terms"][0]["estimate"] is None and fits["same"]["terms"][1]["estimate"] is not None
    assert fits["flat"]["r2"] is None and fits["flat"]["terms"][0]["estimate"] == pytest.approx(0.0)


@pytest.mark.parametrize("mean", [1e4, 1e5, 1e7, 1e9])
def test_large_offsets_are_centred(spark, mean):
    rng = np.random.default_rng(2)
    x = mean + rng.normal(0, 1, 500)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "z": rng.normal(0, 1, 500), "y": 3.0 * (x - mean) + 1.0, "g": "a", "h": x * 0 + mean}))
    fit = ols.fit_ols(df, "y", ["x", "z"])
    assert fit.first()["status"] == "ok" and fit.first()["r2"] == pytest.approx(1.0)
    assert terms(fit)["x"] == pytest.approx(3.0, rel=1e-6)
    assert terms(ols.fit_ols(df, "y", ["x"], absorb="g"))["x"] == pytest.approx(3.0, rel=1e-6)
    assert ols.fit_ols(df, "y", ["x", "h"]).first()["status"] == "no usable variation: h"


@pytest.mark.parametrize("mean", [0.0, 1e4, 5e4, 1e7])
def test_exact_collinearity_is_told(spark, mean):
    rng = np.random.default_rng(4)
    x = mean + rng.normal(0, 0.3, 800)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "x2": 2 * x + 3, "y": rng.normal(0, 1, 800), "g": rng.choice(list("ab"), 800)}))
    assert ols.fit_ols(df, "y", ["x", "x2"]).first()["status"] == "collinear predictors"
    assert {r["status"] for r in ols.fit_ols(df, "y", ["x", "x2"], by="g").collect()} == {"collinear predictors"}


def test_small_spread_beside_a_large_mean_is_used(spark):
    rng = np.random.default_rng(6)
    x = 1e6 + rng.uniform(0, 0.1, 900)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": 3.0 * (x - 1e6) + rng.normal(0, 0.001, 900)}))
    fit = ols.fit_ols(df, "y", ["x"]).first()
    assert fit["status"] == "ok" and fit["r2"] > 0.99 and fit["terms"][0]["estimate"] == pytest.approx(3.0, rel=1e-2)


def test_any_number_of_predictors_from_one_entry(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (400, 45))
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(45)])
    pdf["y"] = x @ np.arange(45) + 2.0
    fit = terms(ols.fit_ols(spark.createDataFrame(pdf), "y", [f"x{i}" for i in range(45)]))
    assert [fit[f"x{i}"] for i in range(45)] == pytest.approx(list(range(45)), abs=1e-6)


def test_comparison_and_residuals(data):
    _, df = data
    df = df.withColumnRenamed("x1", "index")
    fits = [
        md.baseline_model(df, "y", "index", "w"),
        md.control_model(df, "y", "index", "x2", "w"),
        md.fixed_effects_model(df, "y", "index", "x2", "g", "w"),
    ]
    table = {r["model"]: r for r in md.compare_models(fits, "index").collect()}
    assert [m for m, r in table.items() if r["is_best"]] == [md.FIXED]
    assert table[md.FIXED]["coefficient"] == pytest.approx(-2.0, abs=0.05)
    for fit, xs, absorb in ((fits[1], ["index", "x2"], None), (fits[2], ["index", "x2"], "g")):
        res = ols.with_residuals(df, fit.first(), "y", xs, "w", absorb)
        r = res.agg(F.sum(F.col("w") * F.col("residual")), F.sum(F.col("w") * F.col("residual") ** 2) / F.sum("w")).first()
        assert r[0] == pytest.approx(0.0, abs=1e-6) and r[1] ** 0.5 == pytest.approx(fit.first()["rmse"], rel=1e-8)


def test_residuals_of_strata_equal_fits_one_by_one(data):
    _, df = data
    fits = ols.fit_ols(df, "y", ["x1", "x2"], "w", by="g")
    rows = ols.add_residuals(df, fits, "y", ["x1", "x2"], "w", by="g")
    per = {r["g"]: r for r in rows.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("residual") ** 2).alias("sse"), F.sum("w").alias("sw")).collect()}
    want = {r["g"]: r for r in fits.collect() if r["rmse"] is not None}
    assert set(per) == set(want) and len(want) > 1
    for g, r in per.items():
        assert r["n"] == want[g]["n"] and (r["sse"] / r["sw"]) ** 0.5 == pytest.approx(want[g]["rmse"], rel=1e-8)
    bad = fits.withColumn("rmse", F.when(F.col("g") != min(want), F.col("rmse")))
    assert {r["g"] for r in ols.add_residuals(df, bad, "y", ["x1", "x2"], "w", by="g").select("g").distinct().collect()} == set(want) - {min(want)}
    with pytest.raises(ValueError, match="fitted"):
        ols.add_residuals(df.withColumn("fitted", F.lit(1)), fits, "y", ["x1"], by="g")


def test_residuals_of_models_by_table_and_by_row(data):
    _, df = data
    df = df.withColumnRenamed("x1", "index")
    rows = md.model_residuals(df, "y", "index", "x2", "g", "w")
    trends = {r["model"]: r for r in md.residual_trends(rows, "model").collect()}
    fit = md.fixed_effects_model(df, "y", "index", "x2", "g", "w").first()
    designs = {md.CONTROL: (md.control_model(df, "y", "index", "x2", "w").first(), None), md.FIXED: (fit, "g")}
    for name, (row, absorb) in designs.items():
        one = md.residual_trend(ols.with_residuals(df, row, "y", ["index", "x2"], "w", absorb)).first()
        assert all(trends[name][c] == pytest.approx(one[c], rel=1e-6, abs=1e-7) for c in one.asDict() if c != "status")
    assert set(trends) == {md.BASELINE, md.CONTROL, md.FIXED}
    sample = md.residual_samples(rows, "model", [md.BASELINE, md.FIXED], 7)
    got = sorted(map(tuple, sample.collect()))
    assert len(got) == 14 and got == sorted(map(tuple, md.residual_samples(rows.repartition(3), "model", [md.BASELINE, md.FIXED], 7).collect()))
    # groups that are too small take no part in the fixed effects
    small = df.groupBy("g").count().orderBy("count").first()["count"]
    fewer = md.model_residuals(df, "y", "index", "x2", "g", "w", min_rows=small + 1)
    assert fewer.where(F.col("model") == md.FIXED).count() < rows.where(F.col("model") == md.FIXED).count()
    assert md.residual_trends(rows.limit(0), "model").count() == 0


def test_residual_trend_finds_a_cubic(spark):
    t = np.linspace(-2, 2, 501)
    pdf = pd.DataFrame({"fitted": 450 + 30 * t, "residual": 1 + 2 * t - t**2 + 0.5 * t**3})
    r = md.residual_trend(spark.createDataFrame(pdf)).first()
    z = (pdf["fitted"] - pdf["fitted"].mean()) / pdf["fitted"].std()
    want = np.polyfit(z, pdf["residual"], 3)
    got = [r["cubic"], r["quadratic"], r["linear"], r["constant"]]
    assert got == pytest.approx(list(want), rel=1e-6)
    assert r["std_residual"] == pytest.approx(pdf["residual"].std(ddof=0))


def test_importance_ranks_planted_effects(data):
    _, df = data
    df = df.withColumn("noise", F.rand(3)).withColumn("flat", F.lit(1.0))
    rows = md.regression_importance(df, ["x2", "x1", "noise", "flat", "absent"], "y", "w").collect()
    assert [r["feature"] for r in rows][:2] == ["x1", "x2"] and [r["rank"] for r in rows] == [1, 2, 3, 4]
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)
    assert {r["feature"]: r["importance"] for r in rows}["flat"] == 0.0
    assert md.regression_importance(df, ["x1", "x2"], "y", "w", top_n=1).count() == 1
    with pytest.raises(ValueError):
        md.regression_importance(df, ["absent"], "y", "w")


def wide(spark, p, n=1500, **more):
    """p predictors, the first with coefficient 1; ``more`` replaces columns."""
    rng = np.random.default_rng(p)
    pdf = pd.DataFrame(rng.normal(size=(n, p)), columns=[f"x{i}" for i in range(p)])
    pdf["y"] = pdf["x0"] + rng.normal(0, 0.1, n)
    pdf["g"], pdf["w"] = rng.integers(0, 20, n), rng.random(n) + 0.5
    for c, make in more.items():
        pdf[c] = make(pdf)
    return spark.createDataFrame(pdf), [f"x{i}" for i in range(p)]


@pytest.mark.parametrize("p", [26, 27, 40, 41, 300])
def test_constants_and_twins_are_told_at_any_width(spark, p):
    df, xs = wide(spark, p, x5=lambda d: 3.0)
    fit = ols.fit_ols(df, "y", xs, "w").first()
    found = {t["term"]: t["estimate"] for t in fit["terms"]}
    assert fit["status"] == "no usable variation: x5" and found["x5"] is None
    assert found["x0"] == pytest.approx(1.0, abs=0.03) and len(found) == p + 1
    df, xs = wide(spark, p, x5=lambda d: 2 * d["x0"])
    fit = ols.fit_ols(df, "y", xs, "w").first()
    assert fit["status"] == "collinear predictors" and all(t["estimate"] is None for t in fit["terms"])


@pytest.mark.parametrize("options", [{}, {"by": "b"}, {"absorb": "g"}, {"by": "b", "absorb": "g", "min_rows": 20}])
def test_matrices_and_columns_give_the_same_fit(spark, options, monkeypatch):
    df, xs = wide(spark, 6, x1=lambda d: d["x1"] + d["g"] + 1000, b=lambda d: (d["g"] % 3).where(d["g"] > 0))
    df = df.repartition(5)
    narrow = {r.asDict().get("b"): r for r in ols.fit_ols(df, "y", xs, "w", **options).collect()}
    monkeypatch.setattr(ols, "PRODUCTS_AS_COLUMNS", 0)
    monkeypatch.setattr(ols, "HELD_BYTES", 100)
    matrices = {r.asDict().get("b"): r for r in ols.fit_ols(df, "y", xs, "w", **options).collect()}
    assert narrow.keys() == matrices.keys()
    for key, a in narrow.items():
        b = matrices[key]
        assert (a["n"], a["groups"], a["status"]) == (b["n"], b["groups"], b["status"])
        for c in ("sum_weight", "r2", "adjusted_r2", "rmse"):
            assert a[c] == pytest.approx(b[c], rel=1e-9)
        for x, y in zip(a["terms"], b["terms"]):
            assert x["term"] == y["term"]
            for c in ("estimate", "std_error", "t_value", "p_value"):
                assert x[c] == pytest.approx(y[c], rel=1e-6, abs=1e-9)


def test_wide_fit_without_rows(spark):
    df, xs = wide(spark, 40)
    for absorb in (None, "g"):
        row = ols.fit_ols(df.filter("false"), "y", xs, "w", absorb=absorb).first()
        assert (row["n"], row["status"]) == (0, "too few rows")
    assert ols.fit_ols(df.filter("false"), "y", xs, "w", by="g").count() == 0
