import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import models as md
from surveyloom.operators import ols

SPEC = md.InteractionSpec("score", "idx", ("m1", "m2"), "grp", "w", control="ses")


@pytest.fixture(scope="module")
def survey(spark):
    rng = np.random.default_rng(11)
    n = 6000
    g = rng.choice(5, n, p=[0.4, 0.3, 0.15, 0.1, 0.05])
    idx, ses = rng.normal(50, 10, n) + 3 * g, rng.normal(0, 1, n)
    m1, m2 = rng.normal(0, 1, n), rng.normal(5, 2, n)
    att = ((m1 - m1.mean()) / m1.std(ddof=1) + (m2 - m2.mean()) / m2.std(ddof=1)) / 2
    dev = lambda v: v - pd.Series(v).groupby(g).transform("mean").to_numpy()
    score = 20 * g + 400 - 1.5 * dev(idx) + 12 * dev(att) + 0.8 * dev(idx) * dev(att) + 6 * dev(ses)
    pdf = pd.DataFrame({"score": score + rng.normal(0, 1, n), "idx": idx, "ses": ses, "m1": m1, "m2": m2, "w": rng.uniform(1, 2, n)})
    pdf["grp"] = [f"g{i}" for i in g]
    return pdf, spark.createDataFrame(pdf).cache()


def test_within_model_recovers_the_planted_effects(survey):
    _, df = survey
    fit = md.interaction_model(df, SPEC).first()
    got = {t["term"]: t["estimate"] for t in fit["terms"]}
    assert [got["idx"], got["attitude"], got["idx_x_attitude"], got["ses"]] == pytest.approx([-1.5, 12, 0.8, 6], abs=0.06)
    assert fit["n"] == 6000 and fit["model"] == "Within-Group Interaction"
    assert md.read_interaction(md.interaction_model(df, SPEC), SPEC.term).first()["reading"] == "compensatory"


def test_pooled_model_and_absent_control(survey):
    _, df = survey
    fit = md.interaction_model(df.drop("ses"), SPEC, within=False).first()
    assert [t["term"] for t in fit["terms"]] == ["idx", "attitude", "idx_x_attitude", "intercept"]
    with pytest.raises(ValueError):
        md.interaction_model(df.drop("idx"), SPEC)


def test_marginal_effects_are_linear_in_the_level(survey):
    _, df = survey
    rows = md.marginal_effects(df, SPEC, method="exact").collect()
    assert [r["level"] for r in rows] == ["low", "medium", "high"]
    slope = (rows[2]["attitude_effect"] - rows[0]["attitude_effect"]) / (rows[2]["index_value"] - rows[0]["index_value"])
    assert slope == pytest.approx(0.8, abs=0.05)
    near = md.marginal_effects(df, SPEC).collect()
    assert [r["index_value"] for r in near] == pytest.approx([r["index_value"] for r in rows], abs=0.05)


@pytest.mark.parametrize("kind", ["index", "attitude"])
def test_strata_equal_fits_on_filtered_rows(survey, kind):
    pdf, df = survey
    fits = md.stratified_models(df, SPEC, kind, method="exact")
    table = {r["stratum"]: r for r in md.strata_table(fits, SPEC).collect()}
    assert sum(r["n"] for r in table.values()) == 6000 and len(table) == 3
    if kind == "index":
        lo, hi = np.quantile(pdf["idx"], [0.33, 0.67])
        part = df.where((F.col("idx") >= float(lo)) & (F.col("idx") < float(hi)))
        alone = {t["term"]: t["estimate"] for t in md.interaction_model(part, SPEC).first()["terms"]}
        assert table["medium_index"]["index_coef"] == pytest.approx(alone["idx"], rel=1e-6)
        assert table["medium_index"]["interaction_coef"] == pytest.approx(alone["idx_x_attitude"], rel=1e-6)


def test_group_strata_and_global_standardization(survey):
    _, df = survey
    fits = md.stratified_models(df, SPEC, "group", top_n=2)
    assert sorted(r["stratum"] for r in fits.collect()) == ["g0", "g1"]
    other = md.stratified_models(df, SPEC, "index", restandardize=False)
    assert other.count() == 3
    with pytest.raises(ValueError):
        md.stratified_models(df, SPEC, "region")


def test_heterogeneity(spark):
    def fits(effects):
        rows = [(s, "m", [("attitude", b, 0.5, 0.0, 0.0)]) for s, b in effects]
        terms = "array<struct<term string, estimate double, std_error double, t_value double, p_value double>>"
        return spark.createDataFrame(rows, f"stratum string, model string, terms {terms}")

    same = md.heterogeneity(fits([("a", 1.0), ("b", 1.1), ("c", 0.9)]), "attitude").first()
    apart = md.heterogeneity(fits([("a", 1.0), ("b", 9.0), ("c", -5.0)]), "attitude").first()
    assert not same["is_heterogeneous"] and apart["is_heterogeneous"]
    assert same["variance"] == pytest.approx(0.01) and apart["effects"] == {"a": 1.0, "b": 9.0, "c": -5.0}


@pytest.mark.parametrize("groups", [2, 3, 4])
def test_grid(survey, groups):
    _, df = survey
    grid = md.grid_frame(df, SPEC, groups, groups, method="exact")
    cells = md.grid_cells(grid).collect()
    assert len(cells) == groups**2 and sum(c["n"] for c in cells) == 6000
    slopes = md.simple_slopes(grid, SPEC).collect()
    assert len(slopes) == groups and all(s["n"] == pytest.approx(6000 / groups, abs=2) for s in slopes)
    assert md.simple_slopes(grid, SPEC, min_rows=6000).count() == 0
    if groups == 3:
        by = {s["index_group"]: s["slope"] for s in slopes}
        assert by["Low Index"] < by["Medium Index"] < by["High Index"]


def test_small_three_group_table(spark):
    rows = []
    for k, g in enumerate("ABC"):
        for i in range(5):
            rows.append((400.0 + 10 * k + 7 * i + i * i, 20.0 + 5 * i + k, 1.0 + (i * 3 + k) % 4, 2.0 + (i * i + k) % 5, g, 50.0 + 10 * i))
    df = spark.createDataFrame(rows, "score double, idx double, m1 double, m2 double, grp string, w double")
    fit = md.interaction_model(df, SPEC).first()
    assert fit["n"] == 15 and fit["status"] == "ok"
    assert ols.coefficients(md.interaction_model(df, SPEC)).count() == 4
