import os

import numpy as np
import pandas as pd
import pytest

from surveyloom.operators import models as md
from surveyloom.plans import analyses as an
from surveyloom.plans import presets as pr
from surveyloom.sources.ingest import Source


@pytest.fixture(scope="module")
def survey(spark):
    rng = np.random.default_rng(4)
    n, sites = 900, 30
    pupils = pd.DataFrame({c: rng.normal(0, 1, n) for c in pr.STUDENT_COLUMNS})
    pupils[pr.SITE_KEY] = rng.integers(0, sites, n)
    pupils[pr.GROUP] = [f"C{k % 3}" for k in pupils[pr.SITE_KEY]]
    pupils[pr.WEIGHT] = rng.uniform(0.5, 2, n)
    pupils[pr.REVERSED_ITEM] = rng.integers(1, 5, n).astype(float)
    pupils[pr.SCORE] = 540 + 60 * pupils["MATHEFF"] + 30 * pupils["HOMEPOS"] + rng.normal(0, 20, n)
    schools = pd.DataFrame({c: rng.integers(1, 6, sites).astype(float) for c in pr.SCHOOL_COLUMNS})
    schools[pr.SITE_KEY] = range(sites)
    pupils = pupils.astype(object)
    pupils.loc[::40, "ICTRES"] = None
    pupils.loc[::50, "MATHMOT"] = None
    schema = ", ".join(
        f"{c} {'int' if c == pr.SITE_KEY else 'string' if c == pr.GROUP else 'double'}" for c in pr.STUDENT_COLUMNS
    )
    return spark.createDataFrame(pupils, schema), spark.createDataFrame(schools)


STUDY = an.Study(pr.SCORE, pr.WEIGHT, pr.GROUP, pr.CONTROL, pr.STUDENT_INDEX, pr.STUDENT_INTERACTION, pr.SITE_KEY)


def test_presets_name_the_columns_of_both_files():
    assert len(pr.STUDENT_COLUMNS) == 20 and len(pr.SCHOOL_COLUMNS) == 6 and len(pr.STUDENT_INDEX.columns) == 14


def test_whole_study(spark, survey, folder):
    result = an.run_study(*survey, STUDY, folder, trees=5)
    assert result.errors == {}
    expected = {
        "band_statistics", "model_comparison", "index_by_band", "importance_forest", "importance_regression",
        "clusters", "cluster_profile", "cluster_outcomes", "main_model_coefficients", "marginal_effects",
        "stratified_by_index", "stratified_by_attitude", "grid_cells", "simple_slopes", "fitted_lines",
        "dimension_correlations", "index_histogram", "share_above_q75", "heterogeneity_by_index",
    }
    assert expected <= set(result.tables) and expected <= set(os.listdir(folder))
    table = spark.read.option("header", True).csv(f"{folder}/model_comparison")
    assert table.count() == 3
    bands = spark.read.option("header", True).csv(f"{folder}/band_statistics").collect()
    assert sum(int(r["sample_count"]) for r in bands) == 900


def test_study_from_files(spark, survey, folder):
    for name, df in zip(("student", "school"), survey):
        df.write.parquet(f"{folder}/in/{name}")
    sources = [Source(n, f"{folder}/in/{n}", f"{folder}/lake/{n}", format="parquet") for n in ("student", "school")]
    sources.append(Source("teacher", f"{folder}/in/teacher", f"{folder}/lake/teacher", format="parquet"))
    run = lambda srcs: an.run_from_files(spark, srcs, f"{folder}/manifest", STUDY, f"{folder}/results", with_index=False)
    report, result = run(sources)
    assert {r["dataset"]: r["status"] for r in report.collect()} == {
        "student": "ingested", "school": "ingested", "teacher": "failed"
    }
    assert list(result.tables) == ["band_statistics"] and os.listdir(f"{folder}/results") == ["band_statistics"]
    assert {r["status"] for r in run(sources[:2])[0].collect()} == {"skipped"}
    with pytest.raises(ValueError, match="school"):
        run([sources[0], Source("school", f"{folder}/in/none", f"{folder}/lake/none", format="parquet")])


def test_a_failing_step_leaves_the_others(spark, survey):
    pupils, _ = survey
    data = an.indexed_observations(*survey, pr.STUDENT_INDEX, pr.SITE_KEY, [pr.SCORE, pr.WEIGHT])
    out = an.index_analyses(
        data.withColumnRenamed(pr.SCORE, pr.SCORE), pr.STUDENT_INDEX, pr.SCORE, pr.WEIGHT, "absent", pr.GROUP, clusters=None, trees=2
    )
    assert {"ols_control", "ols_fixed_effects", "index_by_band"} <= set(out.errors)
    assert "ols_baseline" in out.tables and "model_comparison" in out.tables
    with pytest.raises(ValueError, match="Missing columns"):
        an.indexed_observations(pupils, None, pr.STUDENT_INDEX)


def test_cross_analyses(survey):
    pupils, _ = survey
    out = an.cross_analyses(pupils, pr.SCORE, pr.SEGMENT_ITEMS, pr.WEIGHT, [pr.REVERSED_ITEM])
    assert out.errors == {}
    rows = out.tables["crosstab"].collect()
    assert [r["band"] for r in rows] == ["low", "middle", "high"]
    assert out.tables["chi_square"].first()["dof"] == 4
    assert out.tables["segment_statistics"].count() == 3
    missing = {r["column"]: r["missing"] for r in out.tables["missing_values"].collect()}
    assert missing["MATHMOT"] == 18.0 and missing["all"] is not None


def test_interaction_presets(survey):
    data = an.indexed_observations(
        *survey, pr.STUDENT_INDEX, pr.SITE_KEY, [pr.SCORE, pr.WEIGHT, pr.GROUP, pr.CONTROL, *pr.ATTITUDE_ITEMS]
    )
    fit = md.interaction_model(data, pr.STUDENT_INTERACTION).first()
    assert fit["status"] == "ok" and fit["n"] == 882
    assert [t["term"] for t in fit["terms"]] == [
        "need_index", "attitude", "need_index_x_attitude", "ESCS", "intercept"
    ]


def test_missing_codes_are_recoded_before_the_study(spark, survey, folder):
    from pyspark.sql import functions as F

    pupils, schools = survey
    codes = spark.createDataFrame(
        [(pr.SCORE, 9999.0, True), ("HOMEPOS", 99.0, True), ("HOMEPOS", 1.0, False)], "column string, code double, is_missing boolean"
    )
    some = F.pmod(F.col(pr.SITE_KEY), F.lit(5)) == 0
    coded = pupils.withColumn("HOMEPOS", F.when(some, 99.0).otherwise(F.col("HOMEPOS")))
    coded = coded.withColumn(pr.SCORE, F.when(some, 9999.0).otherwise(F.col(pr.SCORE)))
    result = an.run_study(coded, schools, STUDY, folder, with_index=False, codebook=codes)
    assert result.errors == {}
    bands = spark.read.option("header", True).csv(f"{folder}/band_statistics").collect()
    assert max(float(r["max_score"]) for r in bands if r["max_score"]) < 9999
    assert sum(int(r["sample_count"]) for r in bands) == pupils.where(~some).count()
    # rows without a score keep their share
    assert sum(float(r["population_percentage"]) for r in bands) == pytest.approx(100.0)
