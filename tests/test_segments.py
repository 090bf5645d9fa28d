import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import segments as sg
from surveyloom.operators.forest import forest_importance

ITEMS = ["time", "skips", "drive", "grit"]
CENTRES = [(9.0, 1.0, 2.0, 2.0), (5.0, 2.5, 0.0, 0.0), (1.0, 4.0, -2.0, -2.0)]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    rows = [(b, *(np.array(CENTRES[b]) + rng.normal(0, 0.1, 4)).tolist(), 1.0 + b) for b in (0, 1, 2) for _ in range(60)]
    rows.append((None, None, 1.0, 1.0, 1.0, 1.0))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["blob", *ITEMS, "w"])).replace(float("nan"), None)


def test_planted_segments_are_found_and_named(blobs):
    s = sg.attitude_segments(blobs, ITEMS, reverse=["skips"], k=3)
    assert s.rows.count() == 180 and s.columns == ("time", "skips_reversed", "drive", "grit")
    found = {(r["blob"], r["segment"]): r["n"] for r in s.rows.groupBy("blob", "segment").agg(F.count("*").alias("n")).collect()}
    assert found == {(float(i), name): 60 for i, name in enumerate(sg.NAMES_BY_COUNT[3])}
    assert sg.silhouette(s).first()["silhouette"] > 0.9
    assert "features" not in s.drop_vectors().columns
    assert s.summary().agg(F.sum("size")).first()[0] == 180
    weighted = sg.attitude_segments(blobs, ITEMS, reverse=["skips"], k=3, weight="w")
    assert sorted(r["size"] for r in weighted.summary().collect()) == [60, 60, 60]


@pytest.mark.parametrize("k", [2, 3, 4])
def test_ids_and_labels(blobs, k):
    s = sg.attitude_segments(blobs, ITEMS, k=k)
    ids = {r[0] for r in s.rows.select("cluster").distinct().collect()}
    assert ids <= set(range(k)) and set(s.labels) == set(range(k)) and len(set(s.labels.values())) == k


def test_labels_follow_the_sum_of_the_centre():
    assert sg.rank_labels([(0, 0), (5, 5)]) == {1: "Proactive Learners", 0: "Disengaged Learners"}
    assert sg.rank_labels([(1,), (3,), (2,), (0,)])[3] == "Cluster 3 (Engagement Rank 4)"
    assert sg.dominant_dimension([(0.5, -2.0), (0.1, 0.0)], ["a", "b"]) == ["Low in b", "High in a"]


def test_dimension_clusters(blobs):
    s = sg.dimension_clusters(blobs, ["time", "drive"], k=3)
    table = s.summary().collect()
    assert {r["label"] for r in table} == {"cluster_0", "cluster_1", "cluster_2"}
    assert all(r["inertia"] == s.cost for r in table) and s.centre_table().count() == 6


def test_standard_features_are_centred(blobs):
    from pyspark.ml.functions import vector_to_array

    rows = sg.standard_features(blobs, ["time"]).select(vector_to_array("features")[0].alias("z"))
    r = rows.agg(F.avg("z"), F.stddev_samp("z")).first()
    assert r[0] == pytest.approx(0.0, abs=1e-12) and r[1] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        sg.standard_features(blobs, ["absent"])


def test_forest_finds_the_planted_feature(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame(rng.normal(size=(800, 3)), columns=["a", "b", "c"])
    pdf["y"] = 5 * pdf["b"] + pdf["c"] + rng.normal(0, 0.1, 800)
    df = spark.createDataFrame(pdf).union(spark.createDataFrame([(1.0, None, 1.0, 1.0), (1.0, 1.0, 1.0, None)], "a double, b double, c double, y double"))
    rows = forest_importance(df, ["a", "b", "c", "gone"], "y", num_trees=10, max_depth=5).collect()
    assert [r["feature"] for r in rows][0] == "b" and [r["rank"] for r in rows] == [1, 2, 3]
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0) and rows[0]["model_accuracy"] > 0.8
    assert forest_importance(df, ["a", "b", "c"], "y", 5, 3, top_n=1).count() == 1
    with pytest.raises(ValueError):
        forest_importance(df, ["gone"], "y")


def test_the_same_clusters_however_rows_are_split(spark):
    rng = np.random.default_rng(8)
    rows = pd.DataFrame(rng.normal(size=(3000, 3)) * [1, 5, 0.2] + 7, columns=["a", "b", "c"]).assign(w=rng.random(3000))
    rows = pd.concat([rows, rows.iloc[[0] * 1500]])  # a third of all rows is one row
    fits = []
    for parts in (1, 3, 8):
        s = sg.kmeans_segments(spark.createDataFrame(rows).repartition(parts), ["a", "b", "c"], k=4, weight="w")
        sizes = {r["cluster"]: r["n"] for r in s.rows.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
        fits.append((s.centres, sizes, s.labels))
    assert fits[0][1:] == fits[1][1:] == fits[2][1:]
    assert np.allclose(fits[0][0], fits[1][0], atol=1e-8) and np.allclose(fits[0][0], fits[2][0], atol=1e-8)
    assert [sum(c) for c in fits[0][0]] == sorted((sum(c) for c in fits[0][0]), reverse=True)


def test_as_good_as_the_library(blobs, spark):
    from pyspark.ml.clustering import KMeans

    rng = np.random.default_rng(9)
    rows = spark.createDataFrame(pd.DataFrame(rng.normal(size=(2000, 2)), columns=["a", "b"]))
    s = sg.kmeans_segments(rows, ["a", "b"], k=3, max_iter=100, scale=False)
    theirs = min(
        KMeans(k=3, seed=i, maxIter=100, featuresCol="features").fit(s.rows.select("features")).summary.trainingCost for i in range(3)
    )
    assert s.cost <= theirs * 1.05


def test_few_different_rows_and_none(spark):
    same = spark.createDataFrame([(1.0, 2.0)] * 50 + [(3.0, 4.0)], "a double, b double")
    s = sg.kmeans_segments(same, ["a", "b"], k=3, scale=False)
    assert s.centres == ((3.0, 4.0), (1.0, 2.0)) and s.cost == 0
    with pytest.raises(ValueError):
        sg.kmeans_segments(same.filter("false"), ["a", "b"], scale=False)


def test_given_centres(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,)], "a double")
    got = sg.assign_to_centres(rows, ["a"], [(0.0,), (2.0,)]).collect()
    assert [(r["a"], r["cluster"], r["distance"]) for r in got] == [(0.0, 0, 0.0), (1.0, 0, 1.0), (2.0, 1, 0.0)]
