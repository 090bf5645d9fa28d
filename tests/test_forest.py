"""The forest: its input is read once, its splits are the best ones, and no number of nodes is too large."""

import shutil

import numpy as np
import pandas as pd
import pytest

from surveyloom.operators import forest
from surveyloom.operators.forest import forest_importance


def test_the_input_is_not_read_again_for_the_accuracy(spark, folder):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(500, 2)), columns=["a", "y"])
    spark.createDataFrame(pdf).write.parquet(f"{folder}/rows")
    out = forest_importance(spark.read.parquet(f"{folder}/rows"), ["a"], "y", 3, 2)
    # where the input is a join, every other reading would repeat it
    shutil.rmtree(f"{folder}/rows")
    assert 0 <= out.first()["model_accuracy"] <= 1


def test_draws_follow_from_the_row_alone():
    rows = np.arange(100_000, dtype=np.int64)
    drawn = forest._drawn_by_bits()
    assert drawn.mean() == pytest.approx(1.0, abs=1e-3) and (drawn == 0).mean() == pytest.approx(np.exp(-1), abs=1e-4)
    bits = forest._bits(rows, 42, 0)
    assert (forest._bits(rows[500:600], 42, 0) == bits[500:600]).all()
    times = drawn[np.hstack([bits, forest._bits(rows, 42, 1)])]
    assert times.mean(0) == pytest.approx(np.ones(8), abs=0.02) and times.var(0) == pytest.approx(np.ones(8), abs=0.04)
    assert np.abs(np.corrcoef(times.T) - np.eye(8)).max() < 0.02


def grown(data, cuts, *args):
    levels, roots, saved = forest._grow(data, cuts, *args)
    return roots, saved, forest._predicted(data, cuts, levels, roots, 0.0, 1.0).collect()


def test_splits_are_those_of_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    n, depth = 700, 4
    x, w = rng.integers(0, 6, (n, 2)), rng.integers(1, 4, n)
    y = x[:, 0] * 1.0 - 2.0 * (x[:, 1] > 2) + rng.normal(0, 0.5, n)
    pdf = pd.DataFrame({"row": np.arange(n), "label": y, "weight": w.astype(float), "x0": x[:, 0] * 1.0, "x1": x[:, 1] * 1.0})
    cuts = [np.arange(5.0), np.arange(5.0)]
    times = forest._drawn_by_bits()[forest._bits(np.arange(n), 7, 0)[:, 0]] * w
    saved, value = np.zeros(2), np.zeros(n)

    def split(rows, level):
        error = lambda r: ((y[r] - np.average(y[r], weights=times[r])) ** 2 * times[r]).sum() if times[r].any() else 0.0
        value[rows] = np.average(y[rows], weights=times[rows])
        if level == depth:
            return
        tried = [
            (error(rows) - error(rows[x[rows, f] <= c]) - error(rows[x[rows, f] > c]), -f, -c)
            for f in range(2) for c in range(5) if times[rows[x[rows, f] <= c]].any() and times[rows[x[rows, f] > c]].any()
        ]
        if tried and max(tried)[0] > 1e-9:
            gain, f, c = max(tried)
            saved[-f] += gain
            split(rows[x[rows, -f] <= -c], level + 1)
            split(rows[x[rows, -f] > -c], level + 1)

    split(np.arange(n), 0)
    data = spark.createDataFrame(pdf).repartition(3)
    for limit, part in ((forest.SUMS_BYTES, forest.PART_BYTES), (2048, 1024)):  # all nodes at once, and a few at a time
        monkeypatch.setattr(forest, "SUMS_BYTES", limit)
        monkeypatch.setattr(forest, "PART_BYTES", part)
        roots, mine, rows = grown(data, cuts, 0.0, 1.0, 1, depth, 7)
        assert roots[0] == pytest.approx(np.average(y, weights=times))
        assert mine[0] == pytest.approx(saved)
        assert sorted(r["prediction"] for r in rows) == pytest.approx(sorted(value))


def test_refusals(spark):
    rows = spark.createDataFrame([(float(i % 7), float(i), 1.0 - 2.0 * (i == 5)) for i in range(50)], "a double, b double, w double")
    for bad in (
        lambda: forest_importance(rows, ["a"], "b", weight="w"),
        lambda: forest_importance(rows.where("a < 0"), ["a"], "b"),
        lambda: forest_importance(rows.selectExpr("a", "double('infinity') AS b"), ["b"], "a"),
        lambda: forest_importance(rows.selectExpr("a", "string(b) AS b"), ["b"], "a"),
    ):
        with pytest.raises(ValueError):
            bad()
