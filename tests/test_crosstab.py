import math

import pytest

from surveyloom.operators import crosstab as ct

COLUMNS = ["Proactive", "Average", "Disengaged"]


def long(spark, matrix, rows=("low", "middle", "high"), columns=COLUMNS):
    data = [(r, c, float(v)) for r, line in zip(rows, matrix) for c, v in zip(columns, line) if v is not None]
    return spark.createDataFrame(data, "band string, label string, w double")


def test_crosstab_fills_empty_cells(spark):
    df = long(spark, [(1, 2, None), (3, None, 4)], rows=("low", "high"))
    rows = {r["band"]: r for r in ct.crosstab(df, "band", "label", "w", COLUMNS).collect()}
    assert tuple(rows["low"])[1:] == (1.0, 2.0, 0.0) and tuple(rows["high"])[1:] == (3.0, 0.0, 4.0)
    assert ct.crosstab(df, "band", "label", "w").columns == ["band", *sorted(COLUMNS)]
    assert ct.filled_cells(df, "band", "label", "w", COLUMNS).count() == 6


def test_totals_and_row_percent(spark):
    df = long(spark, [(1, 2, 3), (4, 5, 6), (7, 8, 9)])
    cells = {(r["band"], r["label"]): r["weighted_count"] for r in ct.crosstab_with_totals(df, "band", "label", "w").collect()}
    assert len(cells) == 16 and cells["total", "total"] == 45.0 and cells["low", "total"] == 6.0
    assert cells["total", "Average"] == 15.0
    pct = ct.row_percent(ct.weighted_cells(df, "band", "label", "w"), "band").where("band = 'low'")
    assert sum(r["row_percent"] for r in pct.collect()) == pytest.approx(100.0)


@pytest.mark.parametrize(
    "matrix,low,high",
    [
        ([(100, 200, 50), (200, 300, 100), (50, 100, 30)], 1e-6, 100),
        ([(100, 200, 50)] * 3, -1e-10, 1e-10),
        ([(1000, 100, 50), (100, 1000, 50), (50, 100, 1000)], 100, 1e9),
    ],
)
def test_chi_square(spark, matrix, low, high):
    r = ct.chi_square(long(spark, matrix), "band", "label", "w").first()
    assert r["dof"] == 4 and low <= r["statistic"] <= high
    assert r["p_value"] == pytest.approx(math.exp(-r["statistic"] / 2) * (1 + r["statistic"] / 2), abs=1e-12)
    assert r["significant"] == (r["p_value"] < 0.05)


def test_empty_cells_count_and_empty_margins_do_not(spark):
    with_hole = long(spark, [(10, None, 5), (5, 10, 5), (5, 5, 10)])
    r = ct.chi_square(with_hole, "band", "label", "w").first()
    cells = ct.expected_cells(with_hole, "band", "label", "w", [*COLUMNS, "Nobody"]).collect()
    assert len(cells) == 9 and r["dof"] == 4
    assert r["statistic"] == pytest.approx(sum((c["observed"] - c["expected"]) ** 2 / c["expected"] for c in cells))


def test_correction_only_with_one_degree_of_freedom(spark):
    df = long(spark, [(10, 20), (30, 20)], rows=("low", "high"), columns=("a", "b"))
    plain = ct.chi_square(df, "band", "label", "w", correction=False).first()
    fixed = ct.chi_square(df, "band", "label", "w").first()
    assert plain["statistic"] == pytest.approx(80 * (10 * 20 - 20 * 30) ** 2 / (30 * 50 * 40 * 40))
    assert fixed["statistic"] == pytest.approx(80 * (400 - 40) ** 2 / (30 * 50 * 40 * 40))
    assert plain["cramers_v"] == fixed["cramers_v"] == pytest.approx(math.sqrt(plain["statistic"] / 80))


def test_rescaling_undoes_the_size_of_the_weights(spark):
    small = long(spark, [(1, 2, 1), (2, 1, 1), (1, 1, 2)])
    big = small.selectExpr("band", "label", "w * 1000 AS w")
    a = ct.chi_square(small, "band", "label", "w", rescale=True).first()
    b = ct.chi_square(big, "band", "label", "w", rescale=True).first()
    assert a["statistic"] == pytest.approx(b["statistic"]) and b["total_weight"] == pytest.approx(9.0)


@pytest.mark.parametrize("size", [1, 2, 8192])
def test_empty_cells_are_made_in_tasks_and_not_joined(spark, monkeypatch, size):
    monkeypatch.setattr(ct, "BLOCK_LABELS", size)
    rows = [(1, "a", 2.0), (1, "a", 3.0), (1, "c", None), (None, "b", 4.0), (2, None, 7.0), (3, "d", float("nan"))]
    grid = ct.filled_cells(spark.createDataFrame(rows, "r int, c string, w double"), "r", "c", "w", ["e", "a"])
    found = {(r["r"], r["c"]): r["weighted_count"] for r in grid.collect()}
    assert grid.count() == 20 and found == {(r, c): 0.0 for r in (1, 2, 3, None) for c in "abcde"} | {(1, "a"): 5.0, (None, "b"): 4.0}
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    # the empty cells come last: nothing joins or shuffles them
    assert "posexplode" in plan and "Join" not in plan[: plan.index("posexplode")]


@pytest.mark.parametrize("size, whole", [(1, 0), (3, 10**9), (8192, 0)])
def test_empty_cells_are_counted_off_in_tasks_by_the_size_of_the_grid(spark, monkeypatch, size, whole):
    for name, value in (("BLOCK_LABELS", size), ("TASK_CELLS", 16), ("WHOLE_ROWS", whole)):
        monkeypatch.setattr(ct, name, value, raising=False)
    sums = {(r, c): float(r + c + 1) for r in range(40) for c in range(20) if r * c % 7 in (1, 2, 4) or r % 20 == c}
    df = spark.createDataFrame([(*cell, w / 2) for cell, w in sums.items() for _ in range(2)], "r int, c int, w double")
    grid = ct.filled_cells(df, "r", "c", "w")
    rows = grid.collect()
    assert len(rows) == 800 and {(r["r"], r["c"]): r["weighted_count"] for r in rows} == {(r, c): sums.get((r, c), 0.0) for r in range(40) for c in range(20)}
    # 800 cells are 50 tasks' work however few bytes are moved, and no cell is looked up among the others of its row
    assert grid.rdd.getNumPartitions() == 50
    assert "array_except" not in grid._jdf.queryExecution().optimizedPlan().toString()


def test_degrees_of_freedom_beyond_an_int(spark):
    r = ct.chi_square(spark.range(50_000).selectExpr("id AS r", "id AS c", "1D AS w"), "r", "c", "w").select("dof", "statistic").first()
    assert r["dof"] == 49_999**2 and r["statistic"] == pytest.approx(50_000 * 49_999)
    few = ct.chi_square(spark.range(3).selectExpr("id AS r", "id AS c", "1D AS w"), "r", "c", "w")
    assert dict(few.dtypes)["dof"] == "int"
