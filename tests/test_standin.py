import pytest

from surveyloom.operators import lookup as lk, models as md, ols
from surveyloom.plans import queries as qu, standin as st


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    make = {
        "lineitem": (
            [(1, 1, 1, 1, 5.0, 900.0, 0.1, 0.08), (1, 2, 9, 2, 50.0, 800.0, 0.2, 0.01), (None, None, None, 3, None, 700.0, 0.0, 0.02)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double",
        ),
        "orders": ([(1, 7), (2, None)], "o_orderkey long, o_custkey long"),
        "customer": ([(7, 10.5), (7, 11.5)], "c_custkey long, c_acctbal double"),
        "part": ([(1, 4, 3.0), (2, 50, 6.0)], "p_partkey long, p_size int, p_retailprice double"),
        "supplier": ([(1, 2, 8.0)], "s_suppkey long, s_nationkey int, s_acctbal double"),
        "nation": ([(2, "X")], "n_nationkey int, n_name string"),
    }
    for name, (rows, schema) in make.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


ROLES = ["score", "effort", "item", "control", "psize", "price", "site", "grp", "tax"]


def test_lookups_move_lines_of_their_own_columns(spark, tables, monkeypatch):
    seen, hot = [], []

    def moved(facts, lookup, on, *args, **options):
        seen.append((on, set(facts.columns)))
        return lk.attach(facts, lookup, on, *args, **{**options, "small": False})

    def counted(df, on, share=None):
        hot.append((tuple(on), set(df.columns)))
        return found(df, on, share)

    found = lk.hot_key_hashes
    monkeypatch.setattr(st, "attach", moved)
    monkeypatch.setattr(lk, "hot_key_hashes", counted)
    rows = sorted(map(tuple, st.observations(spark, tables, *ROLES).collect()), key=str)
    assert rows == sorted(
        [
            (9.0, None, 2.0, 10.5, 4.0, 3.0, 8.0, "X", 0.08),
            (9.0, None, 2.0, 11.5, 4.0, 3.0, 8.0, "X", 0.08),
            (8.0, 0.01, 3.0, 10.5, None, 6.0, None, None, 0.01),
            (8.0, 0.01, 3.0, 11.5, None, 6.0, None, None, 0.01),
            (7.0, 0.02, None, None, None, None, None, None, 0.02),
        ],
        key=str,
    )
    # customers go to the orders, and roles that follow from a line's own columns are not moved beside them
    assert [on for on, _ in seen] == ["o_custkey", "l_orderkey", "l_partkey", "l_suppkey"]
    assert not any({"score", "effort", "item", "tax"} & names for _, names in seen)
    # frequent keys are found without running the joins before
    assert not any({"control", "psize", "price"} & names for on, names in hot if on != ("o_custkey",))


def test_residual_trend_reads_its_rows_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(x):
        calls.add(1)
        return x

    twice = spark.udf.register("counted", counted, "double")
    rows = spark.range(40).selectExpr("CAST(id AS DOUBLE) AS fitted", "SIN(id) AS r").select("fitted", twice("r").alias("residual"))
    assert md.residual_trend(rows).first()["n"] == 40 and calls.value == 40


def test_waves_are_not_written(spark, tables, monkeypatch):
    monkeypatch.setattr(qu, "settle", None)
    df, names = qu._waves(spark, tables, 30)
    assert len(names) == 30 and df.count() == 3


def test_incomplete_rows_of_wide_fits_are_left_out_in_tasks(spark):
    names = [f"x{i}" for i in range(28)]
    rows = spark.range(400).selectExpr("id", *[f"SIN(id * {0.3 + i}D) AS {x}" for i, x in enumerate(names)])
    rows = rows.selectExpr("id", *names[1:], "CASE WHEN id = 3 THEN NULL WHEN id = 5 THEN double('NaN') ELSE x0 END AS x0", "2 * x1 + 5 AS y")
    fit = ols.fit_ols(rows, "y", names).first()
    assert fit["n"] == 398 and fit["terms"][1]["estimate"] == pytest.approx(2.0) and fit["status"] == "ok"
    assert fit["terms"][-1]["estimate"] == pytest.approx(5.0)
