import pytest
from pyspark.sql import functions as F

from surveyloom.operators import checks
from surveyloom.operators import lookup as lk


def test_required_columns(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert checks.missing_columns(df, ["a", "x", "y"]) == (False, ["x", "y"])
    assert checks.missing_columns(df, ["a"]) == (True, [])
    with pytest.raises(ValueError, match="x"):
        checks.require_columns(df, ["a", "x"])


def test_numeric_columns_go_by_type(spark):
    df = spark.createDataFrame([], "a byte, b short, c int, d long, e float, f double, g decimal(5,2), h array<int>, i string")
    assert checks.numeric_columns(df) == list("abcdefg")


def test_complete_rows_drop_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (1.0, float("nan")), (2.0, 2.0)], "a double, b double")
    assert checks.complete_rows(df, ["a", "b"]).count() == 2
    assert checks.non_empty(df) and not checks.non_empty(df.where("a > 5"))


def test_unique_check(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(ValueError, match="occurs 2 times"):
        checks.require_unique(df, ["k"])
    checks.require_unique(df.distinct(), ["k"])


def hot_facts(spark):
    """10,000 rows, half of them under one key, some without a key, one key unknown."""
    key = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 101 == 0, None).otherwise(F.col("id") % 500)
    return spark.range(0, 10_000, 1, 6).select("id", key.cast("long").alias("k"))


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_salted_join_equals_broadcast_join(spark, how, null_safe):
    facts = hot_facts(spark)
    side = spark.range(480).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    side = side.union(spark.createDataFrame([(None, -1)], "k long, v long"))
    small = lk.attach(facts, side, "k", how, null_safe)
    large = lk.attach(facts, side, "k", how, null_safe, rows=10, salts=5)
    assert small.columns == large.columns == ["id", "k", "v"]
    a, b = (sorted(map(tuple, d.collect()), key=str) for d in (small, large))
    assert a == b
    if how == "left":
        assert len(a) == 10_000


def test_hot_key_is_spread_over_salts(spark):
    facts = hot_facts(spark)
    hot = lk.hot_key_hashes(facts, ["k"], 0.05)
    assert facts.select(F.xxhash64(F.lit(7).cast("long"))).first()[0] in hot
    assert len(hot) <= 40


def test_lookup_size_is_measured_in_rows_and_bytes(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"))
    assert lk.fits_broadcast(df)
    assert not lk.fits_broadcast(df, rows=99)
    assert not lk.fits_broadcast(df, size=50_000)


def test_attach_aggregate_both_ways(spark):
    facts = hot_facts(spark)
    counts = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    one = lk.attach_aggregate(facts, counts, "k")
    two = lk.attach_aggregate(facts, counts, "k", rows=3)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)
    assert one.where("n IS NULL").count() == 0


def test_attach_rejects_clashing_columns(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError, match="both sides"):
        lk.attach(df, df, "k")


def test_site_join_prunes_and_checks(spark):
    obs = spark.createDataFrame([(1, 10, 5.0), (2, 10, 6.0), (3, 11, 7.0), (4, None, 8.0)], "id int, site int, x double")
    sites = spark.createDataFrame([(10, 1.5, "a"), (12, 2.5, "b")], "site int, y double, z string")
    out = lk.add_site_columns(obs, sites, "site", ["id", "site"], ["site", "y"])
    assert sorted(map(tuple, out.collect())) == [(1, 10, 1.5), (2, 10, 1.5), (3, 11, None), (4, None, None)]
    with pytest.raises(ValueError, match="occurs 2 times"):
        lk.add_site_columns(obs, sites.union(sites), "site")


def test_settled_frames_keep_schema_and_can_be_cleared(spark):
    df = spark.createDataFrame([(1, "a", None)], "i int, s string, d double")
    held = lk.settle(df)
    assert held.schema == df.schema and held.collect() == df.collect()
    assert lk.scratch_folder(spark).startswith(lk.checkpoint_home(spark))
    assert lk.clear_scratch(spark)


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def __init__(self, **known):
            self.known = known

        def get(self, key, default=None):
            return self.known.get(key.replace(".", "_"), default)

    class Session:
        def __init__(self, **known):
            self.conf = Conf(**known)

    local = Session(spark_sql_warehouse_dir="file:/x/wh", spark_master="local[2]")
    assert lk.checkpoint_home(local) == "file:/x/wh/scratch"
    with pytest.raises(ValueError):
        lk.checkpoint_home(Session(spark_sql_warehouse_dir="file:/x/wh", spark_master="spark://h:7077"))
    shared = Session(spark_sql_warehouse_dir="file:/x/wh", spark_master="spark://h:7077", spark_checkpoint_dir="hdfs://n/c")
    assert lk.checkpoint_home(shared) == "hdfs://n/c"
