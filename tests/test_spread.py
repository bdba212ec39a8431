"""Skew-safe building blocks against plain NumPy and windows, with one key holding most rows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxmill.operators import spread as S


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    rows = [(("hot" if n % 10 else f"k{n % 7}"), n, float(v)) for n, v in enumerate(rng.normal(size=5000))]
    rows += [("ties", n, 1.0) for n in range(500)] + [("one", 0, 3.5)] + [("wild", n, 10.0 ** (n % 30)) for n in range(300)]
    return spark.createDataFrame(rows, "key string, id int, value double")


def test_percentiles_match_numpy(skewed):
    probs = {"a": 0.005, "b": 0.5, "c": 0.995, "d": 0.0, "e": 1.0}
    got = {r["key"]: r for r in S.exact_percentiles(skewed, ["key"], "value", probs).collect()}
    pdf = skewed.toPandas()
    assert set(got) == set(pdf["key"])
    for key, part in pdf.groupby("key"):
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.percentile(part["value"], 100 * p), rel=1e-12)


def test_rank_is_that_of_a_window(skewed):
    ranked = S.rank_by_hash(skewed, ["key"], ["id"], 5)
    order = Window.partitionBy("key").orderBy(F.md5(F.concat_ws("|", F.lit("5"), F.col("id").cast("string"))))
    plain = skewed.withColumn("want", F.row_number().over(order) - 1)
    both = ranked.join(plain.select("key", "id", "want"), ["key", "id"])
    assert both.filter("rank <> want").isEmpty()
    assert ranked.count() == skewed.count()


def test_attach_keeps_rows_and_kind_of_join(skewed, spark):
    small = spark.createDataFrame([("hot", 1), ("ties", 2)], "key string, tag int")
    assert S.attach(skewed, small, ["key"]).count() == skewed.filter("key in ('hot', 'ties')").count()
    assert S.attach(skewed, small, ["key"], "left").count() == skewed.count()


def test_numbered_and_grid_are_whole(spark):
    df = spark.createDataFrame([("a", 10001), ("b", 0), ("c", 3)], "key string, n int")
    out = {r["key"]: (r["n"], r["lo"], r["hi"]) for r in S.numbered(df, "n", "t").groupBy("key").agg(
        F.count_distinct("t").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).collect()}
    assert out == {"a": (10001, 0, 10000), "c": (3, 0, 2)}
    cells = S.grid(df.limit(1), [F.lit(-1), F.lit(0), F.lit(2)], [F.lit(2), F.lit(2), F.lit(2)])
    assert cells.count() == 0
    cells = S.grid(df.limit(1), [F.lit(-1), F.lit(0), F.lit(1)], [F.lit(2), F.lit(2), F.lit(5)])
    assert cells.select("i", "j", "k").distinct().count() == 3 * 2 * 4


def test_small_tables_are_joined_without_salts(spark):
    big = spark.range(1000).select((F.col("id") % 7).alias("case_id"), F.col("id").alias("i"), F.lit(1.0).alias("value"))
    small = S.settle(spark.createDataFrame([(i, i * i) for i in range(7)], "case_id bigint, n bigint"))
    plan = S.attach(big, small, ["case_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "_salt" not in plan
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        salted = S.attach(big, small, ["case_id"])
        assert "_salt" in salted._jdf.queryExecution().executedPlan().toString()
        assert salted.agg(F.sum("n")).first()[0] == sum(143 * i * i if i < 6 else 142 * i * i for i in range(7))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_repeated_rows_stay_off_the_driver(spark, monkeypatch):
    big = S.settle(spark.range(70000).select((F.col("id") % 7).alias("case_id"), F.col("id").alias("i"), F.rand(1).alias("value")))
    small = big.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        for most, broadcast in ((S.BROADCAST_ROWS, True), (3, False)):
            monkeypatch.setattr(S, "BROADCAST_ROWS", most)
            out = S.attach(big, small, ["case_id"]).agg(F.sum("n"), F.count(F.lit(1)))
            assert tuple(out.first()) == (70000 * 10000, 70000)
            out.collect()
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastExchange" in plan, "_salt" in plan) == (broadcast, not broadcast)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_joins_do_not_multiply_the_salts(spark):
    table = S.settle(spark.range(100000).select((F.col("id") % 7).alias("case_id"), F.col("id").alias("i")))
    once, wide = S.read_bytes(table), table
    for n in range(4):
        wide = wide.join(table.withColumnRenamed("i", f"i{n}"), "case_id")
    assert 0 < S.read_bytes(wide) <= 5 * once < S.SALT_BYTES < S.estimated_bytes(wide), (once, S.read_bytes(wide), S.estimated_bytes(wide))


def test_settled_tables_go_with_their_block(spark, tmp_path):
    import glob
    import voxmill.session as session
    before = set(glob.glob(f"{session.shared_dir(spark)}/table-*".replace("file:", "")))
    with session.scratch_tables(spark):
        assert S.settle(spark.range(5)).count() == 5
        inside = set(glob.glob(f"{session.shared_dir(spark)}/table-*".replace("file:", ""))) - before
        assert len(inside) == 1
    assert not inside & set(glob.glob(f"{session.shared_dir(spark)}/table-*".replace("file:", "")))
