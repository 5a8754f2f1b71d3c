from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from echolattice.operators import skew
from echolattice.operators.skew import heavy_keys, join_unique, profile_both_ways


def test_profiles_with_hot_keys_and_nulls(spark):
    rows = [(1, i % 50, i) for i in range(600)] + [(i, i % 7, i) for i in range(2, 200)] + [(None, 1, 5), (2, None, -4), (3, 4, None), (None, None, None)] + [(1, 0, 0)] * 3
    df = spark.createDataFrame(rows, "h bigint, r int, t int")
    got = {(x.field_name, x.key_value): (x.n_rows, x.n_partners, x.first_value, x.last_value, x.field_rows) for x in profile_both_ways(df, "h", "r", "t").collect()}
    want = {}
    for name, k, p in (("h", 0, 1), ("r", 1, 0)):
        groups = defaultdict(list)
        for x in rows:
            if x[k] is not None:
                groups[x[k]].append(x)
        total = sum(map(len, groups.values()))
        for key, g in groups.items():
            ts = [x[2] for x in g if x[2] is not None]
            want[name, key] = (len(g), len({x[p] for x in g if x[p] is not None}), min(ts, default=None), max(ts, default=None), total)
    assert got == want


@pytest.mark.parametrize("chosen", [[[], []], [[0, 2], [1]], [[0, 1, 2, 77], [0, 1, 2, 3, 4]]])
def test_result_does_not_depend_on_what_is_heavy(spark, monkeypatch, chosen):
    df = spark.createDataFrame([(i % 3, i % 5, i) for i in range(60)], "k int, p int, v int")
    monkeypatch.setattr(skew, "heavy_keys", lambda *_: chosen)
    got = sorted(map(tuple, profile_both_ways(df, "k", "p", "v").collect()))
    assert got == [("k", k, 20, 5, k, 57 + k, 60) for k in range(3)] + [("p", p, 12, 3, p, 55 + p, 60) for p in range(5)]


def test_many_keys_that_each_fill_a_task(spark):
    """500 keys of 0.19 % each, below any fixed share, and a long tail: exact counts, and no more heavy keys than the partitions bound."""
    rows = spark.range(500 * 19 + 500).select(F.when(F.col("id") < 9500, F.col("id") % 500).otherwise(F.col("id")).alias("k"), (F.col("id") % 19).cast("int").alias("p"), F.col("id").cast("int").alias("t"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    try:
        heavy = heavy_keys(rows, [F.col("k"), F.col("p")])
        assert 400 <= len(heavy[0]) <= 500 and set(heavy[0]) <= set(range(500)) and heavy[1] == list(range(19))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    few = heavy_keys(rows, [F.col("k")])[0]
    assert len(few) <= 8
    got = {x.key_value: (x.n_rows, x.n_partners) for x in profile_both_ways(rows, "k", "p", "t").where("field_name = 'k'").collect()}
    assert len(got) == 1000 and all(got[k] == (19, 19) for k in range(500)) and all(got[k] == (1, 1) for k in range(9500, 10_000))


def test_table_is_read_once_and_branches_share_the_shuffle(spark, tmp_path):
    spark.range(2000).select((F.col("id") % 3).alias("h"), (F.col("id") % 700).cast("int").alias("r"), F.col("id").alias("t")).write.parquet(f"{tmp_path}/x")
    found = profile_both_ways(spark.read.parquet(f"{tmp_path}/x"), "h", "r", "t")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp_path}/x" not in plan and "ReusedExchange" in plan


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "h bigint, r int, t int, _k int, n_rows int")
    assert profile_both_ways(df, "h", "r", "t").count() == 0


def test_join_with_hot_keys(spark):
    left = spark.createDataFrame([(1, i) for i in range(300)] + [(i, i) for i in range(2, 40)] + [(None, 0)], "k int, v int")
    right = spark.createDataFrame([(i, f"n{i}") for i in range(1, 30)], "k int, name string")
    for how in ("inner", "left"):
        got, want = (sorted(map(str, x.select("k", "v", "name").collect())) for x in (join_unique(left, right, "k", how), left.join(right, "k", how)))
        assert got == want
    assert join_unique(left.limit(0), right, "k").count() == 0 and join_unique(left, right, "k").count() == 328
