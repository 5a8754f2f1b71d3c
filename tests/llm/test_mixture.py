import numpy as np
import pandas as pd
import pytest

from echolattice.llm.mixture import _rounding, kept, mix, pair, plan_rates, shares

TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 4), ("none", 0.1, 2)]


def frames(spark, n=900, seed=0):
    r = np.random.default_rng(seed)
    rows = [(int(i), str(r.choice(["a"] * 8 + ["b", "c"])), int(r.integers(1, 500)), "x") for i in range(n)]
    rows += [(n, None, 50, "x"), (n + 1, "other", 50, "x"), (n + 2, "a", 0, "x"), (n + 3, "a", None, "x")]
    return spark.createDataFrame(rows, "id bigint, source string, size bigint, copies string"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_pairing_keeps_the_size():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 500):
        p, size = r.uniform(0, 1, n), r.integers(1, 1000, n)
        before, q = (p * size).sum(), p.copy()
        copy, left = pair(q, size, lambda at, _: r.uniform(size=len(at)))
        assert set(copy.tolist()) <= {-1, 0, 1} and (copy < 0).sum() == (left >= 0)
        after = (np.where(copy < 0, q, copy) * size).sum()
        assert abs(before - after) < 1e-6 * before + 1e-6


def test_pairing_keeps_expectations():
    p0, size, n = np.array([0.2, 0.5, 0.7, 0.35]), np.array([1, 5, 2, 3]), 20_000
    r, got = np.random.default_rng(0), np.zeros(4)
    for _ in range(n):
        p = p0.copy()
        copy, left = pair(p, size, lambda at, _: r.uniform(size=len(at)))
        got += np.where(copy < 0, p, copy)
    assert np.abs(got / n - p0).max() < 0.015


def test_last_fraction_keeps_its_expectation_too():
    rows = pd.DataFrame({"source": "a", "id": [11, 12, 13], "size": [4, 1, 7], "p": [0.3, 0.3, 0.3], "bucket": 0, "copy": -1})
    got = np.array([_rounding(0, seed, True)(rows)["copy"].to_numpy() for seed in range(6000)])
    assert set(np.unique(got)) == {0, 1} and np.abs(got.mean(0) - 0.3).max() < 0.03
    assert (_rounding(0, 1, False)(rows)["copy"] < 0).sum() == 1


def test_many_fractions_are_settled_in_few_passes():
    r, turns = np.random.default_rng(5), set()
    p, size = r.uniform(0, 1, 100_000), r.integers(1, 1000, 100_000)
    before = (p * size).sum()
    copy, left = pair(p, size, lambda at, turn: (turns.add(turn), r.uniform(size=len(at)))[1])
    assert (copy < 0).sum() <= 1 and len(turns) <= 18 and abs((np.where(copy < 0, p, copy) * size).sum() - before) < 1e-6 * before


@pytest.mark.parametrize("total", [None, 3000.0, 400_000.0])
def test_what_is_promised_is_checked(spark, total):
    df, targets = frames(spark)
    mixed = mix(df, targets, "id", "source", "size", total=total)
    rows = {r.source: r for r in kept(mixed, df, targets, "id", "source", "size", total).collect()}
    sums = df.where("size > 0").groupBy("source").count().collect()
    assert {s: r.available for s, r in rows.items()} == {"none": 0, **{x[0]: x[1] for x in sums if x[0] in ("a", "b", "c")}}
    assert all(r.once and r.capped and r.close for r in rows.values())
    bad = {r.source: r for r in kept(mixed.union(mixed).withColumn("copies", mixed["copies"] * 9), df, targets, "id", "source", "size", total).collect()}
    assert not (bad["a"].once or bad["a"].capped or bad["a"].close)


@pytest.mark.parametrize("bucket_rows", [20, 50_000])
def test_shares_are_met(spark, bucket_rows):
    df, targets = frames(spark)
    got = mix(df, targets, "id", "source", "size", bucket_rows=bucket_rows, fan_in=3).toPandas()
    cap = {s: m for s, _, m in TARGETS}
    assert got["id"].is_unique and (got["copies"] >= 1).all() and all(c <= cap[s] for s, c in zip(got["source"], got["copies"]))
    size = (got["size"] * got["copies"]).groupby(got["source"]).sum()
    assert set(size.index) == {"a", "b", "c"}
    sums = df.toPandas().groupby("source")["size"].sum()
    rates = plan_rates({s: int(sums[s]) for s in "abc"}, TARGETS, None)
    assert max(abs(size[s] - rates[s] * sums[s]) for s in "abc") < 500  # less than one record
    assert any(abs(rates[s] - cap[s]) < 1e-9 for s in "abc")
    reached = got.groupby("source")["reached_share"].first()
    assert np.allclose(reached, size / size.sum()) and abs(reached["a"] - 0.5) < 0.01
    report = {r.source: r for r in shares(spark.createDataFrame(got), targets, "source", "size").collect()}
    assert report["none"].reached_share == 0 and abs(sum(r.reached_share for r in report.values()) - 1) < 1e-9


def test_choice_does_not_depend_on_partitions(spark):
    df, targets = frames(spark)
    a, b = (sorted(map(tuple, mix(x, targets, "id", "source", "size", bucket_rows=100).select("id", "copies").collect())) for x in (df, df.repartition(9, "size")))
    assert a == b


def test_total_beyond_the_caps():
    rates = plan_rates({"a": 100, "b": 100}, [("a", 0.9, 1), ("b", 0.1, 5)], 400)
    assert rates == {"a": 1.0, "b": 3.0} and plan_rates({}, TARGETS, None) == {} and plan_rates({"a": 10}, TARGETS, 5) == {"a": 0.5}


def test_empty(spark):
    df, targets = frames(spark)
    assert mix(df.limit(0), targets, "id", "source", "size").count() == 0 and mix(df, targets.limit(0), "id", "source", "size").count() == 0


def test_shares_of_an_empty_mixture(spark):
    df, targets = frames(spark)
    got = shares(mix(df.limit(0), targets, "id", "source", "size"), targets, "source", "size").toPandas()
    assert isinstance(got, pd.DataFrame) and (got["reached_share"] == 0).all() and len(got) == 4
