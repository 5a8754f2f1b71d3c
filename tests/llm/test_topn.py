import random

import pytest

from pyspark.sql import functions as F

from echolattice.llm.topn import top_n, within

SCHEMA = "g string, score bigint, tie int, id bigint, extra string, _g string"


def brute(rows, n, distinct):
    best = {}
    for g, s, t, i, e, _ in rows:
        if g is None or s is None or i is None:
            continue
        key = (g, s, t, e) if distinct else i
        best[key] = min(best.get(key, (g, s, t, i)), (g, s, t, i), key=lambda x: x[3])
    out = []
    for g in {v[0] for v in best.values()}:
        mine = sorted((v for v in best.values() if v[0] == g), key=lambda v: (-v[1], v[2] is not None, v[2] or 0, v[3]))
        out += [(g, v[3], r + 1) for r, v in enumerate(mine[:n])]
    return sorted(out)


def run(spark, rows, n, distinct=True, parts=7, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted((r.g, r.id, r["rank"]) for r in top_n(df, "g", "score", ["tie"], "id", n, ["g", "score", "tie", "extra"] if distinct else None, **more).collect())


@pytest.mark.parametrize(("n", "distinct"), [(1, True), (5, True), (5, False), (1000, True)])
def test_equals_brute_force(spark, n, distinct):
    r = random.Random(n)
    rows = [(r.choice(["hot"] * 5 + ["b", "c", "d", "é"]), r.randrange(-4, 4), r.choice([None, 1, 2, 3]), i, r.choice("xy"), "z") for i in range(1500)]
    assert run(spark, rows, n, distinct) == brute(rows, n, distinct)


@pytest.mark.parametrize("distinct", [True, False])
def test_bounds_too_many_to_broadcast(spark, distinct):
    r = random.Random(8)
    rows = [(r.choice(["hot"] * 9 + list("bcdefgh")), r.randrange(50), r.choice([None, 1]), i, r.choice("xy"), "z") for i in range(1500)]
    assert run(spark, rows, 4, distinct, most_broadcast=0) == brute(rows, 4, distinct)


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_bound_cuts_candidates_before_they_are_shuffled(spark, most):
    """Of 40 partitions with five candidates of a hot group each, only those that reach the best fifth item stay; groups without a bound keep all."""
    rows = [("hot", i, p, p * 5 + i, i + 1) for p in range(40) for i in range(5)] + [("few", i, 0, 900 + i, i + 1) for i in range(3)]
    best = spark.createDataFrame(rows, "_g string, _k0 long, _i0b int, _id long, _rank int").withColumn("_k0", F.col("_k0") + F.col("_i0b"))
    place = F.struct("_k0", "_id")
    bounds = best.where("_rank = 5").groupBy("_g").agg(F.min(place).alias("_bound"))
    left = within(best, bounds, place, most).collect()
    key = lambda r: (r[1], r[3])
    hot = sorted(key(r) for r in best.collect() if r[0] == "hot")
    want = [x for x in hot if x <= min(key(r) for r in best.collect() if r[0] == "hot" and r[4] == 5)]
    assert sorted(key(r) for r in left if r[0] == "hot") == want and len(want) == 11 and sum(r[0] == "few" for r in left) == 3


def test_repeated_rows_take_one_place(spark):
    rows = [("a", 9, 1, i, "same", None) for i in range(400, 0, -1)] + [("a", 8, 1, 1000 + i, f"{i}", None) for i in range(10)]
    assert run(spark, rows, 3) == [("a", 1, 1), ("a", 1000, 2), ("a", 1001, 3)]


def test_ties_nulls_and_extremes(spark):
    rows = [("a", 2**63 - 1, 2, 5, "x", None), ("a", 2**63 - 1, None, 9, "x", None), ("a", -(2**63), 1, 1, "x", None), (None, 5, 1, 2, "x", None), ("a", None, 1, 3, "x", None), ("", 1, 1, 4, None, None), ("", 1, 1, 3, None, None)]
    assert run(spark, rows, 5) == [("", 3, 1), ("a", 1, 3), ("a", 5, 2), ("a", 9, 1)]


def test_empty(spark):
    assert run(spark, [], 5) == []


def test_scores_of_doubles(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", -1.5, 2), ("a", 0.25, 3)], "g string, s double, id bigint")
    assert [(r.s, r.id) for r in top_n(df, "g", "s", [], "id", 2).orderBy("rank").collect()] == [(0.5, 1), (0.25, 3)]
