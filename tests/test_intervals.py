import random

import numpy as np
import pytest

from echolattice.operators.intervals import periods_and_gaps, running_max


def brute(rows):
    out = []
    for e in sorted({r[0] for r in rows}):
        done = []
        for s, t in sorted((s, t) for x, s, t in rows if x == e and s is not None and t is not None and s < t):
            if done and s <= done[-1][1]:
                done[-1][1] = max(done[-1][1], t)
            else:
                done.append([s, t])
        out += [(e, "period", a, b) for a, b in done] + [(e, "gap", x[1], y[0]) for x, y in zip(done, done[1:])]
    return sorted(out)


def run(spark, rows, schema="name string, a bigint, b bigint"):
    return sorted(map(tuple, periods_and_gaps(spark.createDataFrame(rows, schema), ["name"], "a", "b").collect()))


@pytest.mark.parametrize("seed", range(4))
def test_random_intervals_over_many_partitions(spark, seed):
    r = random.Random(seed)
    names = ["hot"] * 6 + ["b", "c", "d"]
    rows = [(r.choice(names), s := r.randrange(3000), s + r.choice([0, 1, 3, 9, 40, -2, 2000 if seed == 3 else 5])) for _ in range(700)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_touching_nested_repeated_and_null(spark):
    rows = [("a", 0, 5), ("a", 5, 7), ("a", 1, 2), ("a", 0, 5), ("a", 9, 12), ("a", 20, 20), ("a", None, 3), ("a", 3, None), (None, 1, 2), ("b", 4, 4)]
    assert run(spark, rows) == [("a", "gap", 7, 9), ("a", "period", 0, 7), ("a", "period", 9, 12)]


def test_one_interval_covers_all_later_ones(spark):
    rows = [("a", 0, 10**6)] + [("a", i, i + 1) for i in range(1, 3000)]
    assert run(spark, rows) == [("a", "period", 0, 10**6)]


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([("a", 1, 2, 9, 9)], "name string, a bigint, b bigint, _pid int, kind int")
    assert periods_and_gaps(df, ["name"], "a", "b").count() == 1


def test_running_max_of_huge_values():
    v = np.array([-(2**62), 2**62, 0, 5, -7])
    assert running_max(v, np.array([0, 0, 0, 1, 1])).tolist() == [-(2**62), 2**62, 2**62, 5, 5]
