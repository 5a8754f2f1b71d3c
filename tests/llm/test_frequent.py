from collections import Counter

import numpy as np
import pytest

from echolattice.llm.frequent import EMPTY, frequent, merge, summarize


def exact(values):
    v, n = np.unique(np.asarray(values, np.int64), return_counts=True)
    return v, n, np.zeros(len(v), np.int64), 0


@pytest.mark.parametrize("seed", range(5))
def test_merged_bounds_hold(seed):
    r = np.random.default_rng(seed)
    k, all_values, parts = 20, [], []
    for _ in range(9):
        values = r.zipf(1.3, 400) % 300
        all_values.append(values)
        s = EMPTY
        for piece in np.split(values, 8):
            s = merge(s, exact(piece), k)
        parts.append(s)
    while len(parts) > 1:
        parts = [merge(parts[i], parts[i + 1], k) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    items, count, error, floor = parts[0]
    truth = Counter(np.concatenate(all_values).tolist())
    total = sum(truth.values())
    assert len(items) <= k and floor <= total // k + 9
    for i, c, e in zip(items.tolist(), count.tolist(), error.tolist()):
        assert c - e <= truth[i] <= c
    for v, n in truth.items():
        if v not in set(items.tolist()):
            assert n <= floor


def brute(values, share):
    n = Counter(v for v in values if v is not None)
    return sorted((v, c) for v, c in n.items() if c >= share * sum(n.values()))


def test_frequent_values(spark):
    r = np.random.default_rng(1)
    values = [7] * 3000 + [-(2**62)] * 50 + [int(v) for v in r.zipf(1.4, 4000) % 5000] + [None] * 500 + list(range(10_000, 12_000))
    r.shuffle(values)
    df = spark.createDataFrame([(v, "x") for v in values], "h bigint, _item string").repartition(11)
    got = frequent(df, "h", 0.01, counters=100).collect()
    assert sorted((x.h, x.n_rows) for x in got) == brute(values, 0.01)
    assert all(x.n_estimated - x.n_over <= x.n_rows <= x.n_estimated for x in got)


def test_threshold_is_inclusive_and_exact(spark):
    df = spark.createDataFrame([(i,) for i in range(1000)], "h int")
    assert frequent(df, "h", 0.001).count() == 1000 and frequent(df.union(df.limit(1)), "h", 0.001).count() == 1


def test_summary_is_bounded(spark):
    df = spark.range(50_000).selectExpr("id AS h")
    assert summarize(df, "h", 64).count() == 65


def test_tree_of_many_partitions(spark):
    """Each task merges at most fan_in summaries (it raises otherwise), and the bounds hold at the root."""
    df = spark.range(0, 3000, 1, 300).selectExpr("CASE WHEN id % 3 = 0 THEN 5 ELSE id * 100 END AS h")
    root = summarize(df, "h", 8, fan_in=4).collect()
    head = next(r for r in root if r.head)
    (five,) = [r for r in root if r.item == 5 and not r.head]
    assert len(root) <= 9 and head.n == 3000 and five.n - five.err <= 1000 <= five.n and head.err <= 3000 / 8
    assert [(r.h, r.n_rows) for r in frequent(df, "h", 0.25).collect()] == [(5, 1000)]


def test_too_few_counters_are_refused(spark):
    df = spark.range(100).selectExpr("id % 50 AS h")
    with pytest.raises(ValueError):
        frequent(df, "h", 0.02, counters=49)
    assert frequent(df, "h", 0.02, counters=50).count() == 50


def test_nothing(spark):
    for rows in ([], [(None,)]):
        assert frequent(spark.createDataFrame(rows, "h bigint"), "h", 0.1).count() == 0
