import random

import pytest

from echolattice.llm.components import groups, number, seeds


def brute(pairs):
    parent = {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is None or b is None:
            continue
        for x in (a, b):
            parent.setdefault(x, x)
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    members = {}
    for x in parent:
        members.setdefault(root(x), []).append(x)
    return sorted((x, min(m, key=lambda s: s.encode() if isinstance(s, str) else s)) for m in members.values() for x in m)


def run(spark, pairs):
    df = spark.createDataFrame([(*p, 1) for p in pairs], "a string, b string, item int")
    return sorted(map(tuple, groups(df, "a", "b").collect()))


def shapes():
    r = random.Random(4)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)]
    r.shuffle(chain)
    star = [("hub", f"s{i}") for i in range(200)]
    clique = [(f"k{i}", f"k{j}") for i in range(12) for j in range(i)]
    tree = [(f"t{i}", f"t{(i - 1) // 2}") for i in range(1, 90)]
    loose = [("self", "self"), ("é", "z"), ("\U0001f600", "￿"), ("m", "n"), ("n", "m"), ("m", "n"), (None, "x"), ("y", None), (None, None)]
    noise = [(f"r{r.randrange(60)}", f"r{r.randrange(60)}") for _ in range(45)]
    return chain + star + clique + tree + loose + noise


def test_all_shapes(spark):
    assert run(spark, shapes()) == brute(shapes())


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs_of_numbers(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(60)]
    got = sorted(map(tuple, seeds(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()))
    assert got == [x for x in brute(pairs) if x[0] != x[1]]


def test_without_links(spark):
    assert run(spark, []) == [] and run(spark, [(None, "a")]) == [] and run(spark, [("a", "a"), ("b", "b")]) == [("a", "a"), ("b", "b")]


def test_numbers_follow_the_order(spark):
    words = ["b", "a", "é", "Z", "\U0001f600", "￿", ""]
    got = dict(map(tuple, number(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()))
    assert got == {w: i for i, w in enumerate(sorted(words, key=str.encode))}
