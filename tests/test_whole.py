"""Queries do the whole job: against brute force or SQL written for these tests."""

from collections import Counter, defaultdict
from math import floor, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from echolattice.operators import blocks, match
from echolattice.functions import names
from echolattice.plans import catalog, core


def test_best_shift_of_all_stated_queries_in_all_bins(spark, tmp_path):
    rows = [(u, float(u % 7 * 31 + k * k * 3)) for u in (0, 7, 33, 50, 150) for k in range(6)]
    spark.createDataFrame(rows, "user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    bins = defaultdict(Counter)
    for u, v in rows:
        cent = 1200 * log2((v + 20) / 8.17579892)
        if (b := floor(cent - floor(cent / 1200) * 1200 + 0.5)) < 1200:
            bins[u][b] += 1
    want = {}
    for q in (0, 50, 150):
        for r in bins:
            most = max(bins[q].total(), bins[r].total())
            sums = [sum(min(n, bins[r][(b + s) % 1200]) for b, n in bins[q].items()) for s in range(1200)]
            want[q, r] = (round(max(sums) / most, 6), sums.index(max(sums)))
    got = catalog.QUERIES["pch_best_shift"](spark, str(tmp_path)).collect()
    assert {(x.query_id, x.ref_id): (x.match, x["shift"]) for x in got} == want and max(s for _, s in want.values()) > 24
    assert sorted(x.rank for x in got if x.query_id == 50) == [1, 2, 3, 4, 5]


def test_pch_matches_rank_in_the_tasks(spark, tmp_path):
    rows = [(u, float(u % 7 * 31 + k * k * 3)) for u in (0, 7, 33, 50, 150) for k in range(6)]
    spark.createDataFrame(rows, "user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    x = catalog.QUERIES["pch_matches"](spark, str(tmp_path))
    assert "Window" not in x._jdf.queryExecution().executedPlan().toString()
    got = x.collect()
    assert len(got) == 15 and all(abs(r.ratio - 100 * 2 ** (r["shift"] / 1200)) < 1e-5 for r in got)
    for q in (0, 50, 150):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: (-r.match, r.ref_id))
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and mine[0].match == 1


def test_pch_matches_looks_ratios_up(spark, tmp_path):
    """The ratio of every shift, as computed, is the one of a table; no power and no rounding of it for each pair."""
    spark.createDataFrame([(u, float(v)) for u in (0, 50) for v in range(5, 560, 7 + u)], "user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    x = catalog.QUERIES["pch_matches"](spark, str(tmp_path))
    plan = x._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "power" not in plan and plan.count("round(") == 1
    every = spark.range(1200).select(F.round(F.lit(100.0) * F.pow(F.lit(2.0), F.col("id") / F.lit(1200.0)), 6).alias("r")).collect()
    assert [r.r for r in every] == [round(100 * 2 ** (i / 1200), 6) for i in range(1200)]
    got = x.collect()
    assert len(got) == 4 and all(r.ratio == every[r["shift"]].r for r in got)


def test_queries_held_out_of_the_index_are_tn(spark, tmp_path):
    lines = [(1, "q/7_0s-10s___echo.mp3", "a/7.mp3", 9), (2, "q/7_0s-10s___echo.mp3", "a/8.mp3", 4), (3, "q/7_5s-15s___echo.mp3", None, None), (4, "q/9_0s-10s___echo.mp3\t", None, None), (5, "q/9_5s-15s___echo.mp3", "a/8.mp3", 3)]
    spark.createDataFrame(lines, "line_id long, query_path string, ref_path string, match_score long").write.parquet(f"{tmp_path}/result_lines.parquet")
    spark.createDataFrame([(7, "a/7.mp3"), (70, "b/7.wav"), (8, " a/8.mp3"), (1, None)], "resource_id int, path string").write.parquet(f"{tmp_path}/resource_metadata.parquet")
    (r,) = catalog.QUERIES["evaluation_matrix"](spark, str(tmp_path)).collect()
    assert tuple(r) == ("echo", None, 4, 0.25, 0.25, 0.25, 0.25)


def test_each_copy_of_a_document_is_listed_and_a_hot_group_is_split(spark, tmp_path):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}" if i < 30 else f"u{i}") for i in range(300)] + [(300, None), (301, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    groups = defaultdict(list)
    for i, t in rows[:300]:
        groups[t].append(i)
    want = sorted((i, min(g), len(g)) for g in groups.values() if len(g) > 1 for i in g)
    found = catalog.QUERIES["dedup_exact_members"](spark, str(tmp_path))
    assert sorted((x.doc_id, x.first_key, x.members) for x in found.collect()) == want and len(want) > 100
    assert "LeftAnti" in found._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_results_are_printed_each(spark, tmp_path):
    row = ("q.wav", 0.0, 5.0, "r.wav", 3, 1.0, 6.0, 12, 1.0, 1.0, 0.5)
    kinds = "query_path string, query_start double, query_stop double, ref_path string, ref_id int, ref_start double, ref_stop double, match_score long, time_factor double, frequency_factor double, coverage double"
    spark.createDataFrame([(1, *row), (2, *row), (None, *row)], f"line_id long, {kinds}").write.parquet(f"{tmp_path}/dedup_lines.parquet")
    got = catalog.QUERIES["result_line_print"](spark, str(tmp_path)).collect()
    assert Counter(x.line_id for x in got) == Counter([1, 2, None]) and len({x.line for x in got}) == 1


def test_fallback_leaves_queries_with_results_alone(spark, monkeypatch):
    stored = spark.createDataFrame([(i * 10, 1, 100 + i + i * 7 % 4, 3) for i in range(40)], "hash bigint, resource_id int, t1 int, f1 int")
    asked = spark.createDataFrame([(q, i * 10, i, 3) for q in (5, 105, 205) for i in range(40)], "query_id int, hash bigint, t1 int, f1 int")
    kept = match.enough_hits(match.near_hash_join(asked, stored, core.SMALL), core.SMALL)
    monkeypatch.setattr(core, "_kept", lambda *_: kept)
    monkeypatch.setattr(core, "_results", lambda *_: spark.createDataFrame([(105, 1)], "query_id int, ref_id int"))
    assert sorted(x.query_id for x in core.histogram_fallback(spark, "").collect()) == [5, 205]


def test_prefixes_among_more_than_ten_thousand_words(spark):
    words = spark.range(10_500).select(F.format_string("w%05d", "id").alias("word")).union(spark.createDataFrame([("z",), ("z",), (None,), ("été",)], "word string"))
    prefixes = spark.createDataFrame([("",), ("w",), ("w10499",), ("w1049",), ("z",), ("ét",), ("zz",), (None,), ("z",)], "prefix string")
    want = {"": None, "w": None, "w10499": "w10499", "w1049": None, "z": "z", "ét": "été", "zz": None, None: None}
    got = names.complete(words, prefixes).collect()
    assert dict(map(tuple, got)) == want and len(got) == len(want)


def test_metadata_join_lists_few_pairs(spark, monkeypatch):
    """Only pairs that can align reach the join of hits, whose index names the query of each posting."""
    seen, join = [], core.match.near_hash_join
    monkeypatch.setattr(core.match, "near_hash_join", lambda prints, index, *rest: seen.append(index.columns) or join(prints, index, *rest))
    assert catalog.QUERIES["metadata_join"](spark, "/root/testdata/sf0.001").columns == ["query_id", "ref_id", "ref_path", "rank"]
    assert "query_id" in seen[0]


def test_metadata_join_makes_few_hits(monkeypatch):
    """A hash that fills a long reference: hits are counted, and made only of the first and last part, beside those near a line; prints at one time and repeated ones included."""
    rng = np.random.default_rng(5)
    song = 200 + 80 * np.arange(60)
    hot = pa.table({"ref_id": np.full(60_000, 1, np.int32), "hash": rng.choice([1000, 1001, 2000], 60_000), "t1": np.sort(rng.integers(0, 3_000_000, 60_000)).astype(np.int32)})
    rest = pa.table({"ref_id": np.repeat(np.array([7, 9], np.int32), 62), "hash": np.tile(np.append(50_000 + 7 * np.arange(60), [1000, 2000]), 2), "t1": np.append(np.append(song, [300, 900]), np.append(song * 1.1 + 4000, [5, 6])).astype(np.int32)})
    asked = pa.table({"query_id": np.full(63, 7, np.int32), "hash": np.append(50_000 + 7 * np.arange(60), [1000, 1001, 2000]), "times": np.append(np.ones(60, np.int64), [2, 3, 1]), "qt": np.append(song, [1000, 1000, 280]).astype(np.int32)})
    made, expanded = [], blocks._expanded
    monkeypatch.setattr(blocks, "_expanded", lambda first, n: made.append(int(n.sum())) or expanded(first, n))
    found = blocks.lines(asked, pa.concat_tables([hot, rest]), core.CONSTANT_Q)
    assert sorted(map(tuple, zip(*map(np.ndarray.tolist, found), strict=True))) == [(7, 7)]
    assert sum(made) < 110_000  # of 220,000 hits
