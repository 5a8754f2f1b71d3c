import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from echolattice.config import CONSTANT_Q, FFT
from echolattice.operators import blocks, dedup, evaluate, fingerprints, index, match, monitor, pch, peaks

SMALL = CONSTANT_Q.but(freq_max_filter=5, time_max_filter=9, sample_rate=128)


def grid(spark, cells, frames, bins, rid=1):
    rows = [(rid, t, f, cells.get((t, f), 0.01 * ((t * 7 + f * 3) % 5 + 1))) for t in range(frames) for f in range(bins)]
    return spark.createDataFrame(rows, "resource_id int, t int, f int, m double")


def test_min_max_filter_example(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 2, 3, 7, 8, -7, 12, 13, 7])], "g int, i int, v double")
    out = peaks.min_max_filter(df, ["g"], "i", "v", 3).orderBy("i").collect()
    assert [r.high for r in out] == [2, 3, 7, 8, 8, 12, 13, 13, 13] and [r.low for r in out] == [1, 1, 2, 3, -7, -7, -7, 7, 7]
    assert peaks.min_max_filter(df, ["g"], "i", "v", 3, clamp=False).count() == 7
    with pytest.raises(ValueError):
        peaks.min_max_filter(df, ["g"], "i", "v", 4)


def test_first_frame_with_a_whole_window(spark):
    for t, found in ((3, False), (4, True)):
        hits = peaks.event_points(grid(spark, {(t, 10): 9.0}, 20, 20), SMALL, 20).where("m > 9").collect()
        assert bool(hits) == found


def test_time_window_is_asymmetric(spark):
    for other, found in ((14, True), (13, False), (6, False)):
        hits = peaks.event_points(grid(spark, {(10, 10): 9.0, (other, 10): 10.0}, 30, 20), SMALL, 20).where("t = 10 AND f = 10").collect()
        assert bool(hits) == found, other


def test_magnitude_is_the_sum_of_nine(spark):
    x = grid(spark, {(10, 10): 9.0}, 30, 20)
    got = peaks.event_points(x, SMALL, 20).where("t = 10 AND f = 10").first().m
    want = x.where("t BETWEEN 9 AND 11 AND f BETWEEN 9 AND 11").agg(F.sum("m")).first()[0]
    assert abs(got - want) < 1e-9
    corner = peaks.magnitude_3x3(x).where("t = 0 AND f = 0").first().m9
    assert abs(corner - x.where("t < 2 AND f < 2").agg(F.sum("m")).first()[0]) < 1e-9


def test_log_frequency_windows():
    rows = peaks.log_frequency_windows(FFT)
    assert len(rows) == 512 - 9 and all(9 <= a <= f and b <= 512 for f, a, b in rows)
    widths = [b - a for _, a, b in rows]
    assert widths[300] > 3 * widths[20]


def test_pack_equals_brute_force(spark):
    r = random.Random(2)
    points = sorted({(r.randrange(2), r.randrange(120), r.randrange(200)) for _ in range(90)})
    c = CONSTANT_Q
    ok = lambda a, b: a[0] == b[0] and 2 <= b[1] - a[1] <= 33 and 1 <= abs(a[2] - b[2]) <= 128
    want = sorted((a[0], *a[1:], *b[1:], *d[1:]) for a, b, d in product(points, points, points) if ok(a, b) and ok(b, d))
    df = spark.createDataFrame([(*p, 1.0) for p in points], "resource_id int, t int, f int, m double")
    got = sorted(tuple(x) for x in fingerprints.pack(df, c).select("resource_id", "t1", "f1", "t2", "f2", "t3", "f3").collect())
    assert got == want and len(got) > 100
    two = fingerprints.pack(df, c.but(points_per_print=2)).collect()
    assert len(two) == sum(ok(a, b) for a, b in product(points, points)) and all(x.t3 == x.t2 and x.f3 == x.f2 for x in two)


def prints(spark, rows):
    return spark.createDataFrame(rows, "query_id int, hash bigint, t1 int, f1 int")


def postings(spark, rows):
    return spark.createDataFrame(rows, "hash bigint, resource_id int, t1 int, f1 int")


def test_near_hash(spark):
    idx = postings(spark, [(98, 1, 5, 1), (102, 2, 6, 1), (103, 3, 7, 1), (97, 4, 8, 1), (None, 5, 1, 1)])
    q = prints(spark, [(9, 100, 1, 1), (9, 100, 4, 2), (9, None, 4, 2)])
    got = sorted((r.ref_id, r.query_time, r.query_f1, r.delta_t) for r in match.near_hash_join(q, idx, CONSTANT_Q).collect())
    assert got == [(1, 4, 2, 1), (1, 4, 2, 1), (2, 4, 2, 2), (2, 4, 2, 2)]  # repeated prints repeat hits, the last print's time holds
    avoid = spark.createDataFrame([(9, 1)], "query_id int, resource_id int")
    assert {r.ref_id for r in match.near_hash_join(q, idx, CONSTANT_Q, avoid).collect()} == {2}


def test_single_query_time_gives_no_result(spark):
    idx = postings(spark, [(h, 1, 5, 1) for h in range(0, 200, 10)])
    q = prints(spark, [(9, h, 5, 1) for h in range(0, 200, 10)])
    assert match.query(q, idx, CONSTANT_Q).count() == 0


def linear(spark, slope, n=40, start=100, f=(30, 30)):
    step = 200
    idx = postings(spark, [(i * 10, 1, start + round(i * step * (1 + slope)), f[0]) for i in range(n)])
    return match.query(prints(spark, [(9, i * 10, i * step, f[1]) for i in range(n)]), idx, CONSTANT_Q).collect()


def test_speed_and_pitch(spark):
    (r,) = linear(spark, 0.0, f=(33, 30))
    assert r.time_factor == 1 and abs(r.freq_factor - 2 ** (3 / 85)) < 1e-9 and r.score == 40 and abs(r.ref_start - r.query_start - 0.8) < 1e-9
    (r,) = linear(spark, 0.05)
    assert abs(r.time_factor - 1 / 0.95) < 1e-3
    assert linear(spark, 0.4) == [] and linear(spark, 0.0, n=9) == []


def test_empty_results_and_metadata(spark):
    found = match.ranked(match.results(match.near_hash_join(prints(spark, [(1, 5, 1, 1)]), postings(spark, []), CONSTANT_Q), CONSTANT_Q), 5)
    rows = match.with_metadata(match.with_empty(spark.createDataFrame([(1, "p")], "query_id int, query_path string"), found), spark.createDataFrame([], "resource_id int, path string")).collect()
    assert len(rows) == 1 and rows[0].ref_id is None and rows[0].score == -1 and rows[0].coverage == 0 and rows[0].ref_path == "metadata unavailable!"


def test_set_and_bag_and_delete(spark):
    idx, more = postings(spark, [(10, 666, 77, 1), (10, 666, 77, 1)]), postings(spark, [(10, 666, 77, 1), (200, 666, 78, None)])
    assert index.insert_set(idx, more).count() == 2 and index.insert_bag(idx, more).count() == 4
    left = index.delete(index.insert_set(idx, more), postings(spark, [(200, 666, 78, None)]))
    assert [tuple(r) for r in left.collect()] == [(10, 666, 77, 1)]


def test_stored_index_lifecycle(spark, tmp_path):
    meta = "resource_id int, path string, duration double, num_fingerprints bigint"
    ix = index.StoredIndex(spark, f"file://{tmp_path}/ix")
    assert ix.postings.count() == 0 and ix.metadata.count() == 0
    a = postings(spark, [(2**33 + 1, 10, 1, 1), (5, 10, 2, 2)])
    ix.store(a, spark.createDataFrame([(10, "/test/path", 100.0, 2000)], meta))
    ix.store(a, spark.createDataFrame([(10, "/test/path", 100.0, 2000)], meta))
    assert ix.postings.count() == 2 and tuple(ix.metadata.first()) == (10, "/test/path", 100.0, 2000)
    ix.load(postings(spark, [(5, 11, 1, 1), (6, 12, 1, 1), (7, 10, 1, 1)]), spark.createDataFrame([(11, "b", 50.0, 1), (10, "x", 1.0, 1)], meta))
    assert sorted(r.resource_id for r in ix.postings.collect()) == [10, 10, 11]
    s = ix.statistics().first()
    assert (s.resources, s.postings, s.total_prints, s.max_path, s.min_path) == (2, 3, 2001, "/test/path", "b")
    ix.delete(a, spark.createDataFrame([(10,)], "resource_id int"))
    assert [r.resource_id for r in ix.postings.collect()] == [11] and ix.metadata.count() == 1
    ix.clear()
    assert ix.postings.count() == 0


def files_of(path, *more):
    return sorted(p for p in path.glob("/".join(more)) if p.suffix == ".parquet")


def test_a_hot_hash_spreads_over_files_and_lookups_read_only_their_parts(spark, tmp_path):
    meta = spark.createDataFrame([(1, "a", 9.0, 1)], "resource_id int, path string, duration double, num_fingerprints bigint")
    hot, part = 3 << 28, 1 << 28
    ix = index.StoredIndex(spark, f"file://{tmp_path}/ix")
    ix.store(postings(spark, [(hot, 1, t, 5) for t in range(4000)] + [(k * part + 9, 1, k, 5) for k in range(20)] + [(None, 1, 2, 3), (4, None, 2, 3)]), meta)
    assert ix.postings.count() == 4020 and len(files_of(tmp_path, "ix/postings/part=3/seg=*/*.parquet")) >= 3
    asked = prints(spark, [(9, hot + 2, 1, 1), (9, 7 * part + 9, 2, 2)])
    assert match.near_hash_join(asked, ix.postings, CONSTANT_Q).count() == 4001
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = match.near_hash_join(asked, ix.postings, CONSTANT_Q)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", before)
    (scan,) = [line for line in plan.splitlines() if "FileScan" in line and "/postings" in line]
    assert re.search(r"PartitionFilters: .*part#\d+ IN \((3,7|7,3)\).*PushedFilters", scan)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_write_that_fails_leaves_the_index(spark, tmp_path, monkeypatch):
    meta = "resource_id int, path string, duration double, num_fingerprints bigint"
    ix = index.StoredIndex(spark, f"file://{tmp_path}/ix")
    ix.store(postings(spark, [(5, 1, 1, 1), (1 << 30, 1, 2, 2)]), spark.createDataFrame([(1, "a", 9.0, 2)], meta))
    before = [sorted(map(tuple, x.collect())) for x in (ix.postings, ix.metadata)]

    def fail(self, manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(index.Versioned, "_commit", fail)
        for act in (lambda: ix.store(postings(spark, [(6, 2, 1, 1)]), spark.createDataFrame([(2, "b", 9.0, 1)], meta)), lambda: ix.delete(postings(spark, [(5, 1, 1, 1)]), spark.createDataFrame([(1,)], "resource_id int"))):
            with pytest.raises(OSError):
                act()
    assert [sorted(map(tuple, x.collect())) for x in (ix.postings, ix.metadata)] == before
    kept = files_of(tmp_path, "ix/postings/part=4/seg=*/*.parquet")
    ix.delete(postings(spark, [(5, 1, 1, 1)]), spark.createDataFrame([(9,)], "resource_id int"))
    assert [tuple(r)[:4] for r in ix.postings.collect()] == [(1 << 30, 1, 2, 2)] and files_of(tmp_path, "ix/postings/part=4/seg=*/*.parquet") == kept
    ix.store(postings(spark, [(5, 1, 1, 1), (6, 2, 1, 1)]), spark.createDataFrame([(2, "b", 9.0, 1)], meta))
    rows = sorted(tuple(r)[:4] for r in ix.postings.collect())
    ix.compact()
    assert sorted(tuple(r)[:4] for r in ix.postings.collect()) == rows == [(5, 1, 1, 1), (6, 2, 1, 1), (1 << 30, 1, 2, 2)] and ix.metadata.count() == 2
    assert len(list(tmp_path.glob("ix/postings/part=*/seg=*"))) == 2 and len(list(tmp_path.glob("ix/metadata/seg=*"))) == 1


def test_pairs_are_compared_on_their_own(spark):
    """The second recording of a pair meets the first only, not the equal first recordings of other pairs."""
    x = spark.createDataFrame([(r, h * 10, h * 200 + r, 1) for r in (1, 2, 3) for h in range(40)] + [(4, 9999, 1, 1)], "resource_id int, hash bigint, t1 int, f1 int")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, 1), (1, 2)], "first_id int, second_id int")
    got = sorted(map(tuple, dedup.shared_percent(pairs, x, CONSTANT_Q).collect()))
    assert [g[:2] for g in got] == [(1, 2), (2, 1), (3, 3), (4, 1)] and got[3][2] == 0 and got[0][2] == got[1][2] == got[2][2] > 30


def test_upsert_and_skip(spark):
    meta = "resource_id int, path string, duration double, num_fingerprints bigint"
    old, new = spark.createDataFrame([(1, "a", 1.0, 1), (2, "b", 2.0, 2)], meta), spark.createDataFrame([(2, "c", 3.0, 3)], meta)
    assert sorted(map(tuple, index.upsert_metadata(old, new).collect())) == [(1, "a", 1.0, 1), (2, "c", 3.0, 3)]
    ids = spark.createDataFrame([(1,), (3,)], "resource_id int")
    assert [r[0] for r in index.not_stored(ids, old).collect()] == [3] and [r.path for r in index.lookup(old, ids).orderBy("resource_id").collect()] == ["a", None]


@pytest.mark.parametrize(("duration", "starts"), [(25.0, []), (25.1, [0]), (45.0, [0]), (45.1, [0, 20]), (None, []), (0.0, [])])
def test_window_counts(spark, duration, starts):
    df = spark.createDataFrame([(1, duration)], "resource_id int, duration double")
    assert [r.start for r in monitor.windows(df).orderBy("start").collect()] == starts


def test_windows_are_closed(spark):
    c = CONSTANT_Q.but(sample_rate=128)
    x = spark.createDataFrame([(1, 5, t, 1) for t in (0, 20, 22, 25, 26, 45)], "resource_id int, hash bigint, t1 int, f1 int")
    got = monitor.in_windows(x, spark.createDataFrame([(1, 100.0)], "resource_id int, duration double"), c).groupBy("query_id.start").count().collect()
    assert dict(got)[0.0] == 4 and dict(got)[20.0] == 5


@pytest.mark.parametrize(("window", "overlap"), [(25.0, 5.0), (10.0, 7.5), (0.7, 0.1)])
def test_prints_meet_the_windows_that_hold_them(spark, window, overlap):
    """As comparing every print with every window does, at steps that floats can't hold exactly too."""
    c = CONSTANT_Q.but(sample_rate=1280)
    x = spark.createDataFrame([(r, 5, t, 1) for r, n in ((1, 900), (2, 240), (3, 100), (4, 900)) for t in range(n)], "resource_id int, hash bigint, t1 int, f1 int")
    durations = spark.createDataFrame([(1, 90.0), (2, 24.0), (3, 100.0), (4, None)], "resource_id int, duration double")
    spans = monitor.windows(durations, window, overlap)
    every = x.join(spans, "resource_id").where(match.seconds(F.col("t1"), c).between(F.col("start"), F.col("stop")))
    want = sorted((r.resource_id, r.start, r.t1) for r in every.collect())
    got = sorted((r.query_id.resource_id, r.query_id.start, r.t1) for r in monitor.in_windows(x, durations, c, window, overlap).collect())
    assert got == want and len(got) > 500


def test_windows_without_a_result_have_an_empty_row(spark):
    c = CONSTANT_Q.but(sample_rate=128)
    x = spark.createDataFrame([(1, h * 10, h, 1) for h in range(25)], "resource_id int, hash bigint, t1 int, f1 int")
    index_ = x.withColumn("resource_id", F.explode(F.array(F.lit(7), F.lit(8))))
    durations = spark.createDataFrame([(1, 66.0), (2, 30.0)], "resource_id int, duration double")
    got = sorted((r.resource_id, r.start, r.ref_id or 0, r.score > 0, r.label) for r in monitor.monitor(x, index_, durations, c, empty=True).collect())
    assert got == [(1, 0.0, 7, True, "1-0.0_25.0"), (1, 0.0, 8, True, "1-0.0_25.0"), (1, 20.0, 0, False, "1-20.0_45.0"), (1, 40.0, 0, False, "1-40.0_65.0"), (2, 0.0, 0, False, "2-0.0_25.0")]


def test_histograms(spark):
    hz = lambda cent: 8.17579892 * 2 ** (cent / 1200)
    x = spark.createDataFrame([(1, hz(6000)), (1, hz(6000.2)), (1, hz(7199.8)), (1, hz(6700)), (2, 0.0)], "resource_id int, hz double")
    assert sorted(map(tuple, pch.pitch_class_histogram(x).collect())) == [(1, 0, 2), (1, 700, 1)]
    q = pch.dense(spark.createDataFrame([(1, 0, 3), (1, 7, 5)], "resource_id int, bin int, cnt bigint"), 24)
    r = pch.dense(spark.createDataFrame([(2, 4, 3), (2, 11, 5), (3, 0, 8)], "resource_id int, bin int, cnt bigint"), 24)
    want = {(1, 2): (1.0, 4), (1, 3): (5 / 8, 17)}
    for rows in (256, 1):
        assert {(x.query_id, x.ref_id): (x.match, x.shift) for x in pch.shift_matches(q, r, rows).collect()} == want
    assert pch.shift_matches(q.limit(0), r).count() == 0 and pch.shift_matches(q, r.limit(0)).count() == 0


def test_shifts_in_blocks_equal_every_shift_tried(spark):
    r = random.Random(3)
    hist = lambda: [r.choice([0, 0, 0, r.randrange(9)]) for _ in range(24)]
    queries, refs = {i: hist() for i in range(7)}, {i: hist() for i in range(40, 63)}
    queries[3] = refs[44] = [0] * 24
    df = lambda x: spark.createDataFrame(list(x.items()), "resource_id int, bins array<bigint>")
    want = {}
    for (i, q), (j, f) in product(queries.items(), refs.items()):
        sums = [sum(min(a, f[(k + s) % 24]) for k, a in enumerate(q)) for s in range(24)]
        most = max(sum(q), sum(f))
        want[i, j] = (max(sums) / most if most else 0.0, sums.index(max(sums)))
    got = pch.shift_matches(df(queries), df(refs), 4).collect()
    assert {(x.query_id, x.ref_id): (x.match, x.shift) for x in got} == want and len(got) == 161
    best = pch.ranked(pch.shift_matches(df(queries), df(refs)), 2).collect()
    assert len(best) == 14 and {x["rank"] for x in best} == {1, 2}


def test_same_print_equals_every_pair(spark):
    r = random.Random(5)
    x = spark.createDataFrame([(i, r.choice([7, 7, 8, None]), r.randrange(1000)) for i in range(200)], "resource_id int, hash bigint, t1 int")
    rows = x.collect()
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] is not None and a[1] == b[1] and abs(a[2] - b[2]) < 100)
    assert sorted((p.a_resource_id, p.b_resource_id) for p in fingerprints.same_print(x, x).collect()) == want and len(want) > 500


def test_blocks_of_frames_change_nothing(spark, monkeypatch):
    r = random.Random(4)
    cells = {(t, f): r.random() for t in range(75) for f in range(12)}
    x = grid(spark, cells, 75, 12)
    run = lambda: (sorted(map(tuple, peaks.event_points(x, SMALL, 12).collect())), sorted(map(tuple, peaks.horizontal_max(peaks.vertical_max(x, 5), 9).collect())), sorted(map(tuple, peaks.magnitude_3x3(x).collect())))
    whole = run()
    monkeypatch.setattr(peaks, "BLOCK", 10)
    assert run() == whole and len(whole[0]) > 5 and len(whole[1]) == len(whole[2]) == 900
    with pytest.raises(ValueError):
        peaks.horizontal_max(peaks.vertical_max(x, 5), 11)


def test_content_duplicates(spark):
    x = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "k int, c string")
    assert [(r.first_key, r.members) for r in dedup.content_groups(x, "k", "c").collect()] == [(1, 2)]
    assert sorted(r.k for r in dedup.content_members(x, "k", "c").collect()) == [1, 2]


def test_confusion(spark):
    rows = [("7_0s-10s.mp3", "x/7.mp3", 1, True), ("7_0s-10s.mp3", "x/8.mp3", 2, True), ("8_0s-10s___echo.mp3", "x/7.mp3", 1, True), ("9_0s-10s___echo.mp3", None, 1, False), ("9_0s-10s___speed_up_1.02.mp3", None, 1, True)]
    got = {(r.modification, r.factor): (r.queries, r.tp, r.fp, r.fn, r.tn) for r in evaluate.confusion(spark.createDataFrame(rows, "query_path string, ref_path string, rank int, in_index boolean")).collect()}
    assert got[("reference", None)] == (1, 1, 0, 0, 0) == got[("pitch_shift", 1.0)] and got[("echo", None)] == (2, 0, 0.5, 0, 0.5) and got[("speed_up", 1.02)] == (1, 0, 0, 1, 0)


def test_acceptable_and_symmetric(spark):
    rows = [(1, "a.wav", "b.wav", 0.0, 5.0, 40, 0.5), (2, "b.wav", "a.wav", 0.0, 5.0, 40, 0.9), (3, "a.wav", "x/a.mp3", 0.0, 5.0, 40, 0.5), (4, "a.wav", "c.wav", 0.0, 2.0, 40, 0.5), (5, "a.wav", "d.wav", 0.0, 5.0, 14, 0.5)]
    x = spark.createDataFrame(rows, "line_id int, query_path string, ref_path string, query_start double, query_stop double, match_score bigint, coverage double")
    assert [r.line_id for r in evaluate.acceptable(x).collect()] == [1] and sorted(r.line_id for r in evaluate.acceptable(x, last_is_covered=True).collect()) == [1, 2]
    assert {r.line_id for r in evaluate.symmetric_pairs(x).where("symmetric").collect()} == {1, 2}


def test_fallback_only_without_results(spark):
    idx = postings(spark, [(i * 10, 1, 100 + i * 200 + (i * 7) % 4, 3) for i in range(40)])
    q = prints(spark, [(9, i * 10, i * 200, 3) for i in range(40)])
    hits = match.enough_hits(match.near_hash_join(q, idx, CONSTANT_Q), CONSTANT_Q)
    none = spark.createDataFrame([], "query_id int")
    (r,) = match.histogram_fallback(hits, none, CONSTANT_Q).collect()
    assert r.time_factor == 1 and r.score == 40
    assert match.histogram_fallback(hits, spark.createDataFrame([(9,)], "query_id int"), CONSTANT_Q).count() == 0


def test_counts_equal_the_listed_hits(spark):
    r = random.Random(8)
    idx = postings(spark, [(r.randrange(40), r.randrange(4), i, 1) for i in range(300)])
    q = prints(spark, [(r.randrange(3), r.choice([None, *range(40)]), i, 1) for i in range(60)])
    listed = match.near_hash_join(q, idx, CONSTANT_Q).groupBy("query_id", "ref_id").count().where("count >= 10")
    assert sorted(map(tuple, match.hit_counts(q, idx, CONSTANT_Q).collect())) == sorted(map(tuple, listed.collect()))


def test_query_by_blocks_lists_only_pairs_on_a_line(spark, monkeypatch):
    """A hot hash gives every pair hits; with blocks only pairs that can align are listed, with the results of listing all."""
    rng = random.Random(3)
    rows = [(h, r, rng.randrange(3000, 4000), rng.randrange(500)) for r in range(60) for h in [1000] * 12 + [rng.choice((1001, 2000, 3000, 3001, 9000 + 10 * r)) for _ in range(25)]]
    song = [(50_000 + 7 * k, 200 + 80 * k, 100) for k in range(80)]
    rows += [(h, 7, t, f) for h, t, f in song] + [(h + 1, 9, t + 12_345, f + 2) for h, t, f in song] + [(h, 11, int(t * 1.1), f) for h, t, f in song] * 2
    idx = spark.createDataFrame(rows, "hash bigint, resource_id int, t1 int, f1 int")
    q = idx.where("resource_id IN (3, 7, 11)").withColumnRenamed("resource_id", "query_id")
    want = sorted(map(tuple, match.query(q, idx, CONSTANT_Q).collect()))
    assert {x[:2] for x in want} >= {(7, 7), (7, 9), (11, 7)}
    for name, n in (("CHUNK", 500_000), ("CHUNK", 50), ("QUERIES", 1)):
        monkeypatch.setattr(blocks, name, n)
        pairs = [tuple(r) for r in blocks.aligned_pairs(q, idx, CONSTANT_Q).collect()]
        assert {x[:2] for x in want} <= set(pairs) and len(pairs) == len(set(pairs)) < 20
    assert sorted(map(tuple, match.query(q, idx, CONSTANT_Q, blocks=True).collect())) == want
    unknown = idx.withColumn("t1", F.expr("IF(resource_id = 9 AND hash % 3 = 0, NULL, t1)"))
    assert (7, 9) in {tuple(r) for r in blocks.aligned_pairs(q, unknown, CONSTANT_Q).collect()}
    assert blocks.aligned_pairs(q.limit(0), idx, FFT).count() == 0


def test_hit_counts_shuffle_no_pairs(spark, monkeypatch):
    """Counted in blocks, whichever hashes go through the matrix product."""
    rng = random.Random(5)
    rows = [(rng.choice((None, 100, 100, 101, 104, 500 + r)), rng.choice((None, r)), t, 1) for r in range(50) for t in range(40)]
    idx = spark.createDataFrame(rows, "hash bigint, resource_id int, t1 int, f1 int")
    q = idx.where("resource_id % 7 = 0").withColumnRenamed("resource_id", "query_id")
    want = sorted(map(tuple, match.near_hash_join(q, idx.where("resource_id IS NOT NULL"), CONSTANT_Q).groupBy("query_id", "ref_id").count().where("count >= 10").collect()))
    for dense, cells, queries in ((64, 1_000_000, 512), (0, 7, 3), (10**12, 7, 2)):
        monkeypatch.setattr(blocks, "DENSE", dense)
        monkeypatch.setattr(blocks, "CELLS", cells)
        monkeypatch.setattr(blocks, "QUERIES", queries)
        got = match.hit_counts(q, idx, CONSTANT_Q)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 300
    # nothing is shuffled after the blocks were worked on, so no pair is
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "Exchange" not in plan[: plan.index("CoGroup")]


def test_histograms_are_ranked_without_a_shuffle_of_results(spark, monkeypatch):
    """Large counts, ties, repeated and empty histograms; ranks of the tasks equal those of the window."""
    r = random.Random(6)
    for high in (3, 300, 90_000):
        rows = [(i % 33, b, r.choice([1, 2, high])) for i in range(35) for b in range(24) if i != 4 and r.random() < 0.4]
        hist = spark.createDataFrame(rows, "resource_id int, bin int, cnt bigint").groupBy("resource_id", "bin").agg(F.sum("cnt").alias("cnt"))
        x, full = pch.sparse(hist, 24), pch.dense(hist, 24)
        want = {(a.query_id, a.ref_id): (a.match, a["shift"], a["rank"]) for a in pch.ranked(pch.shift_matches(full.where("resource_id % 5 = 0"), full)).collect()}
        bins = {a.resource_id: a.bins for a in full.collect()}
        for (i, j), (m, s, _) in want.items():
            sums = [sum(min(v, bins[j][(k + t) % 24]) for k, v in enumerate(bins[i])) for t in range(24)]
            assert (max(sums) / max(sum(bins[i]), sum(bins[j])), sums.index(max(sums))) == (m, s)
        got = pch.ranked_matches(x.where("resource_id % 5 = 0"), x)
        assert {(a.query_id, a.ref_id): (a.match, a["shift"], a["rank"]) for a in got.collect()} == want and len(want) == 7 * 32
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan[: plan.index("CoGroup")]
    monkeypatch.setattr(pch, "MOST_REFS", 10)
    assert {(a.query_id, a.ref_id): (a.match, a["shift"], a["rank"]) for a in pch.ranked_matches(x.where("resource_id % 5 = 0"), x).collect()} == want
