import math
import random

import pytest
from pyspark.sql import functions as F

from echolattice.config import EngineConfig
from echolattice.functions import hashing, names, units
from echolattice.functions.murmur import file_hash, file_window, murmur3_32, murmur3_32_many, murmur3_128, murmur32


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def print_hash(p, kind):
    t1, f1, m1, t2, f2, m2, t3, f3, m3 = p
    low = (64 * (t2 - t1) // (t3 - t1)) & 63 if kind == "constant_q" else (t3 - t1) & 63
    tests = [f1 > f2, f2 > f3, f3 > f1, m1 > m2, m2 > m3, m3 > m1, t2 - t1 > t3 - t2, abs(f2 - f1) > abs(f3 - f2)]
    h = low | sum(x << (6 + i) for i, x in enumerate(tests))
    return h | (((f1 >> (5 if kind == "constant_q" else 1)) & 255) << 14) | (((abs(f2 - f1) >> 2) & 63) << 22) | (((abs(f3 - f2) >> 2) & 63) << 28)


def test_hashes_bit_by_bit(spark):
    r = random.Random(5)
    rows = []
    for _ in range(300):
        t1 = r.randrange(10_000)
        t2 = t1 + r.randrange(2, 34)
        t3 = t2 + r.randrange(2, 34)
        f = [r.randrange(512)]
        f += [max(0, f[0] + r.choice([-1, 1]) * r.randrange(1, 129))]
        f += [max(0, f[1] + r.choice([-1, 1]) * r.randrange(1, 129))]
        m = [r.random() for _ in range(3)]
        rows.append((t1, f[0], m[0], t2, f[1], m[1], t3, f[2], m[2]))
    df = spark.createDataFrame(rows, "t1 int, f1 int, m1 double, t2 int, f2 int, m2 double, t3 int, f3 int, m3 double")
    for x in df.select("*", hashing.hash_constant_q().alias("a"), hashing.hash_fft().alias("b")).collect():
        assert x.a == print_hash(tuple(x)[:9], "constant_q") and x.b == print_hash(tuple(x)[:9], "fft")
        assert 0 <= x.a < 1 << 34 and 0 <= x.b < 1 << 34


def test_longest_gap_wraps_in_the_fft_hash(spark):
    df = spark.createDataFrame([(0, 5, 1.0, 33, 9, 1.0, 66, 5, 1.0), (0, 5, 1.0, 0, 9, 1.0, 0, 5, 1.0)], "t1 int, f1 int, m1 double, t2 int, f2 int, m2 double, t3 int, f3 int, m3 double")
    rows = df.select((hashing.hash_fft() % 64).alias("low"), hashing.hash_constant_q().alias("a")).collect()
    assert rows[0].low == 66 & 63 and rows[1].a is None


def test_morton_and_hamming(spark):
    r = random.Random(1)
    for x, y in [(0, 0), (65535, 0), (0, 65535), *((r.randrange(65536), r.randrange(65536)) for _ in range(5))]:
        code = hashing.morton_encode(F.lit(x), F.lit(y))
        a, b = hashing.morton_decode(code)
        got = one(spark, code=code, a=a, b=b)
        assert (got.a, got.b) == (x, y) and got.code == sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(16))
    bits = hashing.hamming_bits(F.array(*(F.lit(v) for v in (True, False, True))), F.array(F.lit(True), F.lit(True)))
    got = one(spark, i=hashing.hamming(F.lit(-1), F.lit(0), 32), l=hashing.hamming(F.lit(-1).cast("bigint"), F.lit(1).cast("bigint")), b=bits)
    assert (got.i, got.l, got.b) == (32, 63, 1)


def test_murmur_known_values(spark):
    assert murmur3_32(b"") == 0 and murmur3_32(b"", 1) == 0x514E28B7
    assert murmur3_32(b"hello") & 0xFFFFFFFF == 0x248BFA47
    assert murmur3_32(b"The quick brown fox jumps over the lazy dog", 0x9747B28C) & 0xFFFFFFFF == 0x2FA826CD
    a, b = murmur3_128(b"The quick brown fox jumps over the lazy dog")
    assert (a & (2**64 - 1), b & (2**64 - 1)) == (0xE34BBC7BBC071B6C, 0x7A433CA9C49A9347)
    df = spark.createDataFrame([("hello",), (None,)], "s string")
    assert [x[0] for x in df.select(murmur32(F.col("s"))).collect()] == [0x248BFA47, None]
    assert [x[0] for x in df.select(file_hash(F.col("s"))).collect()] == [murmur3_32(b"hello"), 0]
    assert len(file_window(b"x" * 1_000_000)) == 65_536 and file_window(b"abc") == b"abc"


def test_murmur_of_a_batch_equals_one_by_one():
    r = random.Random(1)
    values = [r.randbytes(r.choice([0, 1, 2, 3, 4, 5, 7, 8, 100, 1000, r.randrange(70_000)])) for _ in range(200)]
    for seed, at_once in ((0, 1 << 21), (5, 300), (2**32 - 1, 1)):
        assert murmur3_32_many(values, seed, at_once).tolist() == [murmur3_32(v, seed) for v in values]
    assert len(murmur3_32_many([])) == 0


def test_identifier_and_paths(spark):
    got = one(
        spark, a=names.identifier(F.lit("/x/12345.mp3"), F.lit(7)), b=names.identifier(F.lit("/x/song.mp3"), F.lit(2_035_021_894)), c=names.identifier(F.lit("/x/song.mp3"), F.lit(-7)), e=names.identifier(F.lit("/x/12345"), F.lit(7)), f=names.identifier(F.lit("99999999999.mp3"), F.lit(8)), g=names.identifier(F.lit("12.34.mp3"), F.lit(8)), i=names.identifier(F.lit("12345."), F.lit(8)), d=names.identifier(F.lit("ab"), F.lit(0)),
        base=names.basename(F.lit("/x/a.b.wav")), bare=names.basename(F.lit("/x.y/a")), ext=names.extension(F.lit("/x.y/a")), folder=names.folder(F.lit("/x/y/a.wav")), home=names.expand_home(F.lit("~/a"), "/home/u"), both=names.combine(F.lit("a"), F.lit("b")),
    )
    half = (2**31 - 1) // 2
    assert (got.a, got.b, got.c, got.d) == (12345, half + 1_017_510_947, half - 3, half + (97 * 31 + 98) // 2) and (got.e, got.f, got.g, got.i) == (half + 3, half + 4, half + 4, half + 4)
    assert (got.base, got.bare, got.ext, got.folder, got.home, got.both) == ("a.b", "a", "", "/x/y", "/home/u/a", "a/b")


def test_query_names(spark):
    p = F.lit("/q/1051039_34s-54s.mp3")
    start, stop = names.query_range(p)
    got = one(spark, i=names.query_id(p), a=start, b=stop, none=names.query_id(F.lit("x.mp3")))
    assert (got.i, got.a, got.b, got.none) == (1051039, 34, 54, None)
    for name, want in {"7_3s-13s.mp3": ("7", 3, 13, "reference", None), "7_3s-13s___speed_up_0.84.mp3": ("7", 3, 13, "speed_up", 0.84), "7_3s-13s___band_passed_2000Hz.mp3": ("7", 3, 13, "band_passed_2000Hz", None), "7_3s-13s___echo.mp3": ("7", 3, 13, "echo", None)}.items():
        assert tuple(one(spark, **names.evaluation_name(F.lit(name)))) == want
    assert one(spark, a=names.window_label(F.lit("p"), F.lit(0), F.lit(25.0)), b=names.modification_label(F.lit("echo")), c=names.modification_label(F.lit("?")))[:] == ("p-0.0_25.0", "Echo", "?")


def test_prefixes(spark):
    words = spark.createDataFrame([("store",), ("stats",), ("query",)], "word string")
    got = dict(names.complete(words, spark.createDataFrame([("q",), ("st",), ("x",)], "prefix string")).collect())
    assert got == {"q": "query", "st": None, "x": None}


def test_pitch_units(spark):
    got = one(spark, key=units.hertz_to_midi_key(F.lit(440.0)), hz=units.midi_key_to_hertz(F.lit(69)), out=units.midi_key_to_hertz(F.lit(128)), cent=units.ratio_to_cent(F.lit(2.0)), rel=units.hertz_to_relative_cent(F.lit(8.17579892 * 2**3.5)), zero=units.hertz_to_absolute_cent(F.lit(0.0)), back=units.convert_pitch(F.lit(69.0), "midi_cent", "absolute_cent"), ratio=units.cent_to_ratio(F.lit(1200.0)))
    assert (got.key, got.hz, got.out, got.cent, got.zero, got.ratio) == (69, 440.0, None, 1200.0, None, 2.0)
    assert math.isclose(got.rel, 600, abs_tol=1e-6) and math.isclose(got.back, 6900, abs_tol=1e-3)


@pytest.mark.parametrize(("seconds", "text"), [(0.0, ""), (61.0, "1m:1s"), (3600.0, "1h:0m:0s"), (61.5, "1m:1s:500ms"), (5.25, "5s:250ms")])
def test_spans(spark, seconds, text):
    assert one(spark, x=units.span_text(F.lit(seconds))).x == text


def test_clock_and_stopwatch(spark):
    got = one(spark, a=units.clock_time(F.lit("20120325-235950.wav"), F.lit(25)), b=units.clock_time(F.lit("x.wav"), F.lit(3661)), s=units.stopwatch_time(F.lit(2_500_000_000)), m=units.stopwatch_time(F.lit(1_500_000)), u=units.stopwatch_time(F.lit(1500)), n=units.stopwatch_time(F.lit(15)), t=units.convert_time(F.lit(90.0), "minutes", "hours"))
    assert tuple(got) == ("00:00:15", "01:01:01", "2.50 s", "1.00 ms", "1.50 micros", "15.00 ns", 1.5)


def test_settings():
    c = EngineConfig.load("# text\nmonitor_window = 30\nfft.query_range=3\ncheck_duplicates = FALSE\n", strategy="constant_q", fft__query_range="4")
    assert (c.monitor_window, c.fft.query_range, c.check_duplicates, c.algorithm.kind) == (30.0, 4, False, "constant_q")
    assert ("fft.query_range", "4") in c.dump() and EngineConfig().fft.max_time_factor == 1.1
