import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolattice import cli
from echolattice.config import CONSTANT_Q, FFT, EngineConfig, PitchConfig
from echolattice.engine import STRATEGIES, Engine, strategy
from echolattice.operators import peaks
from echolattice.sources import audio, cachefiles

RATE = 16_000


def song(seed, seconds=40):
    r = np.random.default_rng(seed)
    t = np.arange(RATE // 4) / RATE
    note = lambda: sum(np.sin(2 * np.pi * 200 * 2 ** r.uniform(0, 4.5) * t) * np.hanning(len(t)) * r.uniform(0.2, 1) for _ in range(3))
    return np.concatenate([note() for _ in range(seconds * 4)]) / 4


def save(path, x, rate=RATE):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.asarray(x) * 20_000).astype("<i2").tobytes())


@pytest.fixture(scope="module")
def sounds(tmp_path_factory):
    d = tmp_path_factory.mktemp("sounds")
    for i in (1, 2, 3):
        save(d / f"{i}.wav", song(i))
    (d / "q").mkdir()
    for i in (1, 3):
        save(d / "q" / f"{i}00_10s-30s.wav", song(i)[10 * RATE : 30 * RATE] + 0.02 * np.random.default_rng(i).standard_normal(20 * RATE))
    save(d / "q" / "900.wav", song(99, 20))
    (d / "q" / "empty.wav").write_bytes(b"")
    return d


@pytest.mark.parametrize("strategy", ["fft", "constant_q"])
def test_engine_end_to_end(spark, sounds, tmp_path, strategy):
    e = Engine(spark, f"file://{tmp_path}/ix", EngineConfig(strategy=strategy))
    first = e.store([f"{sounds}/*.wav"])
    assert first.count() == 3 and all(r.duration == 40 and r.num_fingerprints > 200 for r in first.collect())
    assert e.store([f"{sounds}/*.wav"]).count() == 0
    got = {r.query_path.split("/")[-1]: r for r in e.query([f"{sounds}/q/*.wav"]).where("rank = 1").collect()}
    for i in (1, 3):
        r = got[f"{i}00_10s-30s.wav"]
        assert r.ref_id == i and abs(r.ref_start - r.query_start - 10) < 0.5 and r.score > 50 and abs(r.time_factor - 1) < 0.01
        assert r.ref_path.endswith(f"/{i}.wav")
    assert got["900.wav"].ref_id is None and set(got) == {"100_10s-30s.wav", "300_10s-30s.wav", "900.wav"}
    if strategy == "fft":
        windows = e.monitor([f"{sounds}/2.wav"]).collect()
        assert {r.ref_id for r in windows} == {2} and [r.query_path.split("/")[-1] for r in windows] == ["2.wav-0.0_25.0"] and windows[0].ref_path.endswith("/2.wav")
        assert [(r.ref_id, r.score) for r in e.monitor([f"{sounds}/2.wav"], avoid_self=True).collect()] == [(None, -1)]
        assert e.same(f"{sounds}/1.wav", f"{sounds}/q/100_10s-30s.wav").first().percent > 80
        assert {r.resource_id for r in e.stored([f"{sounds}/*.wav", f"{sounds}/q/900.wav"]).collect()} == {1, 2, 3}
        e.delete([f"{sounds}/1.wav"])
        assert e.stats().first().resources == 2 and {r.line.split(" ; ")[0] for r in e.metadata([f"{sounds}/1.wav", f"{sounds}/2.wav"]).collect()} == {"is not indexed", "2"}
        assert e.print([f"{sounds}/2.wav"], points=True).count() > 50 and e.print([f"{sounds}/2.wav"]).count() > 200
        e.clear()
        assert e.stats().first().resources == 0


def test_same_tells_files_of_one_name_apart(spark, sounds, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    save(tmp_path / "a" / "5.wav", song(1)[: 20 * RATE])
    save(tmp_path / "b" / "5.wav", song(98, 20))
    e = Engine(spark, f"file://{tmp_path}/ix")
    assert e.same(f"{tmp_path}/a/5.wav", f"{tmp_path}/b/5.wav").first().percent == 0
    assert e.same(f"{tmp_path}/a/5.wav", f"{sounds}/1.wav").first().percent > 80


def test_queries_of_held_out_recordings(spark, tmp_path):
    """First result of each query: the right recording within 3.5 seconds of its place, clean or with noise as loud as a tenth of the sound; none for recordings that aren't indexed."""
    stored, held = (10, 11, 12), (20, 21)
    for i in stored:
        save(tmp_path / f"{i}.wav", song(i, 30))
    (tmp_path / "q").mkdir()
    r = np.random.default_rng(0)
    for i in (*stored, *held):
        x = song(i, 30)[5 * RATE : 25 * RATE]
        save(tmp_path / "q" / f"{i}_5s-25s.wav", x)
        save(tmp_path / "q" / f"{i}_5s-25s_ota.wav", x + 0.1 * x.std() * r.standard_normal(len(x)))
    e = Engine(spark, f"file://{tmp_path}/ix")
    e.store([f"{tmp_path}/*.wav"])
    rows = e.query([f"{tmp_path}/q/*.wav"], most=1).collect()
    assert len(rows) == 10
    for row in rows:
        i = int(row.query_path.split("/")[-1].split("_")[0])
        assert row.ref_id == (i if i in stored else None)
        assert row.ref_id is None or abs(row.ref_start - row.query_start - 5) < 3.5


def test_content_that_cannot_be_decoded(spark, tmp_path):
    """It is told with its reason, isn't stored, and is stored once a decoder is set; an empty file is not there for any of them."""
    x = song(7, 12)
    save(tmp_path / "1.wav", x)
    (tmp_path / "2.raw").write_bytes(b"\xff" + (tmp_path / "1.wav").read_bytes())
    (tmp_path / "3.wav").write_bytes(b"")
    e = Engine(spark, f"file://{tmp_path}/ix")
    files = [f"{tmp_path}/1.wav", f"{tmp_path}/2.raw", f"{tmp_path}/3.wav"]
    assert {(r.path.split("/")[-1], r.reason) for r in e.rejected(files).collect()} == {("2.raw", "not a WAV file")}
    assert [r.resource_id for r in e.store(files).collect()] == [1] and e.stored(files).count() == 1
    e = Engine(spark, f"file://{tmp_path}/ix", EngineConfig(decoder="tail -c +2"))
    assert [r.resource_id for r in e.store(files).collect()] == [2] and e.rejected(files).count() == 0
    bad = Engine(spark, f"file://{tmp_path}/other", EngineConfig(decoder="false"))
    assert "decoder ended with 1" in bad.rejected(files[1:2]).first().reason


def packed(x, kind):
    x = np.asarray(x)
    if kind == "u8":
        return (np.round(x * 127) + 128).astype(np.uint8).tobytes(), 1, 8
    if kind == "i24":
        return np.round(x * (2**23 - 1)).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), 1, 24
    if kind in ("i16", "i32"):
        return np.round(x * (2 ** (int(kind[1:]) - 1) - 1)).astype(f"<i{int(kind[1:]) // 8}").tobytes(), 1, int(kind[1:])
    return x.astype(f"<f{int(kind[1:]) // 8}").tobytes(), 3, int(kind[1:])


@pytest.mark.parametrize("kind", ["u8", "i16", "i24", "i32", "f32", "f64"])
@pytest.mark.parametrize("extended", [False, True])
def test_every_width_of_wav(kind, extended):
    x = 0.9 * np.sin(np.arange(3000) / 7)
    data, tag, bits = packed(np.repeat(x, 2), kind)  # two channels
    form = struct.pack("<HHIIHH", 0xFFFE if extended else tag, 2, 8000, 8000 * bits // 4, bits // 4, bits) + (struct.pack("<HHIH", 22, bits, 3, tag) + b"\0" * 14 if extended else b"")
    body = b"fmt " + struct.pack("<I", len(form)) + form + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(data)) + data + b"\0"
    got = audio.decode_wav(b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body, 8000)
    assert len(got) == 3000 and np.abs(got - x).max() < (0.02 if bits == 8 else 1e-4)


def test_resampling_cuts_what_the_lower_rate_cannot_hold():
    t = np.arange(44_100) / 44_100
    low, high = np.sin(2 * np.pi * 1000 * t), np.sin(2 * np.pi * 12_000 * t)
    got = audio.resample(low + high, 44_100, 16_000)
    assert len(got) == 16_000
    want = np.sin(2 * np.pi * 1000 * np.arange(16_000) / 16_000)
    assert np.abs(got - want)[200:-200].max() < 0.02  # the tone stays, the other doesn't fold back to 4,000 Hz
    up = audio.resample(np.sin(2 * np.pi * 1000 * np.arange(8000) / 8000), 8000, 16_000)
    assert np.abs(up - want)[200:-200].max() < 0.02


def test_kernels_of_all_bands_fit_their_window():
    q = 1 / (2 ** (1 / CONSTANT_Q.bands_per_octave) - 1)
    assert audio.window_size(CONSTANT_Q) >= q * CONSTANT_Q.sample_rate / CONSTANT_Q.min_frequency and audio.window_size(FFT) == FFT.block_size


def test_strategies_are_found_by_name(spark):
    assert STRATEGIES["pitch_class_histogram"] is STRATEGIES["pch"] is not STRATEGIES["fft"] is STRATEGIES["constant_q"]

    @strategy("test_only")
    class Nothing:
        def __init__(self, spark, path, config):
            self.where = path

    assert Engine(spark, "/x/", EngineConfig(strategy="TEST_ONLY")).strategy.where == "/x"
    del STRATEGIES["test_only"]


def test_memory_index_and_caches(spark, sounds, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/ix", EngineConfig(storage="memory", cache_folder=f"file://{tmp_path}/cache"))
    n = e.store([f"{sounds}/1.wav"]).first().num_fingerprints
    assert e.query([f"{sounds}/q/100_10s-30s.wav"]).first().ref_id == 1 and e.stats().first().postings == n
    other = Engine(spark, f"file://{tmp_path}/other")
    other.load(f"file://{tmp_path}/cache/prints/*", f"file://{tmp_path}/cache/metadata")
    assert other.stats().first().resources == 1 and 0 < other.stats().first().postings <= n
    e.load(f"file://{tmp_path}/cache/prints/*", f"file://{tmp_path}/cache/metadata")  # nothing new
    assert e.stats().first().postings == n
    e.clear()
    assert e.stats().first().resources == 0
    e.load(f"file://{tmp_path}/cache/prints/*", f"file://{tmp_path}/cache/metadata")
    assert e.stats().first().postings == n and e.query([f"{sounds}/q/100_10s-30s.wav"]).first().ref_id == 1


def test_histogram_strategy(spark, tmp_path):
    for name, hz in (("1", [261.63, 329.63, 392.0]), ("2", [277.18, 311.13, 466.16])):
        save(tmp_path / f"{name}.wav", np.concatenate([np.sin(2 * np.pi * f * np.arange(22_050) / 22_050) for f in hz for _ in range(2)]), 22_050)
    save(tmp_path / "3.wav", np.concatenate([np.sin(2 * np.pi * f * 2 ** (2 / 12) * np.arange(22_050) / 22_050) for f in (261.63, 329.63, 392.0) for _ in range(2)]), 22_050)
    e = Engine(spark, f"file://{tmp_path}/ix", EngineConfig(strategy="pch"))
    e.store([f"{tmp_path}/1.wav", f"{tmp_path}/2.wav"])
    best = e.query([f"{tmp_path}/3.wav"]).where("rank = 1").first()
    assert best.ref_id == 1 and min(abs(best["shift"] - 1000), abs(best["shift"] - 200)) <= 8
    assert e.store([f"{tmp_path}/1.wav", f"{tmp_path}/2.wav"]).count() == 0 and e.stats().first().resources == 2
    rows = e.query([f"{tmp_path}/3.wav"]).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2] and rows[0].ref_path.endswith("/1.wav") and rows[0].score == int(rows[0].match * 100)
    assert e.query([f"{tmp_path}/3.wav"], most=1).count() == 1
    avoid = spark.createDataFrame([(3, 1)], "query_id int, resource_id int")
    assert [r.ref_id for r in e.query([f"{tmp_path}/3.wav"], avoid=avoid).collect()] == [2]
    assert {r.line for r in e.metadata([f"{tmp_path}/3.wav"]).collect()} == {"is not indexed"}
    again = Engine(spark, f"file://{tmp_path}/ix", EngineConfig(strategy="pch", check_duplicates=False))
    assert again.store([f"{tmp_path}/1.wav"]).count() == 1 and again.stats().first().resources == 2
    e.clear()
    assert e.stats().first().resources == 0 and [(r.ref_id, r.score) for r in e.query([f"{tmp_path}/3.wav"]).collect()] == [(None, -1)]
    with pytest.raises(NotImplementedError):
        e.monitor([f"{tmp_path}/3.wav"])


def test_block_peaks_equal_window_operators(spark, tmp_path):
    save(tmp_path / "7.wav", song(5, 6))
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/7.wav").select(F.lit(7).alias("resource_id"), "content")
    for c in (FFT, CONSTANT_Q):
        context = audio.window_size(c) - c.block_step
        blocks = audio.pcm(files, RATE, c.block_step, context, halo=c.time_max_filter, frames_per_block=150)
        got = sorted((r.t, r.f) for r in audio.event_points(blocks, c).collect())
        whole = audio.pcm(files, RATE, c.block_step, context)
        want = sorted((r.t, r.f) for r in peaks.event_points(audio.spectrogram(whole, c), c, audio.bands(c)).collect())
        assert got == want and len(got) > 10
        assert sorted((r.t, r.f) for r in audio.event_points_of(files, c, frames_per_block=200).collect()) == want


def test_tone_lands_in_its_band(spark, tmp_path):
    save(tmp_path / "1.wav", np.sin(2 * np.pi * 880 * np.arange(RATE * 2) / RATE))
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/1.wav").select(F.lit(1).alias("resource_id"), "content")
    for c, bin_ in ((CONSTANT_Q, 255), (FFT, 56)):
        blocks = audio.pcm(files, RATE, c.block_step, audio.window_size(c) - c.block_step)
        best = audio.spectrogram(blocks, c).where("t = 20").orderBy(F.desc("m")).first()
        assert abs(best.f - bin_) <= 1
    p = PitchConfig()
    track = audio.pitch_track(audio.pcm(files, p.sample_rate, 1024, 1024), p).collect()
    assert track and all(abs(r.hz - 880) < 5 for r in track)


def test_sliding_max():
    r = np.random.default_rng(0)
    for n, before, after in ((50, 12, 11), (5, 51, 51), (1, 1, 0), (30, 0, 0), (40, 3, 4)):
        m = r.normal(size=(n, 3))
        want = np.array([m[max(0, i - before) : i + after + 1].max(0) for i in range(n)])
        assert np.array_equal(audio.sliding_max(m, before, after, 0), want) and np.array_equal(audio.sliding_max(m.T, before, after, 1), want.T)


def test_admission_and_lists(spark, sounds, tmp_path):
    assert audio.admitted(spark, [str(sounds / "q")]).count() == 3 and audio.admitted(spark, [str(sounds)], max_size_mb=1).count() == 3
    assert [r.path.split("/")[-1] for r in audio.glob(spark, str(sounds), r"\d\.wav").collect()] == ["1.wav", "2.wav", "3.wav"]
    assert audio.glob(spark, str(sounds), r".*s\.wav").count() == 2 and audio.glob(spark, str(sounds), r"\d", recursive=False).count() == 0
    (tmp_path / "list.txt").write_text("a.wav\n\nb.wav\n")
    assert audio.listed(spark, ["-ep", "x.wav", f"{tmp_path}/list.txt"]) == ["x.wav", "a.wav", "b.wav"]
    (tmp_path / "bad.wav").write_bytes(b"not a wave file")
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/bad.wav").select(F.lit(1).alias("resource_id"), "content")
    assert audio.pcm(files, RATE, 128, 0).count() == 0 and audio.durations(files).first().duration is None


def test_caches_round_trip(spark, tmp_path):
    rows = [(5, 1, 10, 2), (7, 1, 3, 4), (9, 2, 1, None)]
    prints = spark.createDataFrame(rows, "hash bigint, resource_id int, t1 int, f1 int")
    cachefiles.write_prints(prints.where("f1 IS NOT NULL"), f"file://{tmp_path}/p")
    got = cachefiles.read_prints(spark, f"file://{tmp_path}/p/*")
    assert sorted(map(tuple, got.collect())) == rows[:2]
    meta = spark.createDataFrame([(1, "a b.wav", 2.5, 3)], "resource_id int, path string, duration double, num_fingerprints bigint")
    cachefiles.write_metadata(meta, f"file://{tmp_path}/m")
    assert list(map(tuple, cachefiles.read_metadata(spark, f"file://{tmp_path}/m").collect())) == [(1, "a b.wav", 2.5, 3)]
    assert cachefiles.between_seconds(prints, 0.024, 0.056, FFT).count() == 2
    late = CONSTANT_Q.but(latency_samples=100, sample_rate=44_100)
    for c in (FFT, late):
        for start, length in ((1.0, 4.0), (0.1, 0.7), (0.0, 0.3), (3.3, 0.0), (1.016, 0.008)):
            frames = [t for t in range(4000) if start <= t * c.seconds_per_block + (c.latency_seconds if c is late else 0.0) <= start + length]
            low, high = cachefiles.frames_between(start, start + length, c)
            assert frames == list(range(max(low, 0), high + 1))
    (tmp_path / "e.txt").write_text("1 2 0.5\n3 4 0.25\n")
    assert [tuple(r) for r in cachefiles.read_event_points(spark, f"file://{tmp_path}/e.txt", F.lit(8)).collect()] == [(8, 1, 2, 0.5), (8, 3, 4, 0.25)]


def test_printed_line_can_be_parsed(spark):
    from echolattice.sources.rawlines import parse_result_lines

    row = [(1, 2, "q.wav", 0.5, 9.0, None, None, -1.0, -1.0, -1, 0.976, 1.0, 0.83)]
    x = spark.createDataFrame(row, "query_index int, total_queries int, query_path string, query_start double, query_stop double, ref_path string, ref_id int, ref_start double, ref_stop double, match_score bigint, time_factor double, frequency_factor double, coverage double")
    line = cachefiles.result_lines(x).first().line
    assert line == "1 ; 2 ; q.wav ; 0.500 ; 9.000 ; null ; null ; -1.000 ; -1.000 ; -1 ; 0.976 % ; 1.000 %; 0.83"
    back = parse_result_lines(spark.createDataFrame([(1, line)], "line_no bigint, raw_line string")).first()
    assert back.reason is None and back.ref_id is None and back.match_score == -1 and back.time_factor == 0.976


def test_commands(spark, sounds, tmp_path, capsys):
    assert cli.command("q") == "query" and cli.command("stats") == "stats" and cli.split(["mon", "a", "strategy=fft"]) == ("monitor", ["a"], {"strategy": "fft"})
    for word in ("s", "zzz"):
        with pytest.raises(SystemExit):
            cli.command(word)
    assert cli.main([]) == 0 and "strategy = fft" in capsys.readouterr().out
    where = f"index=file://{tmp_path}/ix"
    assert cli.main(["store", f"{sounds}/1.wav", where], spark) == 0
    capsys.readouterr()
    assert cli.main(["query", f"{sounds}/q/100_10s-30s.wav", where], spark) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0] == cachefiles.HEADER and out[1].split(";")[6].strip() == "1"
    assert cli.main(["query", f"{sounds}/q/900.wav", f"{sounds}/q/100_10s-30s.wav", where], spark) == 0
    lines = [[f.strip() for f in x.split(";")] for x in capsys.readouterr().out.splitlines()[1:]]
    assert [(x[0], x[1], x[6]) for x in lines] == [("1", "2", "1"), ("2", "2", "null")]
    assert cli.main(["monitor", f"{sounds}/1.wav", where], spark) == 0
    lines = [[f.strip() for f in x.split(";")] for x in capsys.readouterr().out.splitlines()[1:]]
    assert [(x[0], x[1], x[2].split("/")[-1], x[6]) for x in lines] == [("1", "1", "1.wav-0.0_25.0", "1")]
    assert cli.main(["stats", "0.01", "polls=2", where], spark) == 0 and len(capsys.readouterr().out.splitlines()) == 2
    assert cli.main(["--version"]) == 0 and cli.main(["resolve", f"{sounds}/1.wav", where], spark) == 0
