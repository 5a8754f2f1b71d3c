"""Sound to spectrograms and pitches. Decoding cuts recordings into blocks that each carry the context of the next, so every transform is a map without a shuffle."""

from __future__ import annotations

import math
import shlex
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolattice.config import AlgorithmConfig, PitchConfig
from echolattice.operators.peaks import log_frequency_windows

MAX_BYTES = 1 << 20
#: Most bytes of a file that can be handed over as one value.
MOST_CONTENT = (1 << 31) - 1 - 64


def admitted(spark: SparkSession, paths: list[str], max_size_mb: int = 6_000, suffix: str | None = None) -> DataFrame:
    """``path, length`` of files (globs allowed) that aren't empty and are smaller than ``max_size_mb`` whole megabytes; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.load(paths).select("path", "length").where((F.col("length") > 0) & (F.floor(F.col("length") / MAX_BYTES) < max_size_mb))


def glob(spark: SparkSession, folder: str, pattern: str, recursive: bool = True) -> DataFrame:
    """``path`` of the files in a folder whose whole name matches the regular expression, sorted; names only are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return reader.load(folder).select("path").where(name.rlike(f"^(?:{pattern})$")).orderBy("path")


def listed(spark: SparkSession, arguments: list[str]) -> list[str]:
    """Paths of the arguments: options (``-x``) are skipped, a ``.txt`` file is a list with one path a line."""
    out: list[str] = []
    for a in arguments:
        if a.startswith("-"):
            continue
        if a.endswith(".txt"):
            out += [line for r in spark.read.text(a).collect() if (line := r[0].strip())]  # paths have to be known to plan a scan
        else:
            out.append(a)
    return out


class Undecodable(ValueError):
    """Content that isn't sound in a known form; the text is the reason."""


def wav_header(content: bytes) -> tuple[int, int, int, int, int, int]:
    """Format (1 whole numbers, 3 floats), channels, rate, bits a sample, and where the samples begin and end."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise Undecodable("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        body = at + 8
        if name == b"fmt ":
            part = content[body : body + size]
            if len(part) < 16:
                raise Undecodable("format too short")
            number = lambda i, n: int.from_bytes(part[i : i + n], "little")  # noqa: E731, B023
            kind = number(24, 2) if number(0, 2) == 0xFFFE and len(part) >= 26 else number(0, 2)
            form = (kind, number(2, 2), number(4, 4), number(14, 2))
        elif name == b"data":
            if form is None:
                raise Undecodable("samples before their format")
            kind, channels, rate, bits = form
            if (kind, bits) not in ((1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)) or not channels or not rate:
                raise Undecodable(f"format {kind} with {bits} bits")
            end = min(body + size, len(content))
            return kind, channels, rate, bits, body, end - (end - body) % (channels * bits // 8)
        at = body + size + size % 2
    raise Undecodable("no samples")


def resample(x: np.ndarray, own: int, rate: int, taps: int = 16) -> np.ndarray:
    """At ``rate`` instead of ``own`` samples a second, by a windowed sinc that cuts what the lower of the two can't hold."""
    if own == rate or not len(x):
        return x
    cut = min(1.0, rate / own)
    reach = int(math.ceil(taps / cut))
    out = np.zeros(int(len(x) * rate / own))
    padded = np.pad(x, reach + 1)
    for at in range(0, len(out), 1 << 18):
        spot = np.arange(at, min(len(out), at + (1 << 18))) * (own / rate)
        base = np.floor(spot).astype(np.int64)
        part = np.zeros(len(spot))
        for k in range(-reach, reach + 1):
            far = spot - base - k
            part += padded[base + k + reach + 1] * np.where(np.abs(far) < reach, np.sinc(cut * far) * cut * (0.5 + 0.5 * np.cos(np.pi * far / reach)), 0.0)
        out[at : at + len(spot)] = part
    return out


def decoded(content: bytes, decoder: str = "") -> bytes:
    """Content as WAV: itself, or what the command ``decoder`` makes of it (from its input to its output) where it isn't WAV already."""
    if not decoder or content[:4] == b"RIFF":
        return content
    done = subprocess.run(shlex.split(decoder), input=content, capture_output=True)  # noqa: S603 - the command is the user's setting
    if done.returncode:
        raise Undecodable(f"decoder ended with {done.returncode}: {done.stderr[-200:].decode(errors='replace').strip()}")
    return done.stdout


def decode_wav(content: bytes, rate: int) -> np.ndarray:
    """Mono samples in -1 to 1 at ``rate``, from 8, 16, 24 or 32 bits or from floats."""
    kind, channels, own, bits, begin, end = wav_header(content)
    raw = memoryview(content)[begin:end]
    if kind == 3:
        x = np.frombuffer(raw, f"<f{bits // 8}").astype(np.float64)
    elif bits == 24:
        x = np.zeros((len(raw) // 3, 4), np.uint8)
        x[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = x.reshape(-1).view("<i4") / 2.0**31
    elif bits == 8:
        x = (np.frombuffer(raw, np.uint8) - 128.0) / 128
    else:
        x = np.frombuffer(raw, f"<i{bits // 8}") / 2.0 ** (bits - 1)
    return resample(x.reshape(-1, channels).mean(1), own, rate)


def problems(content: Column, decoder: str = "") -> Column:
    """Why content can't be decoded; null where it can."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(c: bytes | None) -> str | None:
            try:
                wav_header(decoded(bytes(c or b""), decoder))
            except Undecodable as e:
                return str(e)
            return None

        return values.map(one).astype(object)

    return run(content)


def cut(samples: np.ndarray, step: int, context: int, halo: int, frames_per_block: int) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """Blocks of a recording, as the columns of :func:`pcm` after the resource."""
    frames = max(0, (len(samples) - context) // step)
    for own in range(0, max(frames, 1), frames_per_block):
        to = min(frames, own + frames_per_block)
        first = max(0, own - halo)
        yield first, own, to, frames, samples[first * step : (to + halo) * step + context]


def pcm(files: DataFrame, rate: int, step: int, context: int, halo: int = 0, frames_per_block: int = 4096, decoder: str = "") -> DataFrame:
    """``resource_id, first_frame, own_from, own_to, frames, samples`` from ``resource_id, content``: blocks of ``frames_per_block`` steps.

    A block's samples begin ``halo`` frames before its own ones and end ``halo`` frames and ``context`` samples after them, so windows over frames need no other block. ``frames`` is the recording's number of
    whole frames. Content that can't be decoded gives no rows; :func:`problems` tells why.
    """
    names = ["first_frame", "own_from", "own_to", "frames", "samples"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            for rid, content in zip(x["resource_id"], x["content"]):
                try:
                    samples = decode_wav(decoded(bytes(content), decoder), rate).astype(np.float32)
                except Undecodable:
                    continue
                for block in cut(samples, step, context, halo, frames_per_block):
                    yield pd.DataFrame({"resource_id": [rid], **{k: [v] for k, v in zip(names, block)}})

    return files.select("resource_id", "content").mapInPandas(run, "resource_id int, first_frame int, own_from int, own_to int, frames int, samples array<float>")


def seconds_of(content: Column, decoder: str = "") -> Column:
    """Duration in seconds from the WAV header; null where there is none."""

    @F.pandas_udf("double")
    def seconds(values: pd.Series) -> pd.Series:
        def one(c: bytes | None) -> float | None:
            try:
                _, channels, rate, bits, begin, end = wav_header(decoded(bytes(c or b""), decoder))
            except Undecodable:
                return None
            return (end - begin) / (channels * bits // 8) / rate

        return values.map(one).astype("float64")

    return F.nanvl(seconds(content), F.lit(None).cast("double"))


def durations(files: DataFrame, decoder: str = "") -> DataFrame:
    """``resource_id, duration`` of :func:`seconds_of`."""
    return files.select("resource_id", seconds_of(F.col("content"), decoder).alias("duration"))


def _spectra(blocks: DataFrame, config: AlgorithmConfig) -> DataFrame:
    """Long form of the frames of a block."""
    size, step = window_size(config), config.block_step

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = transform(config)
        for x in parts:
            for rid, first, samples in zip(x["resource_id"], x["first_frame"], x["samples"]):
                samples = np.asarray(samples, np.float64)
                n = (len(samples) - size) // step + 1
                for at in range(0, max(n, 0), 512):
                    m = of(samples[at * step : (min(n, at + 512) - 1) * step + size])
                    t, f = np.indices(m.shape)
                    yield pd.DataFrame({"resource_id": np.full(m.size, rid, np.int32), "t": (t.ravel() + first + at).astype(np.int32), "f": f.ravel().astype(np.int32), "m": m.ravel()})

    return blocks.mapInPandas(run, "resource_id int, t int, f int, m double")


#: Frames that are transformed at once.
AT_ONCE = 512


def _windows(samples: np.ndarray, size: int, step: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(samples, size)[::step]


def fft_power(config: AlgorithmConfig) -> Callable[[np.ndarray], np.ndarray]:
    """Samples to power spectra of their frames: Hamming-windowed FFT, bins 0 to size / 2 - 1, those below the least bin are 0."""
    window, bins = np.hamming(config.block_size), config.block_size // 2

    def power(samples: np.ndarray) -> np.ndarray:
        view = _windows(samples, config.block_size, config.block_step)
        out = np.empty((len(view), bins))
        for at in range(0, len(view), AT_ONCE):
            x = np.fft.rfft(view[at : at + AT_ONCE] * window, axis=1)[:, :bins]
            out[at : at + AT_ONCE] = x.real**2 + x.imag**2
        out[:, : config.min_bin] = 0
        return out

    return power


def bands(config: AlgorithmConfig) -> int:
    return int(round(math.log2(config.max_frequency / config.min_frequency) * config.bands_per_octave)) if config.kind == "constant_q" else config.block_size // 2


#: Taps to either side of the filter before each halving of the rate.
HALVING = 12


@dataclass(frozen=True)
class Tier:
    """Bands that are looked at in the signal at a 2 ** ``halved`` times lower rate, in windows of ``size`` of its samples."""

    halved: int
    size: int
    hertz: tuple[float, ...]

    @property
    def reach(self) -> int:
        """Samples to either side of a frame's centre."""
        return (self.size // 2 << self.halved) + HALVING * ((1 << self.halved) - 1)


@lru_cache(maxsize=8)
def tiers(config: AlgorithmConfig) -> tuple[Tier, ...]:
    """The bands by the lowest rate that holds them with room for the filter; a window is as long as the longest kernel in it, that of the lowest band."""
    q = 1 / (2 ** (1 / config.bands_per_octave) - 1)
    by_rate: dict[int, list[float]] = {}
    for b in range(bands(config)):
        hz, halved = config.min_frequency * 2 ** (b / config.bands_per_octave), 0
        while halved < 4 and hz <= 0.22 * config.sample_rate / 2 ** (halved + 1) and config.block_step % 2 ** (halved + 1) == 0:
            halved += 1
        by_rate.setdefault(halved, []).append(hz)
    return tuple(Tier(h, -(-math.ceil(q * config.sample_rate / 2**h / min(hz)) // 128) * 128, tuple(hz)) for h, hz in by_rate.items())


def window_size(config: AlgorithmConfig) -> int:
    """Samples a frame looks at."""
    if config.kind != "constant_q":
        return config.block_size
    return 2 * -(-max(t.reach for t in tiers(config)) // config.block_step) * config.block_step


def halve(x: np.ndarray) -> np.ndarray:
    """Every second sample after a low-pass filter; sample i stays at place i / 2."""
    k = np.arange(-HALVING, HALVING + 1)
    taps = 0.5 * np.sinc(k / 2) * np.kaiser(len(k), 8)
    return np.convolve(x, taps / taps.sum(), "same")[::2] if len(x) > len(k) else x[::2]


def constant_q_magnitude(config: AlgorithmConfig) -> Callable[[np.ndarray], np.ndarray]:
    """Samples to magnitudes of the logarithmic bands of their frames: kernels of Hann-windowed tones around a frame's centre, each as long as its band needs, applied in the frequency domain where they aren't negligible. Low bands are looked at in the signal at a lower rate."""
    q, size, step = 1 / (2 ** (1 / config.bands_per_octave) - 1), window_size(config), config.block_step
    plan = []
    for tier in tiers(config):
        rate, kernels = config.sample_rate / 2**tier.halved, []
        for hz in tier.hertz:
            n = min(tier.size, int(q * rate / hz))
            at = (tier.size - n) // 2
            tone = np.zeros(tier.size, complex)
            tone[at : at + n] = np.hanning(n) / n * np.exp(2j * np.pi * hz / rate * np.arange(n))
            spectrum = np.conj(np.fft.fft(tone))[: tier.size // 2 + 1] / tier.size
            heard = np.flatnonzero(np.abs(spectrum) > 1e-3 * np.abs(spectrum).max())
            kernels.append((int(heard[0]), spectrum[heard[0] : heard[-1] + 1]))
        plan.append((tier, kernels))

    def magnitude(samples: np.ndarray) -> np.ndarray:
        n = (len(samples) - size) // step + 1
        levels = [samples]
        for _ in range(max(t.halved for t, _ in plan)):
            levels.append(halve(levels[-1]))
        out = np.empty((n, bands(config)))
        for tier, kernels in plan:
            begin = (size // 2 >> tier.halved) - tier.size // 2
            view = _windows(levels[tier.halved][begin:], tier.size, step >> tier.halved)[:n]
            first = int(round(math.log2(tier.hertz[0] / config.min_frequency) * config.bands_per_octave))
            for at in range(0, n, AT_ONCE):
                x = np.fft.rfft(view[at : at + AT_ONCE], axis=1)
                y = np.empty((len(x), len(kernels)), complex)
                for i, (lo, k) in enumerate(kernels):
                    y[:, i] = x[:, lo : lo + len(k)] @ k
                out[at : at + AT_ONCE, first : first + len(kernels)] = np.abs(y)
        return out

    return magnitude


def transform(config: AlgorithmConfig) -> Callable[[np.ndarray], np.ndarray]:
    return constant_q_magnitude(config) if config.kind == "constant_q" else fft_power(config)


def spectrogram(blocks: DataFrame, config: AlgorithmConfig) -> DataFrame:
    """Long form of a block's frames. Blocks need the window's size less a step of context for no frame to be lost. The constant-Q transform is functionally equal to, not bit by bit the same as, others."""
    return _spectra(blocks, config)


def sliding_max(m: np.ndarray, before: int, after: int, axis: int) -> np.ndarray:
    """Maximum over ``before`` places before to ``after`` after each, fewer at the edges, in a number of steps that grows with the logarithm of the width."""
    m = np.moveaxis(m, axis, 0)
    n, width = len(m), before + after + 1
    low = np.full((before, *m.shape[1:]), -np.inf)
    high = np.full((after, *m.shape[1:]), -np.inf)
    x = np.concatenate([low, m, high])
    have = 1
    while have * 2 <= width:
        x = np.maximum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    if rest:
        x = np.maximum(x[:-rest], x[rest:])
    return np.moveaxis(x[:n], 0, axis)


def ranges_max(m: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """For each ``f, a, b`` the maximum of the columns a to b - 1 in column f; -inf where there are none. Maxima over 1, 2, 4, ... columns are made once, and two of them cover any span."""
    level, out = np.ascontiguousarray(m.T), np.full(m.shape[::-1], -np.inf)
    f, a, b = (np.array(x) for x in zip(*spans))
    width = 1
    while True:
        now = np.flatnonzero((b - a >= width) & (b - a < 2 * width))
        if len(now):
            out[f[now]] = np.maximum(level[a[now]], level[b[now] - width])
        if not (b - a >= 2 * width).any():
            return np.ascontiguousarray(out.T)
        level = np.maximum(level[:-width], level[width:])
        width *= 2


def peaks_of(m: np.ndarray, config: AlgorithmConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frame, bin and 3 x 3 sum of the cells of a dense ``frames x bins`` block that equal the maxima of their neighbourhoods."""
    half = config.time_max_filter // 2
    if config.kind == "fft":
        vertical = ranges_max(m, log_frequency_windows(config))
    else:
        vertical = sliding_max(m, config.freq_max_filter // 2, config.freq_max_filter // 2, 1)
    horizontal = sliding_max(vertical, half, half - 1, 0)
    hit = (m == vertical) & (m == horizontal) & (m != 0)
    hit[:, : config.min_bin] = False
    hit[:, m.shape[1] - 1 :] = False
    t, f = np.nonzero(hit)
    padded = np.pad(m, 1)
    return t, f, sum(padded[t + i, f + j] for i in range(3) for j in range(3))


_POINTS = "resource_id int, t int, f int, m double"


def _points(rid: int, block: tuple[int, int, int, int, np.ndarray], of: Callable[[np.ndarray], np.ndarray], config: AlgorithmConfig) -> pd.DataFrame | None:
    first, own, to, frames, samples = block
    half, step, size = config.time_max_filter // 2, config.block_step, window_size(config)
    samples = np.asarray(samples, np.float64)
    n = (len(samples) - size) // step + 1
    if n <= 0:
        return None
    t, f, around = peaks_of(of(samples[: (n - 1) * step + size]), config)
    t = t + first
    keep = (t >= own) & (t < to) & (t >= half) & (t <= frames - 1 - half)
    return pd.DataFrame({"resource_id": np.full(int(keep.sum()), rid, np.int32), "t": t[keep].astype(np.int32), "f": f[keep].astype(np.int32), "m": around[keep]})


def event_points(blocks: DataFrame, config: AlgorithmConfig) -> DataFrame:
    """``resource_id, t, f, m`` of the event points of sound in blocks of :func:`pcm` with a halo of at least half the time filter: transform and filters run on a block's matrix, so only the points leave it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = transform(config)
        for x in parts:
            for rid, *block in zip(*(x[c] for c in ("resource_id", "first_frame", "own_from", "own_to", "frames", "samples"))):
                if (found := _points(rid, tuple(block), of, config)) is not None:
                    yield found

    return blocks.mapInPandas(run, _POINTS)


def event_points_of(files: DataFrame, config: AlgorithmConfig, decoder: str = "", frames_per_block: int = 2048) -> DataFrame:
    """The same straight from ``resource_id, content``: samples are cut into the same kind of blocks, which never leave the process that decodes them."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = transform(config)
        for x in parts:
            for rid, content in zip(x["resource_id"], x["content"]):
                try:
                    samples = decode_wav(decoded(bytes(content), decoder), config.sample_rate).astype(np.float32)
                except Undecodable:
                    continue
                for block in cut(samples, config.block_step, window_size(config) - config.block_step, config.time_max_filter, frames_per_block):
                    if (found := _points(rid, block, of, config)) is not None:
                        yield found

    return files.select("resource_id", "content").mapInPandas(run, _POINTS)


def yin_pitch(frame: np.ndarray, rate: int, threshold: float = 0.20) -> float:
    """Fundamental in hertz by cumulative mean normalised difference; 0 if unpitched."""
    half = len(frame) // 2
    spectrum = np.fft.rfft(frame, 2 * len(frame))
    head = np.fft.rfft(frame[:half], 2 * len(frame))
    cross = np.fft.irfft(spectrum * np.conj(head))[:half]
    power = np.concatenate([[0], np.cumsum(frame**2)])
    energy = power[half : 2 * half] - power[:half]
    difference = energy[0] + energy - 2 * cross
    running = np.cumsum(difference[1:])
    normal = np.ones(half)
    normal[1:] = difference[1:] * np.arange(1, half) / np.where(running > 0, running, 1)
    below = np.flatnonzero(normal[2:] < threshold)
    if not len(below):
        return 0.0
    tau = int(below[0]) + 2
    while tau + 1 < half and normal[tau + 1] < normal[tau]:
        tau += 1
    if 1 <= tau < half - 1:
        a, b, c = normal[tau - 1 : tau + 2]
        if a + c - 2 * b != 0:
            return rate / (tau + (a - c) / (2 * (a + c - 2 * b)))
    return rate / tau


def pitch_track(blocks: DataFrame, config: PitchConfig) -> DataFrame:
    """``resource_id, t, hz`` of the pitched frames."""
    size, step = config.block_size, config.block_size - config.block_overlap

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            for rid, first, samples in zip(x["resource_id"], x["first_frame"], x["samples"]):
                samples = np.asarray(samples, np.float64)
                hz = [yin_pitch(samples[i : i + size], config.sample_rate) for i in range(0, len(samples) - size + 1, step)]
                t = [first + i for i, v in enumerate(hz) if v > 0]
                yield pd.DataFrame({"resource_id": np.full(len(t), rid, np.int32), "t": np.array(t, np.int32), "hz": np.array([v for v in hz if v > 0], float)})

    return blocks.mapInPandas(run, "resource_id int, t int, hz double")
