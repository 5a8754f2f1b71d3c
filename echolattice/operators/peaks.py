"""Event points: cells of a spectrogram that are the largest of their neighbourhood in frequency and time.

A spectrogram is the dense grid ``resource_id, t, f, m``. Each filter is one range window: the frequency side needs the rows of one frame together, the
time side those of one bin within a block of frames. Blocks carry the frames around them that the filter looks at, so extraction takes two shuffles, of (resource, frame) and (resource, bin, block), and no task grows with the length of a resource.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echolattice.config import AlgorithmConfig

FRAME = ("resource_id", "t")
BIN = ("resource_id", "f", "_block")
#: Frames of a block on the time side.
BLOCK = 4096


def _frame(low: int, high: int) -> W:
    return W.partitionBy(*FRAME).orderBy("f").rangeBetween(low, high)


def _bin(low: int, high: int) -> W:
    return W.partitionBy(*BIN).orderBy("t").rangeBetween(low, high)


def _blocked(x: DataFrame, halo: int, block: int) -> DataFrame:
    """Each row in the block of its frame, and once more in a neighbouring one whose filters reach it (at most ``halo`` frames away; blocks are wider)."""
    if block <= 2 * halo:
        raise ValueError("blocks must be wider than what the filter looks at")
    own, at = F.floor(F.col("t") / block).cast("int"), F.pmod(F.col("t"), F.lit(block))
    near = F.array_compact(F.array(own, F.when(at < halo, own - 1), F.when(at >= block - halo, own + 1)))
    return x.withColumn("_block", F.explode(near))


def _own() -> Column:
    return F.floor(F.col("t") / F.lit(BLOCK)).cast("int") == F.col("_block")


def vertical_max(spectrogram: DataFrame, size: int) -> DataFrame:
    """Adds ``vm``, the maximum over the ``size`` bins centred on a cell, fewer at the edges."""
    half = size // 2
    return spectrogram.withColumn("vm", F.max("m").over(_frame(-half, half)))


def horizontal_max(filtered: DataFrame, size: int) -> DataFrame:
    """Adds ``hm``, the maximum of ``vm`` over the frames from ``size // 2`` before to ``size // 2 - 1`` after (the window is asymmetric, its stop exclusive)."""
    half = size // 2
    return _blocked(filtered, half, BLOCK).withColumn("hm", F.max("vm").over(_bin(-half, half - 1))).where(_own()).drop("_block")


def min_max_filter(df: DataFrame, group: list[str], order: str, value: str, size: int, clamp: bool = True) -> DataFrame:
    """Adds ``low`` and ``high``, the extremes of ``size`` consecutive values (``size`` odd). ``clamp`` keeps the edges with fewer values, else only whole windows remain, each at its centre."""
    if size % 2 == 0:
        raise ValueError("the window must be odd")
    half = size // 2
    w = W.partitionBy(*group).orderBy(order).rowsBetween(-half, half)
    out = df.withColumns({"low": F.min(value).over(w), "high": F.max(value).over(w), "_n": F.count(F.lit(1)).over(w)})
    return (out if clamp else out.where(F.col("_n") == size)).drop("_n")


def midi_key(hz: float) -> int:
    import math

    return int(math.floor(12 * math.log2(hz / 440.0) + 69 + 0.5)) if hz > 0 else 0


def log_frequency_windows(config: AlgorithmConfig) -> list[tuple[int, int, int]]:
    """``f, f_start, f_stop`` (stop exclusive) for each bin of a linear spectrum: the bins whose musical key lies within half the filter size.

    A bound whose key no bin has is the first bin above it, one further for the stop. One that several bins share is the bin of that run which halving the whole range first falls on.
    """
    bins, low = config.block_size // 2, config.min_bin
    width = config.sample_rate / config.block_size
    keys = [midi_key(f * width + width / 2) if f >= low else 0 for f in range(bins)]

    half = config.freq_max_filter // 2
    met: dict[int, int] = {}  # the bin on which halving falls for each key that occurs: of a run, the first midpoint inside it
    spans = [(0, bins - 1)]
    while spans:
        a, b = spans.pop()
        mid = (a + b) // 2
        if a > b:
            continue
        met.setdefault(keys[mid], mid)
        spans += [(a, mid - 1), (mid + 1, b)]

    out = []
    for f in range(low, bins):
        start, stop = keys[f] - half, keys[f] + half
        above = lambda key: int(np.searchsorted(keys, key, "left"))
        out.append((f, max(low, met.get(start, above(start))), min(bins, met.get(stop, above(stop) + 1))))
    return out


def vertical_max_log(spectrogram: DataFrame, config: AlgorithmConfig) -> DataFrame:
    """Adds ``vm`` like :func:`vertical_max`, over the log-frequency windows; bins below the least one drop out.

    The frame becomes one array and each maximum a slice of it, so nothing is multiplied by the width of the windows. The windows are literals in the plan.
    """
    rows = log_frequency_windows(config)
    cells = spectrogram.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("f", "m"))).alias("cells"))
    windows = F.arrays_zip(*(F.lit([r[i] for r in rows]).alias(name) for i, name in enumerate(("f", "a", "z"))))
    frames = cells.select(*FRAME, F.col("cells")[0]["f"].alias("low"), F.transform("cells", lambda c: c["m"]).alias("v"))
    low, v = F.col("low"), F.col("v")
    pick = lambda w: F.struct(w["f"].alias("f"), F.get(v, w["f"] - low).alias("m"), F.array_max(F.slice(v, F.greatest(w["a"] - low, F.lit(0)) + 1, F.greatest(w["z"] - F.greatest(w["a"], low), F.lit(0)))).alias("vm"))
    return frames.select(*FRAME, F.inline(F.transform(windows, pick))).where(F.col("m").isNotNull())


def event_points(spectrogram: DataFrame, config: AlgorithmConfig, bins: int) -> DataFrame:
    """``resource_id, t, f, m`` of the event points; ``m`` becomes the sum of the 3 x 3 cells around the point.

    A point equals the maximum of its bins and of its frames and isn't 0; it lies between the least bin and the last but one of ``bins``, and frames without a
    full time window around them give none: the frame half a window later must exist. The sums ride on the two windows of the filters, so they cost no further shuffle.
    """
    half_f, half_t = config.freq_max_filter // 2, config.time_max_filter // 2
    if config.kind == "fft":
        x = vertical_max_log(spectrogram, config)
        x = x.withColumn("vs", F.sum("m").over(_frame(-1, 1)))
    else:
        x = spectrogram.withColumns({"vm": F.max("m").over(_frame(-half_f, half_f)), "vs": F.sum("m").over(_frame(-1, 1))})
    x = _blocked(x, max(half_t, 1), BLOCK)
    x = x.withColumns({"hm": F.max("vm").over(_bin(-half_t, half_t - 1)), "m9": F.sum("vs").over(_bin(-1, 1)), "_later": F.max("t").over(_bin(half_t, half_t))})
    c = F.col
    found = x.where(_own() & (c("m") == c("vm")) & (c("m") == c("hm")) & (c("m") != 0) & c("f").between(config.min_bin, bins - 2) & (c("t") >= half_t) & c("_later").isNotNull())
    return found.select("resource_id", "t", "f", c("m9").alias("m"))


def magnitude_3x3(spectrogram: DataFrame) -> DataFrame:
    """Adds ``m9``: the sum over the cell and its eight neighbours that exist."""
    x = _blocked(spectrogram.withColumn("vs", F.sum("m").over(_frame(-1, 1))), 1, BLOCK)
    return x.withColumn("m9", F.sum("vs").over(_bin(-1, 1))).where(_own()).drop("vs", "_block")
