"""Monitoring: each long recording is asked for in overlapping windows, all in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolattice.config import AlgorithmConfig
from echolattice.functions.names import window_label
from echolattice.operators.match import query, seconds, with_empty


def windows(durations: DataFrame, window: float = 25.0, overlap: float = 5.0) -> DataFrame:
    """``resource_id, start, stop`` of the windows of each resource (``resource_id, duration``): every ``window - overlap`` seconds while a whole window ends before the recording does. A null duration gives none."""
    step = window - overlap
    last = F.ceil((F.col("duration") - window) / step).cast("int") - 1
    starts = F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")))
    return durations.select("resource_id", starts.alias("_i")).select("resource_id", (F.col("_i") * step).alias("start"), (F.col("_i") * step + window).alias("stop"))


def window_numbers(at: Column, last: Column, window: float, step: float) -> Column:
    """Numbers, 0 to ``last``, of the windows that hold ``at`` with both ends: worked out from the time, one more to either side, and compared with the windows' own ends."""
    low, high = F.greatest(F.ceil((at - window) / step) - 1, F.lit(0)), F.least(F.floor(at / step) + 1, last)
    near = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    return F.filter(near, lambda i: at.between(i * step, i * step + window))


def in_windows(prints: DataFrame, durations: DataFrame, config: AlgorithmConfig, window: float = 25.0, overlap: float = 5.0) -> DataFrame:
    """Prints of each window of :func:`windows`, both ends inclusive: a print in an overlap belongs to both. ``query_id`` is a struct of resource and start. A print meets only its own windows, however long the recording is."""
    step = window - overlap
    count = durations.groupBy("resource_id").agg((F.ceil((F.max("duration") - window) / step) - 1).alias("_last")).where("_last >= 0")
    x = prints.join(count, "resource_id").withColumn("_i", F.explode(window_numbers(seconds(F.col("t1"), config), F.col("_last"), window, step)))
    return x.select(F.struct("resource_id", (F.col("_i") * step).alias("start")).alias("query_id"), "hash", "t1", "f1")


def monitor(prints: DataFrame, index: DataFrame, durations: DataFrame, config: AlgorithmConfig, window: float = 25.0, overlap: float = 5.0, most: int = 1000, avoid_self: bool = False, empty: bool = False) -> DataFrame:
    """``resource_id, start, stop, label`` and the results of each window. With ``avoid_self`` a recording's own postings don't count; with ``empty`` a window without a result has an empty one."""
    spans = windows(durations, window, overlap).select(F.struct("resource_id", "start").alias("query_id"), "resource_id").distinct()
    found = query(in_windows(prints, durations, config, window, overlap), index, config, most, spans if avoid_self else None)
    if empty:
        found = with_empty(spans.select("query_id"), found)
    out = found.select(F.col("query_id.resource_id").alias("resource_id"), F.col("query_id.start").alias("start"), *(c for c in found.columns if c != "query_id"))
    return out.withColumn("stop", F.col("start") + window).withColumn("label", window_label(F.col("resource_id").cast("string"), F.col("start"), F.col("start") + window))
