"""Live monitoring: a stream of query prints, windowed by event time, matched against the stored index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolattice.config import AlgorithmConfig
from echolattice.operators.match import query, seconds
from echolattice.operators.monitor import window_numbers


def windowed_prints(stream: DataFrame, config: AlgorithmConfig, delay: float = 10.0, window: float = 25.0, overlap: float = 5.0, durations: DataFrame | None = None) -> DataFrame:
    """``resource_id, start, prints`` of each closed window of a stream ``resource_id, at TIMESTAMP, hash, t1, f1``: those of :func:`operators.monitor.windows`, from the recording's own seconds, both ends inclusive, none before 0.

    ``at`` is when a print was made. A window closes once prints ``delay`` seconds beyond its end (and up to a step more) have come, and later prints of it are dropped. Of a recording
    with a ``duration`` in ``durations`` only the windows that end before it does count; without one every window that passes is whole, since a live stream goes on.
    A window's prints of one resource are one state row: it is bounded by what a recording gives in a window.
    """
    step, at = window - overlap, seconds(F.col("t1"), config)
    last = F.lit(2**31 - 1)
    if durations is not None:
        count = durations.groupBy("resource_id").agg((F.ceil((F.max("duration") - window) / step) - 1).alias("_last"))
        stream, last = stream.join(count, "resource_id", "left"), F.coalesce(F.col("_last"), F.lit(2**31 - 1))
    x = stream.withColumn("_i", F.explode(window_numbers(at, last, window, step))).withColumn("start", F.col("_i") * step)
    x = x.withColumn("closes", F.col("at") + F.make_dt_interval(secs=(F.col("start") + window - at).cast("decimal(18,6)")))
    closed = x.withWatermark("closes", f"{int((window + delay) * 1000)} milliseconds").groupBy("closes", "resource_id", "start").agg(F.collect_list(F.struct("hash", "t1", "f1")).alias("prints"))
    return closed.select("resource_id", "start", "prints")


def match_batch(windows: DataFrame, index: DataFrame, config: AlgorithmConfig, most: int = 1) -> DataFrame:
    """Results of the windows that closed in a batch."""
    asked = windows.select(F.struct("resource_id", "start").alias("query_id"), F.inline("prints"))
    found = query(asked, index, config, most)
    return found.select(F.col("query_id.resource_id").alias("resource_id"), F.col("query_id.start").alias("start"), *(c for c in found.columns if c != "query_id"))


def start(stream: DataFrame, index: DataFrame, config: AlgorithmConfig, checkpoint: str, sink: Callable[[DataFrame, int], None], **options: object):
    """Run the monitor: each closed window is matched once; ``sink(results, batch)`` must replace what an earlier attempt of the same batch wrote."""

    def on_batch(windows: DataFrame, batch: int) -> None:
        sink(match_batch(windows, index, config), batch)

    return windowed_prints(stream, config, **options).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(on_batch)
