"""Fingerprints: two or three event points of a resource that lie close in time and frequency.

The pairs within a band of time are found by an equi-join on (resource, time slot): a point is sent to its own slot and the next one, as
long as a slot is as wide as the largest distance. So a long resource spreads over its slots and no resource is paired as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolattice.config import AlgorithmConfig
from echolattice.functions.hashing import hash_constant_q, hash_fft

KEY = "resource_id"


def _step(left: DataFrame, points: DataFrame, i: int, config: AlgorithmConfig) -> DataFrame:
    """Rows of ``left`` with each point ``i + 1`` that may follow its point ``i``."""
    wide = config.max_time_distance
    slot = F.floor(F.col(f"t{i}") / wide)
    a = left.withColumn("_slot", F.explode(F.array(slot, slot + 1)))
    b = points.select(F.col(KEY).alias("_r"), F.col("t").alias(f"t{i + 1}"), F.col("f").alias(f"f{i + 1}"), F.col("m").alias(f"m{i + 1}"), F.floor(F.col("t") / wide).alias("_s"))
    dt, df = F.col(f"t{i + 1}") - F.col(f"t{i}"), F.abs(F.col(f"f{i}") - F.col(f"f{i + 1}"))
    near = dt.between(config.min_time_distance, wide) & df.between(config.min_freq_distance, config.max_freq_distance)
    return a.join(b, (F.col(KEY) == F.col("_r")) & (F.col("_slot") == F.col("_s")) & near).drop("_slot", "_s", "_r")


def pack(points: DataFrame, config: AlgorithmConfig) -> DataFrame:
    """``resource_id, t1, f1, m1, ..., t3, f3, m3``: all chains of points with each step within the bands. With two points a print the third equals the second.

    Every chain counts, there is no cap on how many a point begins; repeated points give repeated prints; points with a null give none.
    """
    points = points.select(KEY, "t", "f", "m")
    out = _step(points.select(KEY, F.col("t").alias("t1"), F.col("f").alias("f1"), F.col("m").alias("m1")), points, 1, config)
    if config.points_per_print == 2:
        return out.withColumns({"t3": F.col("t2"), "f3": F.col("f2"), "m3": F.col("m2")})
    return _step(out, points, 2, config)


def with_hash(prints: DataFrame, config: AlgorithmConfig) -> DataFrame:
    return prints.withColumn("hash", hash_fft() if config.kind == "fft" else hash_constant_q())


def fingerprints(points: DataFrame, config: AlgorithmConfig) -> DataFrame:
    """Prints of :func:`pack` with their ``hash``."""
    return with_hash(pack(points, config), config)


def same_print(left: DataFrame, right: DataFrame, frames: int = 100) -> DataFrame:
    """Pairs of prints with one hash whose first points lie less than ``frames`` apart. They are met by (hash, slot of ``frames`` frames), a left print in its own slot and its neighbours, so prints of a frequent hash meet only those nearby."""
    slot = lambda t: F.floor(t / frames)
    a = left.select(*(F.col(c).alias(f"a_{c}") for c in left.columns)).withColumn("_slot", F.explode(F.array(*(slot(F.col("a_t1")) + i for i in (-1, 0, 1)))))
    b = right.select(*(F.col(c).alias(f"b_{c}") for c in right.columns)).withColumn("_at", slot(F.col("b_t1")))
    return a.join(b, (F.col("a_hash") == F.col("b_hash")) & (F.col("_slot") == F.col("_at")) & (F.abs(F.col("a_t1") - F.col("b_t1")) < frames)).drop("_slot", "_at")
