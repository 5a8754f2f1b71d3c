"""Inputs of the engine derived from the given tables: spectrograms, event points, pitches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echolattice.config import CONSTANT_Q, FFT
from echolattice.operators.fingerprints import fingerprints
from echolattice.operators.peaks import event_points
from echolattice.sources.tables import table

#: 64 bands instead of some 510: filters are scaled; a frame is a second.
SMALL = CONSTANT_Q.but(freq_max_filter=21, time_max_filter=9, sample_rate=128, block_step=128)
SMALL_FFT = FFT.but(freq_max_filter=20, time_max_filter=9, sample_rate=128, block_step=128, block_size=128, min_bin=2)
BANDS = 64


def spectrogram(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as frames: a label is a resource, its vectors in order are its frames, the absolute values the magnitudes. Frames are numbered before the vectors are exploded."""
    frames = table(spark, folder, "embeddings").select(F.col("label").alias("resource_id"), (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).alias("t"), "embedding")
    return frames.select("resource_id", "t", F.posexplode("embedding").alias("f", "v")).select("resource_id", "t", "f", F.abs(F.col("v").cast("double")).alias("m"))


def points(spark: SparkSession, folder: str) -> DataFrame:
    return event_points(spectrogram(spark, folder), SMALL, BANDS)


def perturbed(x: DataFrame) -> DataFrame:
    """Event points of four queries a recording: as it is, a crop, three bins higher, and 20/21 of the time. ``query_id`` = 100 * kind + recording."""
    t, f = F.col("t"), F.col("f")
    versions = [(t, f, F.lit(True)), (t - 10, f, t.between(10, 34)), (t, f + 3, F.lit(True)), (F.expr("CAST((t * 20) div 21 AS INT)"), f, F.lit(True))]
    rows = F.array(*(F.when(ok, F.struct((F.lit(100 * k) + F.col("resource_id")).alias("query_id"), a.cast("int").alias("qt"), b.cast("int").alias("qf"))) for k, (a, b, ok) in enumerate(versions)))
    return x.select(F.inline(F.array_compact(rows)), "m").select(F.col("query_id").alias("resource_id"), F.col("qt").alias("t"), F.col("qf").alias("f"), "m")


def query_prints(points: DataFrame) -> DataFrame:
    return fingerprints(perturbed(points), SMALL).select(F.col("resource_id").alias("query_id"), "hash", "t1", "f1")


def index(points: DataFrame) -> DataFrame:
    return fingerprints(points, SMALL).select("hash", "resource_id", "t1", "f1")


def volume_points(spark: SparkSession, folder: str) -> DataFrame:
    """Events as event points: users are resources, whole hours frames, whole values bins."""
    e = table(spark, folder, "events")
    hours = F.expr("CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) div 3600 AS INT)")
    return e.select(F.col("user_id").alias("resource_id"), hours.alias("t"), F.floor("value").cast("int").alias("f"), F.col("value").alias("m"))


def pcm_blocks(spark: SparkSession, folder: str, per_block: int = 64, tail: int = 14) -> DataFrame:
    """Embeddings as sound: the vectors of a label one after the other are its samples, cut into blocks that carry as much of the next one as a window looks at beyond its step, 896 samples (``resource_id, first_frame, samples``)."""
    frames = table(spark, folder, "embeddings").select(F.col("label").alias("resource_id"), (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).alias("t"), "embedding")
    block = F.floor(F.col("t") / per_block)
    both = F.when((F.col("t") % per_block < tail) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    x = frames.select("resource_id", "t", "embedding", F.explode(both).alias("block")).groupBy("resource_id", "block").agg(F.array_sort(F.collect_list(F.struct("t", "embedding"))).alias("v"))
    return x.select("resource_id", (F.col("block") * (per_block * 64 // 128)).cast("int").alias("first_frame"), F.flatten(F.transform("v", lambda e: e["embedding"])).alias("samples"))


def pitches(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("user_id").cast("int").alias("resource_id"), (F.col("value") + 20).alias("hz"))
