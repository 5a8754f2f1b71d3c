"""Text caches of prints and metadata, event-point files, and the printed result line."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolattice.config import AlgorithmConfig
from echolattice.operators.match import seconds
from echolattice.runtime import shuffle_partitions


def read_prints(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``hash, resource_id, t1, f1`` from lines ``hash id t1 [f1]``; f1 is null where a line has three fields."""
    return spark.read.schema("hash bigint, resource_id int, t1 int, f1 int").option("sep", " ").option("mode", "PERMISSIVE").csv(paths)


#: Folders of the print cache; a resource's lines are in one of them.
BUCKETS = 256


def write_prints(prints: DataFrame, path: str, with_bin: bool = True) -> None:
    """Lines sorted by resource and time in ``bucket=N`` folders, a fixed number whatever the number of resources; ranges of (bucket, resource, time) are cut so that a long resource is several files. All columns are in the line, so reading needs no partition discovery."""
    cols = ["hash", "resource_id", "t1", *(["f1"] if with_bin else [])]
    order = ("bucket", "resource_id", "t1", "hash")
    x = prints.withColumn("bucket", F.pmod(F.hash("resource_id"), F.lit(BUCKETS)))
    lines = x.repartitionByRange(shuffle_partitions(prints.sparkSession), *order).sortWithinPartitions(*order).select("bucket", F.concat_ws(" ", *cols).alias("value"))
    lines.write.mode("append").partitionBy("bucket").text(path)


def frames_between(start: float, stop: float, config: AlgorithmConfig) -> tuple[int, int]:
    """First and last frame whose time in seconds lies in the range, both ends inclusive."""
    step, late = config.seconds_per_block, config.latency_seconds if config.kind == "constant_q" else 0.0
    low, high = math.floor((start - late) / step), math.ceil((stop - late) / step)
    while low * step + late < start:
        low += 1
    while high * step + late > stop:
        high -= 1
    return low, high


def between_seconds(prints: DataFrame, start: float, length: float, config: AlgorithmConfig) -> DataFrame:
    """Prints whose first point lies within the range, both ends inclusive: bounds on the frame itself, so the scan can apply them."""
    return prints.where(F.col("t1").between(*frames_between(start, start + length, config)))


def write_metadata(metadata: DataFrame, path: str) -> None:
    """Files of four lines a resource: id, duration, count, path; records are separated by an empty line."""
    metadata.select(F.concat_ws("\n", F.col("resource_id").cast("string"), F.col("duration").cast("string"), F.col("num_fingerprints").cast("string"), F.col("path")).alias("value")).write.mode("append").option("lineSep", "\n\n").text(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The same back; records that don't have four lines or valid numbers are left out."""
    x = spark.read.option("lineSep", "\n\n").text(path).select(F.split(F.trim("value"), "\r?\n").alias("v")).where(F.size("v") == 4)
    out = x.select(F.col("v")[0].try_cast("int").alias("resource_id"), F.col("v")[3].alias("path"), F.col("v")[1].try_cast("double").alias("duration"), F.col("v")[2].try_cast("bigint").alias("num_fingerprints"))
    return out.where("resource_id IS NOT NULL AND duration IS NOT NULL AND num_fingerprints IS NOT NULL")


def read_event_points(spark: SparkSession, paths: str | list[str], resource: Column) -> DataFrame:
    """Event points of an external extractor: lines ``t f m``."""
    return spark.read.schema("t int, f int, m double").option("sep", " ").csv(paths).select(resource.alias("resource_id"), "t", "f", "m")


# The printed form of a result, which other programs read.
HEADER = "Index; Total ; Query path;Query start (s);Query stop (s); Match path;Match id; Match start (s); Match stop (s); Match score; Time factor (%); Frequency factor(%); Seconds with match (%)"
RESULT_FORMAT = "%s ; %s ; %s ; %.3f ; %.3f ; %s ; %s ; %.3f ; %.3f ; %d ; %.3f %% ; %.3f %%; %.2f"


def result_lines(results: DataFrame, *keep: str) -> DataFrame:
    """``line``: thirteen fields separated by ``;``, beside the columns ``keep``. ``results`` has query_index, total_queries, query_path, query_start, query_stop, ref_path, ref_id, ref_start, ref_stop, match_score, time_factor, frequency_factor, coverage; nulls print as ``null``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    line = F.format_string(
        RESULT_FORMAT,
        text("query_index"), text("total_queries"), text("query_path"), "query_start", "query_stop", text("ref_path"), text("ref_id"), "ref_start", "ref_stop", "match_score", "time_factor", "frequency_factor", "coverage",
    )
    return results.select(*keep, line.alias("line"))


def event_point_table(points: DataFrame, config: AlgorithmConfig, hertz: Column) -> DataFrame:
    """Event points with their time in seconds and frequency in hertz."""
    return points.select("resource_id", "t", seconds(F.col("t"), config).alias("seconds"), "f", hertz.alias("hertz"), "m")


def dense_matrix(prints: DataFrame, bins: int) -> DataFrame:
    """``resource_id, t, line``: for each frame from 0 to the last the magnitudes of all bins, 0 where no print has a point. One row a frame, built by frame."""
    point = lambda i: F.struct(F.col(f"t{i}").alias("t"), F.col(f"f{i}").alias("f"), F.col(f"m{i}").alias("m"))
    cells = prints.select("resource_id", F.inline(F.array(point(1), point(2), point(3)))).groupBy("resource_id", "t", "f").agg(F.max("m").alias("m"))
    frames = cells.groupBy("resource_id", "t").agg(F.map_from_entries(F.collect_list(F.struct("f", "m"))).alias("row"))
    every = cells.groupBy("resource_id").agg(F.max("t").alias("last")).select("resource_id", F.explode(F.sequence(F.lit(0), "last")).alias("t"))
    values = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda f: F.coalesce(F.try_element_at("row", f), F.lit(0.0)).cast("string"))
    return every.join(frames, ["resource_id", "t"], "left").select("resource_id", "t", F.concat_ws(" ", values).alias("line"))
