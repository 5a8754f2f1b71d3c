"""Evaluation of results: confusion by modification, plausible and mutual results, speeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echolattice.functions.names import basename, evaluation_name
from echolattice.functions.units import ratio_to_cent
from echolattice.operators.skew import join_unique
from echolattice.runtime import Written


def with_in_index(results: DataFrame, resources: DataFrame) -> DataFrame:
    """The first result of each query path (``query_path, ref_path, rank``) with ``in_index``: whether the base name of the query is that of a ``path`` in ``resources``."""
    first = results.groupBy("query_path").agg(F.min_by("ref_path", "rank").alias("ref_path"), F.min("rank").alias("rank"))
    known = resources.where("path IS NOT NULL").select(basename(F.col("path")).alias("_base")).distinct().withColumn("in_index", F.lit(True))
    x = first.withColumn("_base", evaluation_name(F.col("query_path"))["base"]).join(known, "_base", "left")
    return x.select("query_path", "ref_path", "rank", F.coalesce("in_index", F.lit(False)).alias("in_index"))


def outcomes(results: DataFrame) -> DataFrame:
    """One row a query path: modification, factor, and its outcome from ``query_path, ref_path, rank, in_index``: tp if the first match is the right recording, fp if it is another, fn or tn without a match."""
    parts = evaluation_name(F.col("query_path"))
    first = results.groupBy("query_path").agg(F.min_by("ref_path", "rank").alias("ref_path"), F.first("in_index").alias("in_index"))
    right = basename(F.col("ref_path")) == parts["base"]
    kind = F.when(F.col("ref_path").isNull(), F.when(F.col("in_index"), "fn").otherwise("tn")).when(right, "tp").otherwise("fp")
    return first.select("query_path", parts["modification"].alias("modification"), parts["factor"].alias("factor"), kind.alias("outcome"))


def confusion(results: DataFrame) -> DataFrame:
    """``modification, factor, queries, tp, fp, fn, tn`` as shares of the queries; the unmodified reference also stands as factor 1.0 of the three graded modifications."""
    x = outcomes(results)
    graded = F.when(F.col("modification") == "reference", F.array(*(F.struct(F.lit(m).alias("modification"), F.lit(f).cast("double").alias("factor")) for m, f in (("reference", None), ("pitch_shift", 1.0), ("time_stretched", 1.0), ("speed_up", 1.0))))).otherwise(F.array(F.struct("modification", "factor")))
    x = x.select(F.inline(graded), "outcome")
    share = lambda k: F.avg((F.col("outcome") == k).cast("double")).alias(k)
    return x.groupBy("modification", "factor").agg(F.count(F.lit(1)).alias("queries"), *(share(k) for k in ("tp", "fp", "fn", "tn")))


def acceptable(lines: DataFrame, least_score: int = 15, shortest: float = 3, longest: float = 500_000, least_rate: float = 5, last_column: float = 0.7, last_is_covered: bool = False) -> DataFrame:
    """Result lines worth looking at: not of a file with itself, scored enough in total and a second, neither too short nor too long.

    The last column is held to be at most ``last_column`` as if it were the share of seconds without a match; with ``last_is_covered`` it is read as what it is, the share with one, which must reach 1 - ``last_column``.
    """
    c = F.col
    span = c("query_stop") - c("query_start")
    last = (c("coverage") >= 1 - last_column) if last_is_covered else (c("coverage") <= last_column)
    return lines.where((basename(c("query_path")) != basename(c("ref_path"))) & (c("match_score") >= least_score) & span.between(shortest, longest) & (c("match_score") / span > least_rate) & last).orderBy(F.desc("match_score"))


def symmetric_pairs(lines: DataFrame) -> DataFrame:
    """Adds ``symmetric``: whether exactly two lines have this unordered pair of names."""
    a, b = basename(F.col("query_path")), basename(F.col("ref_path"))
    stored = Written(lines.withColumn("_pair", F.concat_ws("\n", F.least(a, b), F.greatest(a, b))), "pairs")
    counts = stored.df.groupBy("_pair").agg((F.count(F.lit(1)) == 2).alias("symmetric"))
    return join_unique(stored.df, counts, "_pair", rows=stored.rows).drop("_pair")


#: Effects without a grade, and the graded modifications with their factors: 0.84 to 1.16 in steps of 0.02 without 1.
EFFECTS = ("flanger", "band_passed_2000Hz", "chorus", "echo", "tremolo")
GRADED = ("pitch_shift", "time_stretched", "speed_up")
FACTORS = tuple(round(0.84 + 0.02 * i, 2) for i in range(17) if i != 8)


def evaluation_plan(resources: DataFrame, lengths: tuple[int, ...] = (10, 20)) -> DataFrame:
    """``resource_id, in_index, query_name, modification, factor, cents`` of all queries made from ``resource_id, path, duration``: a fifth of the resources is held out of the index; each gives an unmodified query and one of each modification, of each length.

    The part asked for begins at a second that depends only on the id. Resources shorter than a length (or without duration) give none of it. ``cents`` is the pitch shift of a factor.
    """
    versions = [("reference", None), *((e, None) for e in EFFECTS), *((g, f) for g in GRADED for f in FACTORS)]
    grid = F.array(*(F.struct(F.lit(m).alias("modification"), F.lit(f).cast("double").alias("factor")) for m, f in versions))
    x = resources.where("duration IS NOT NULL").select("resource_id", (F.col("resource_id") % 5 != 0).alias("in_index"), basename(F.col("path")).alias("_base"), F.floor("duration").alias("_d"), F.explode(F.lit(list(lengths))).alias("_n"))
    x = x.where(F.col("_d") >= F.col("_n")).withColumn("_start", F.col("resource_id") % F.greatest(F.col("_d") - F.col("_n"), F.lit(1)))
    x = x.select("*", F.inline(grid))
    grade = F.when(F.col("factor").isNull(), "").otherwise(F.concat(F.lit("_"), F.col("factor").cast("string")))
    tail = F.when(F.col("modification") == "reference", "").otherwise(F.concat(F.lit("___"), "modification", grade))
    name = F.concat("_base", F.lit("_"), F.col("_start").cast("string"), F.lit("s-"), (F.col("_start") + F.col("_n")).cast("string"), F.lit("s"), tail, F.lit(".mp3"))
    return x.select("resource_id", "in_index", name.alias("query_name"), "modification", "factor", F.when(F.col("modification") == "pitch_shift", F.round(ratio_to_cent(F.col("factor"))).cast("int")).alias("cents"))


def speeds(runs: DataFrame) -> DataFrame:
    """``step, cumulative_seconds, store_speed, query_speed`` from ``step, kind ('store' or 'query'), audio_seconds, wall_seconds``: seconds of audio a second, and the audio stored so far."""
    of = lambda k, c: F.sum(F.when(F.col("kind") == k, F.col(c)))
    x = runs.groupBy("step").agg(of("store", "audio_seconds").alias("_a"), of("store", "wall_seconds").alias("_w"), of("query", "audio_seconds").alias("_qa"), of("query", "wall_seconds").alias("_qw"))
    return x.select("step", F.sum("_a").over(W.orderBy("step").rowsBetween(W.unboundedPreceding, 0)).alias("cumulative_seconds"), F.try_divide("_a", "_w").alias("store_speed"), F.try_divide("_qa", "_qw").alias("query_speed"))
