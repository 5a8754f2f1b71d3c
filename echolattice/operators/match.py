"""Matching: from the prints of all queries to aligned, validated and ranked results, in one plan.

After the lookup every step works on groups of (query, reference), and all of them share one hash partitioning on that pair, so the
chain of windows and aggregates costs a single shuffle of the hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echolattice.config import AlgorithmConfig
from echolattice.operators.blocks import aligned_pairs, hit_counts  # noqa: F401 - hit_counts is part of matching
from echolattice.operators.index import only_parts, small
from echolattice.runtime import Written

PAIR = ("query_id", "ref_id")
#: Hits in time order, with a full tie rule.
ORDER = ("query_time", "match_time", "hash", "near_hash", "match_f1")


def seconds(t: Column, config: AlgorithmConfig) -> Column:
    """Frame to seconds; the transform's latency counts for the constant-Q algorithm only."""
    return t * F.lit(config.seconds_per_block) + F.lit(config.latency_seconds if config.kind == "constant_q" else 0.0)


def bin_hertz(f: Column, config: AlgorithmConfig) -> Column:
    """Centre of a bin: logarithmic for constant-Q, linear for the FFT."""
    if config.kind == "constant_q":
        return F.lit(config.min_frequency) * F.pow(F.lit(2.0), f / F.lit(float(config.bands_per_octave)))
    width = config.sample_rate / config.block_size
    return f * F.lit(width) + F.lit(width / 2)


def near_hash_join(queries: DataFrame, index: DataFrame, config: AlgorithmConfig, avoid: DataFrame | None = None) -> DataFrame:
    """``query_id, ref_id, query_time, query_f1, match_time, match_f1, hash, near_hash, delta_t``: postings whose hash lies within ``query_range`` of a query print's.

    ``queries`` has ``query_id, hash, t1, f1``, ``index`` ``hash, resource_id, t1, f1``. Repeated query prints repeat their hits; the time and bin of a hash are those of its last print.
    ``avoid`` (``query_id, resource_id``) are references that a query must not meet; they are a condition of the join itself. The range becomes 2 * range + 1 equal hashes, so the join is an equi-join.

    The query side is stored and its size known: up to MOST_BROADCAST_ROWS it goes to the postings, which then aren't shuffled, so a hash that holds a large part of the index stays where it lies; a larger one
    meets them in a shuffle in which adaptive execution splits hot hashes. An index with a column ``part`` (see :mod:`index`) is read only in the parts of the query hashes;
    the postings of one with a column ``query_id`` are for that query alone.
    """
    r = config.query_range
    last = F.max(F.struct("t1", "f1"))
    asked = queries.where("hash IS NOT NULL").groupBy("query_id", "hash").agg(F.count(F.lit(1)).alias("_times"), last.alias("_last"))
    asked = asked.select("query_id", "hash", "_times", F.col("_last.t1").alias("query_time"), F.col("_last.f1").alias("query_f1"), F.explode(F.sequence(F.col("hash") - r, F.col("hash") + r)).alias("near_hash"))
    if avoid is not None:
        asked = asked.join(avoid.groupBy("query_id").agg(F.collect_set("resource_id").alias("_avoid")), "query_id", "left")
    stored = Written(asked, "asked")
    if "part" in index.columns:
        index = only_parts(index, stored, "near_hash")
    postings = index.select(F.col("hash").alias("_near"), F.col("resource_id").alias("ref_id"), F.col("t1").alias("match_time"), F.col("f1").alias("match_f1"), *([F.col("query_id").alias("_only")] if "query_id" in index.columns else []))
    condition = F.col("near_hash") == F.col("_near")
    if "query_id" in index.columns:
        condition = condition & (F.col("query_id") == F.col("_only"))
    if avoid is not None:
        condition = condition & ~F.coalesce(F.array_contains("_avoid", F.col("ref_id")), F.lit(False))
    hits = postings.join(small(stored.df, stored.rows), condition).withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return hits.select("query_id", "ref_id", "query_time", "query_f1", "match_time", "match_f1", "hash", "near_hash", (F.col("match_time") - F.col("query_time")).alias("delta_t"))


def enough_hits(hits: DataFrame, config: AlgorithmConfig) -> DataFrame:
    """Hits of pairs with at least ``min_hits_unfiltered``, with their number ``n_hits`` and place ``rn`` in time."""
    pair = W.partitionBy(*PAIR)
    hits = hits.withColumns({"n_hits": F.count(F.lit(1)).over(pair), "rn": F.row_number().over(pair.orderBy(*ORDER))})
    return hits.where(F.col("n_hits") >= config.min_hits_unfiltered)


def hit_parts(hits: DataFrame, config: AlgorithmConfig) -> DataFrame:
    """Adds ``in_first`` and ``in_last``: the first and last min(250, max(10, n / 5)) hits of a pair."""
    size = F.least(F.lit(config.part_max_size), F.greatest(F.lit(config.min_hits_unfiltered), F.expr(f"CAST(n_hits div {config.part_divider} AS INT)")))
    return hits.withColumn("part_size", size).withColumns({"in_first": F.col("rn") <= F.col("part_size"), "in_last": F.col("rn") > F.col("n_hits") - F.col("part_size")})


def modal_deltas(parts: DataFrame) -> DataFrame:
    """``query_id, ref_id, y1, y2, x1, x2, first_f1, first_query_f1``: the most frequent time difference of each part (the smallest among equals) and the query time of its first hit in the first, last hit in the last part."""
    def of(flag: str) -> Column:
        return F.sum(F.col(flag).cast("int"))
    mine = parts.groupBy(*PAIR, "delta_t").agg(
        of("in_first").alias("n1"), of("in_last").alias("n2"),
        F.min(F.when(F.col("in_first"), F.struct("rn", "query_time", "match_f1", "query_f1"))).alias("a"), F.max(F.when(F.col("in_last"), F.struct("rn", "query_time"))).alias("b"),
    )
    best = lambda n: F.struct(F.col(n), -F.col("delta_t"))
    out = mine.groupBy(*PAIR).agg(F.max_by(F.struct("delta_t", "a"), best("n1")).alias("p"), F.max_by(F.struct("delta_t", "b"), best("n2")).alias("q"))
    return out.select(*PAIR, F.col("p.delta_t").alias("y1"), F.col("p.a.query_time").alias("x1"), F.col("q.delta_t").alias("y2"), F.col("q.b.query_time").alias("x2"), F.col("p.a.match_f1").alias("first_f1"), F.col("p.a.query_f1").alias("first_query_f1"))


def alignment(modes: DataFrame, config: AlgorithmConfig) -> DataFrame:
    """Adds ``slope, offset, time_factor, freq_factor, exact_speed_ratio``. Null factors (a single query time) mean no alignment.

    The time factor is 1 / (1 - slope) for constant-Q and 1 - slope for the FFT; the frequency factor is the reference's over the query's frequency. ``exact_speed_ratio`` is 1 + slope.
    """
    # also works on hits that carry their modes (:func:`with_modes`)
    x = modes.withColumn("slope", F.try_divide((F.col("y2") - F.col("y1")).cast("double"), (F.col("x2") - F.col("x1")).cast("double")))
    x = x.withColumn("offset", F.col("y1") - F.col("x1") * F.col("slope"))
    if config.kind == "constant_q":
        time, freq = F.try_divide(F.lit(1.0), 1 - F.col("slope")), F.try_divide(bin_hertz(F.col("first_f1"), config), bin_hertz(F.col("first_query_f1"), config))
    else:
        time, freq = 1 - F.col("slope"), F.lit(1.0)
    return x.withColumns({"time_factor": time, "freq_factor": freq, "exact_speed_ratio": 1 + F.col("slope")})


def plausible(aligned: DataFrame, config: AlgorithmConfig) -> DataFrame:
    c = F.col
    return aligned.where((c("time_factor") > config.min_time_factor) & (c("time_factor") < config.max_time_factor) & (c("freq_factor") > config.min_freq_factor) & (c("freq_factor") < config.max_freq_factor))


def with_modes(parts: DataFrame) -> DataFrame:
    """Hits with the columns of :func:`modal_deltas` beside them, by windows on the pair: no second use of the hits and no exchange."""
    d, p = W.partitionBy(*PAIR, "delta_t"), W.partitionBy(*PAIR)
    count = lambda flag: F.sum(F.col(flag).cast("int")).over(d)
    x = parts.withColumns({
        "_n1": count("in_first"), "_n2": count("in_last"),
        "_a": F.min(F.when(F.col("in_first"), F.struct("rn", "query_time", "match_f1", "query_f1"))).over(d), "_b": F.max(F.when(F.col("in_last"), F.struct("rn", "query_time"))).over(d),
    })
    best = lambda n, v: F.max(F.struct(F.col(n).alias("n"), (-F.col("delta_t")).alias("d"), F.col(v).alias("v"))).over(p)
    x = x.withColumns({"_p": best("_n1", "_a"), "_q": best("_n2", "_b")})
    return x.withColumns({"y1": -F.col("_p.d"), "x1": F.col("_p.v.query_time"), "y2": -F.col("_q.d"), "x2": F.col("_q.v.query_time"), "first_f1": F.col("_p.v.match_f1"), "first_query_f1": F.col("_p.v.query_f1")}).drop("_n1", "_n2", "_a", "_b", "_p", "_q")


def on_line(aligned: DataFrame, config: AlgorithmConfig) -> DataFrame:
    """Aligned hits within ``query_range`` of their pair's line."""
    return aligned.where(F.abs(F.col("delta_t") - (F.col("slope") * F.col("query_time") + F.col("offset"))) <= config.query_range)


def summarize(hits: DataFrame, config: AlgorithmConfig) -> DataFrame:
    """One row a pair: times of its first and last hit, score, factors, and the share of seconds with a match; only those that last and score enough and are covered enough."""
    pair = W.partitionBy(*PAIR).orderBy(*ORDER)
    whole = pair.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sec = lambda c: seconds(F.col(c), config)
    x = hits.withColumns({"_a": F.first("match_time").over(whole), "_z": F.last("match_time").over(whole)})
    x = x.withColumn("_bin", (sec("match_time") - sec("_a")).cast("int"))
    per_bin = x.groupBy(*PAIR, "_bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("query_time").alias("q0"), F.max("query_time").alias("q1"), F.first("_a").alias("_a"), F.first("_z").alias("_z"), F.first("time_factor").alias("time_factor"), F.first("freq_factor").alias("freq_factor")
    )
    out = per_bin.groupBy(*PAIR).agg(
        F.min("q0").alias("_q0"), F.max("q1").alias("_q1"), F.first("_a").alias("_a"), F.first("_z").alias("_z"), F.sum("n").alias("score"), F.first("time_factor").alias("time_factor"), F.first("freq_factor").alias("freq_factor"), F.count(F.lit(1)).alias("_bins")
    )
    span = F.ceil(sec("_z") - sec("_a"))
    out = out.select(
        *PAIR, sec("_q0").alias("query_start"), sec("_q1").alias("query_stop"), sec("_a").alias("ref_start"), sec("_z").alias("ref_stop"), "score", "time_factor", "freq_factor",
        (1 - F.try_divide((span - F.col("_bins")).cast("double"), span.cast("double"))).alias("coverage"),
    )
    return out.where((F.col("score") > config.min_hits_filtered) & (F.col("query_stop") - F.col("query_start") >= config.min_match_duration) & (F.col("coverage") >= config.min_seconds_with_match))


def histogram_fallback(hits: DataFrame, found: DataFrame, config: AlgorithmConfig) -> DataFrame:
    """Results for queries that have none in ``found``: hits whose time difference lies around the most frequent bin of 5 frames, if that bin has more than 10; factors are 1."""
    x = hits.join(found.select("query_id").distinct(), "query_id", "left_anti").withColumn("_slot", F.expr("CAST(delta_t div 5 AS INT)"))
    best = x.groupBy(*PAIR, "_slot").agg(F.count(F.lit(1)).alias("n")).groupBy(*PAIR).agg(F.max_by("_slot", F.struct(F.col("n"), -F.col("_slot"))).alias("_mode"), F.max("n").alias("n")).where("n > 10").drop("n")
    near = x.join(best, list(PAIR)).where(F.abs(F.col("_mode") * 5 - F.col("delta_t")) <= 5).withColumns({"time_factor": F.lit(1.0), "freq_factor": F.lit(1.0)})
    return summarize(near, config)


def results(hits: DataFrame, config: AlgorithmConfig) -> DataFrame:
    """All valid results of all queries, unranked."""
    kept = enough_hits(hits, config)
    out = summarize(on_line(plausible(alignment(with_modes(hit_parts(kept, config)), config), config), config), config)
    return out.unionByName(histogram_fallback(kept, out, config)) if config.fallback_to_histogram else out


def ranked(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each query by score, then reference, with ``rank``."""
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "ref_id"))).where(F.col("rank") <= most)


def with_metadata(found: DataFrame, metadata: DataFrame) -> DataFrame:
    """Adds ``ref_path``, ``metadata unavailable!`` where a reference has none."""
    return found.join(metadata.select(F.col("resource_id").alias("ref_id"), F.col("path").alias("ref_path")), "ref_id", "left").withColumn("ref_path", F.coalesce("ref_path", F.lit("metadata unavailable!")))


def with_empty(queries: DataFrame, found: DataFrame) -> DataFrame:
    """One row with a null reference and -1 for each query (``query_id, query_path``) without a result; coverage is 0."""
    x = queries.join(found, "query_id", "left")
    void = F.col("ref_id").isNull()
    fill = {c: F.when(void, F.lit(-1).cast(found.schema[c].dataType)).otherwise(F.col(c)) for c in ("query_start", "query_stop", "ref_start", "ref_stop", "score", "time_factor", "freq_factor")}
    return x.withColumns({**fill, "coverage": F.when(void, F.lit(0.0)).otherwise(F.col("coverage")), "rank": F.coalesce("rank", F.lit(1))})


def query(prints: DataFrame, index: DataFrame, config: AlgorithmConfig, most: int = 1000, avoid: DataFrame | None = None, blocks: bool = False) -> DataFrame:
    """Ranked results of all queries at once. With ``blocks`` only the hits of :func:`blocks.aligned_pairs` are listed: the same results, for many queries against an index with hot hashes. The fallback needs all hits, so it has no use for that."""
    if blocks and not config.fallback_to_histogram:
        pairs = Written(aligned_pairs(prints, index, config), "pairs")
        index = index.join(small(pairs.df, pairs.rows), "resource_id")
    return ranked(results(near_hash_join(prints, index, config, avoid), config), most)
