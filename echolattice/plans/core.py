"""Queries for the engine's own operators over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolattice.config import CONSTANT_Q, FFT
from echolattice.functions import hashing, names, units
from echolattice.functions.murmur import file_hash, murmur32
from echolattice.operators import dedup, evaluate, fingerprints, index, match, monitor, pch, peaks
from echolattice.runtime import shared_dir, written
from echolattice.sources import audio, cachefiles, fixtures
from echolattice.sources.fixtures import BANDS, SMALL
from echolattice.sources.tables import millis, table, trimmed
from echolattice.streaming import monitor as live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Two-point prints of the event table, and the linear-spectrum filter for 64 bins of 125 Hz.
TWO = FFT.but(points_per_print=2)
LOG = FFT.but(block_size=128, min_bin=2, time_max_filter=9)
FALLBACK = SMALL.but(fallback_to_histogram=True)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _points(spark: SparkSession, folder: str) -> DataFrame:
    """The event points, stored once: queries and index are both made of them."""
    return written(fixtures.points(spark, folder), "points")


def _hits(spark: SparkSession, folder: str, avoid_own: bool = False) -> DataFrame:
    x = _points(spark, folder)
    asked = fixtures.query_prints(x)
    avoid = asked.select("query_id", (F.col("query_id") % 100).alias("resource_id")).distinct() if avoid_own else None
    return match.near_hash_join(asked, fixtures.index(x), SMALL, avoid)


def _kept(spark: SparkSession, folder: str) -> DataFrame:
    return match.enough_hits(_hits(spark, folder), SMALL)


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return match.hit_parts(_kept(spark, folder), SMALL)


def _results(spark: SparkSession, folder: str) -> DataFrame:
    return match.results(_hits(spark, folder), SMALL)


RESULT = ("query_start", "query_stop", "ref_start", "ref_stop", "time_factor", "freq_factor", "coverage")


# --- spectrogram and event points


@query
def spectrogram_scan(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(fixtures.spectrogram(spark, folder), "m")


@query
def vertical_max_filter(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(peaks.vertical_max(fixtures.spectrogram(spark, folder), SMALL.freq_max_filter), "m", "vm")


@query
def horizontal_max_filter(spark: SparkSession, folder: str) -> DataFrame:
    x = peaks.vertical_max(fixtures.spectrogram(spark, folder), SMALL.freq_max_filter)
    return rounded(peaks.horizontal_max(x, SMALL.time_max_filter), "m", "vm", "hm")


@query
def min_max_filter(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(peaks.min_max_filter(fixtures.spectrogram(spark, folder), ["resource_id", "t"], "f", "m", 21), "m", "low", "high")


@query
def min_max_filter_whole_windows(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(peaks.min_max_filter(fixtures.spectrogram(spark, folder), ["resource_id", "t"], "f", "m", 21, clamp=False), "m", "low", "high")


@query
def log_freq_filter(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(peaks.vertical_max_log(fixtures.spectrogram(spark, folder), LOG), "m", "vm")


@query
def event_points(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.points(spark, folder).select("resource_id", "t", "f")


@query
def event_points_fft(spark: SparkSession, folder: str) -> DataFrame:
    return peaks.event_points(fixtures.spectrogram(spark, folder), LOG, BANDS).select("resource_id", "t", "f")


@query
def event_point_magnitude_3x3(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(peaks.magnitude_3x3(fixtures.spectrogram(spark, folder)), "m", "m9")


@query
def event_point_print(spark: SparkSession, folder: str) -> DataFrame:
    x = cachefiles.event_point_table(fixtures.points(spark, folder), SMALL, match.bin_hertz(F.col("f"), SMALL))
    return rounded(x, "seconds", "hertz", "m")


@query
def event_point_print_fft(spark: SparkSession, folder: str) -> DataFrame:
    """The linear form of bins in hertz."""
    x = peaks.event_points(fixtures.spectrogram(spark, folder), LOG, BANDS)
    return rounded(cachefiles.event_point_table(x, LOG, match.bin_hertz(F.col("f"), LOG)), "seconds", "hertz", "m")


@query
def prints_text(spark: SparkSession, folder: str) -> DataFrame:
    """The prints of the recordings as text lines."""
    return fixtures.index(fixtures.points(spark, folder)).select(F.concat_ws(" ", "hash", "resource_id", "t1", "f1").alias("line"))


@query
def spectrum_print(spark: SparkSession, folder: str) -> DataFrame:
    x = cachefiles.dense_matrix(fingerprints.pack(fixtures.points(spark, folder).withColumn("m", F.lit(1.0)), SMALL), BANDS)
    return x.select("resource_id", "t", F.length("line").alias("width"), F.length(F.regexp_replace("line", r"[^1]", "")).alias("points"))


# --- fingerprints and hashes


@query
def fingerprints_three_point(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.pack(fixtures.points(spark, folder), SMALL).select("resource_id", *(f"{c}{i}" for i in (1, 2, 3) for c in "tf"))


@query
def fingerprints_volume(spark: SparkSession, folder: str) -> DataFrame:
    x = fingerprints.fingerprints(fixtures.volume_points(spark, folder), SMALL)
    return x.groupBy("resource_id").agg(F.count(F.lit(1)).alias("prints"), F.min("hash").alias("least"), F.max("hash").alias("most"), F.sum(F.col("hash") % 1009).alias("check"))


@query
def fingerprints_two_point(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.pack(fixtures.points(spark, folder), TWO).select("resource_id", *(f"{c}{i}" for i in (1, 2, 3) for c in "tf"))


def _prints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.pack(fixtures.volume_points(spark, folder), SMALL)


def _hashed(x: DataFrame, h: object) -> DataFrame:
    return x.withColumn("hash", h).groupBy("resource_id", "hash").agg(F.count(F.lit(1)).alias("prints"))


@query
def hash_constant_q(spark: SparkSession, folder: str) -> DataFrame:
    return _hashed(_prints(spark, folder), hashing.hash_constant_q())


@query
def hash_fft(spark: SparkSession, folder: str) -> DataFrame:
    return _hashed(_prints(spark, folder), hashing.hash_fft())


@query
def hash_robust(spark: SparkSession, folder: str) -> DataFrame:
    return _hashed(_prints(spark, folder), hashing.hash_robust())


@query
def same_prints(spark: SparkSession, folder: str) -> DataFrame:
    x = fingerprints.fingerprints(fixtures.points(spark, folder), SMALL).select("resource_id", "hash", "t1")
    return fingerprints.same_print(x, x).where("a_resource_id < b_resource_id").select("a_resource_id", "b_resource_id", "a_hash", "a_t1", "b_t1")


@query
def morton_encode(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "postings").where("hash IS NOT NULL AND f1 IS NOT NULL").select("hash", "f1").distinct()
    code = hashing.morton_encode(F.col("hash") % 65536, F.col("f1"))
    a, b = hashing.morton_decode(code)
    return x.select("hash", "f1", code.alias("code"), a.alias("x"), b.alias("y"))


@query
def hamming_distance(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "postings").where("hash IS NOT NULL AND resource_id IS NOT NULL").select("hash", "resource_id").distinct()
    return x.select("hash", "resource_id", hashing.hamming(F.col("hash"), F.col("resource_id").cast("bigint")).cast("int").alias("distance"))


@query
def hamming_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Of integers, negative ones too, and of bit sets of different length."""
    x = table(spark, folder, "postings").where("resource_id IS NOT NULL AND f1 IS NOT NULL AND t1 IS NOT NULL").select("resource_id", "t1", "f1").distinct()
    bits = lambda c, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(F.col(c), i) == 1)
    return x.select("resource_id", "t1", "f1", hashing.hamming(-F.col("resource_id"), F.col("t1"), 32).cast("int").alias("ints"), hashing.hamming_bits(bits("resource_id", 31), bits("f1", 9)).alias("bits"))


# --- matching


@query
def near_hash_join(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder)


@query
def near_hash_avoid(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder, avoid_own=True).groupBy("query_id", "ref_id").agg(F.count(F.lit(1)).alias("hits"))


@query
def index_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Resources whose id is divisible by 50 as queries against the whole index: how many near hashes each shares with each resource."""
    x = table(spark, folder, "postings")
    asked = x.where("resource_id % 50 = 0").select(F.col("resource_id").alias("query_id"), "hash")
    return match.hit_counts(asked, x, SMALL)


def _whole_index(spark: SparkSession, folder: str) -> index.StoredIndex:
    """All postings and metadata, stored as the engine stores them."""
    ix = index.StoredIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    ix.store(table(spark, folder, "postings"), table(spark, folder, "resource_metadata"))
    return ix


def _postings_matches(spark: SparkSession, folder: str) -> tuple[DataFrame, index.StoredIndex]:
    ix = _whole_index(spark, folder)
    asked = ix.postings.where("resource_id % 50 = 0").select(F.col("resource_id").alias("query_id"), "hash", "t1", "f1")
    return match.query(asked, ix.postings, CONSTANT_Q, blocks=True), ix


@query
def postings_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Resources whose id is divisible by 50, asked for in the whole stored index: lookup, alignment, validation, ranking."""
    return rounded(_postings_matches(spark, folder)[0], *RESULT)


@query
def hits_per_reference(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder).groupBy("query_id", "ref_id").agg(F.count(F.lit(1)).alias("hits"))


@query
def hit_parts(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder).select("query_id", "ref_id", "rn", "n_hits", "part_size", "in_first", "in_last", "query_time", "delta_t")


@query
def modal_delta(spark: SparkSession, folder: str) -> DataFrame:
    return match.modal_deltas(_parts(spark, folder)).select("query_id", "ref_id", "y1", "x1", "y2", "x2")


@query
def time_factor(spark: SparkSession, folder: str) -> DataFrame:
    x = match.alignment(match.modal_deltas(_parts(spark, folder)), SMALL)
    return rounded(x.select("query_id", "ref_id", "slope", "offset", "time_factor", "freq_factor", "exact_speed_ratio"), "slope", "offset", "time_factor", "freq_factor", "exact_speed_ratio")


@query
def linear_filter(spark: SparkSession, folder: str) -> DataFrame:
    aligned = match.plausible(match.alignment(match.with_modes(_parts(spark, folder)), SMALL), SMALL)
    return match.on_line(aligned, SMALL).select("query_id", "ref_id", "query_time", "match_time", "hash", "near_hash")


@query
def coverage_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_results(spark, folder).select("query_id", "ref_id", "score", "coverage"), "coverage")


@query
def match_results(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(match.ranked(_results(spark, folder), 1000), *RESULT)


@query
def topk_results(spark: SparkSession, folder: str) -> DataFrame:
    return match.ranked(_results(spark, folder), 1).select("query_id", "ref_id", "score", "rank")


@query
def histogram_fallback(spark: SparkSession, folder: str) -> DataFrame:
    kept = _kept(spark, folder)
    found = written(_results(spark, folder), "found")
    return rounded(match.histogram_fallback(kept, found, SMALL), *RESULT)


@query
def metadata_join(spark: SparkSession, folder: str) -> DataFrame:
    """The results of :func:`postings_matches` with their paths; resources without counted prints have no metadata."""
    found, ix = _postings_matches(spark, folder)
    return match.with_metadata(found, ix.metadata.where("num_fingerprints > 0")).select("query_id", "ref_id", "ref_path", "rank")


@query
def empty_results(spark: SparkSession, folder: str) -> DataFrame:
    found = match.ranked(_results(spark, folder), 1000).where("ref_id <> query_id % 100")
    asked = fixtures.query_prints(_points(spark, folder)).select("query_id").distinct().withColumn("query_path", F.concat(F.lit("query/"), F.col("query_id").cast("string"), F.lit(".wav")))
    return rounded(match.with_empty(asked, found), *RESULT)


# --- monitoring, duplicates


@query
def monitor_windows(spark: SparkSession, folder: str) -> DataFrame:
    return monitor.windows(table(spark, folder, "resource_metadata"))


def _lasting(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.spectrogram(spark, folder).groupBy("resource_id").agg((F.max("t") + 1).cast("double").alias("duration"))


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return written(fixtures.index(fixtures.points(spark, folder)), "stored")


@query
def monitor_matches(spark: SparkSession, folder: str) -> DataFrame:
    x = _stored(spark, folder)
    return monitor.monitor(x, x, _lasting(spark, folder), SMALL, most=1).select("resource_id", "start", "stop", "label", "ref_id", "score")


@query
def monitor_all_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Every window with all its matches, or an empty row."""
    x = _stored(spark, folder)
    found = monitor.monitor(x.where("resource_id % 2 = 0"), x.where("resource_id % 4 = 0"), _lasting(spark, folder), SMALL, empty=True)
    return rounded(found.select("resource_id", "start", "stop", "label", "ref_id", "score", "rank", *RESULT), *RESULT)


@query
def dedup_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Among the recordings and their altered versions, each of which is a recording of its own."""
    x = written(fixtures.query_prints(_points(spark, folder)).withColumnRenamed("query_id", "resource_id"), "versions")
    lasting = _lasting(spark, folder).select(F.explode(F.array(*(F.col("resource_id") + 100 * k for k in range(4)))).alias("resource_id"), "duration")
    return dedup.by_fingerprint(x, x, lasting, SMALL).select("resource_id", "start", "ref_id", "score", "rank")


@query
def dedup_exact_documents(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.content_groups(table(spark, folder, "documents"), "doc_id", "text")


@query
def dedup_exact_members(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document that has an exact copy; ``first_key`` is the id of its class."""
    return dedup.content_members(table(spark, folder, "documents"), "doc_id", "text")


@query
def same_score(spark: SparkSession, folder: str) -> DataFrame:
    x = _stored(spark, folder)
    ids = table(spark, folder, "embeddings").select(F.col("label").alias("id")).distinct()
    pairs = ids.select(F.col("id").alias("first_id"), F.explode(F.array(F.col("id"), (F.col("id") + 1) % 10)).alias("second_id"))
    return dedup.shared_percent(pairs, x, SMALL)


# --- index


@query
def index_set_insert(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "postings")
    return index.insert_set(x.where("batch_no % 2 = 0"), x.where("batch_no % 2 = 1"))


@query
def index_bag_insert(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "postings")
    return index.insert_bag(x.where("batch_no % 2 = 0"), x.where("batch_no % 2 = 1")).groupBy("resource_id").agg(F.count(F.lit(1)).alias("postings"))


@query
def index_delete(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "postings")
    return index.delete(x, x.where("t1 % 3 = 0")).groupBy("resource_id").agg(F.count(F.lit(1)).alias("postings"))


@query
def store_skip_existing(spark: SparkSession, folder: str) -> DataFrame:
    seen = table(spark, folder, "dedup_lines").where("ref_id IS NOT NULL").select(F.col("ref_id").alias("resource_id")).distinct()
    return index.not_stored(table(spark, folder, "resource_metadata").select("resource_id", "path"), seen)


@query
def metadata_lookup(spark: SparkSession, folder: str) -> DataFrame:
    seen = table(spark, folder, "dedup_lines").where("ref_id IS NOT NULL").select(F.col("ref_id").alias("resource_id")).distinct()
    return index.lookup(table(spark, folder, "resource_metadata"), seen)


@query
def metadata_delete(spark: SparkSession, folder: str) -> DataFrame:
    gone = table(spark, folder, "dedup_lines").where("ref_id IS NOT NULL").select(F.col("ref_id").alias("resource_id"))
    return index.delete_metadata(table(spark, folder, "resource_metadata"), gone)


@query
def metadata_upsert(spark: SparkSession, folder: str) -> DataFrame:
    meta = table(spark, folder, "resource_metadata").select("resource_id", "path", "duration", "num_fingerprints")
    counted = table(spark, folder, "postings").where("resource_id IS NOT NULL").groupBy("resource_id").agg(F.count(F.lit(1)).alias("num_fingerprints"))
    fresh = meta.drop("num_fingerprints").join(counted, "resource_id").select(*meta.columns)
    return index.upsert_metadata(meta, fresh)


@query
def index_stats(spark: SparkSession, folder: str) -> DataFrame:
    x = index.statistics(table(spark, folder, "resource_metadata"), table(spark, folder, "postings"))
    return rounded(x, "total_duration", "avg_prints_per_second", "max_prints_per_second", "min_prints_per_second")


@query
def prints_per_second(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(index.prints_per_second(table(spark, folder, "resource_metadata")).select("resource_id", "prints_per_second"), "prints_per_second")


@query
def print_counts(spark: SparkSession, folder: str) -> DataFrame:
    return index.print_counts(_prints(spark, folder), 3600.0)


@query
def cached_prints_range(spark: SparkSession, folder: str) -> DataFrame:
    return cachefiles.between_seconds(table(spark, folder, "postings"), 1.0, 4.0, FFT).groupBy("resource_id").agg(F.count(F.lit(1)).alias("prints"))


# --- pitch classes


@query
def pitch_class_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return pch.pitch_class_histogram(fixtures.pitches(spark, folder))


def _shifted(spark: SparkSession, folder: str) -> DataFrame:
    """The stated queries, ids divisible by 50, against every histogram, in all 1,200 bins."""
    x = written(pch.sparse(pch.pitch_class_histogram(fixtures.pitches(spark, folder))), "histograms")
    return pch.ranked_matches(x.where("resource_id % 50 = 0"), x)


@query
def pch_best_shift(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_shifted(spark, folder).drop("ratio"), "match")


@query
def pch_matches(spark: SparkSession, folder: str) -> DataFrame:
    # shifts are few: their ratios are rounded once and not for every pair
    ratios = F.lit([round(100 * 2 ** (i / pch.BINS), 6) for i in range(pch.BINS)])
    return rounded(_shifted(spark, folder).withColumn("ratio", F.get(ratios, F.col("shift"))), "match")


# --- results and evaluation


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "result_lines").where("query_path IS NOT NULL AND ref_path IS NOT NULL")
    return x.withColumns({"query_path": trimmed("query_path"), "ref_path": trimmed("ref_path")})


@query
def result_filter(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.acceptable(_lines(spark, folder)).select("line_id", "match_score")


@query
def symmetric_pairs(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "dedup_lines").where("query_path IS NOT NULL AND ref_path IS NOT NULL")
    return evaluate.symmetric_pairs(x.withColumns({"query_path": trimmed("query_path"), "ref_path": trimmed("ref_path")})).select("line_id", "symmetric")


def _evaluated(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "result_lines").where(F.col("query_path").rlike(r"_\d+s-\d+s"))
    place = F.struct(-F.coalesce("match_score", F.lit(-1)), "line_id")
    x = x.select(trimmed("query_path").alias("query_path"), trimmed("ref_path").alias("ref_path"), place.alias("rank"))
    return evaluate.with_in_index(x, table(spark, folder, "resource_metadata").select(trimmed("path").alias("path")))


@query
def evaluation_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.confusion(_evaluated(spark, folder)), "tp", "fp", "fn", "tn")


@query
def evaluation_plan(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.evaluation_plan(table(spark, folder, "resource_metadata"))


@query
def evaluation_run(spark: SparkSession, folder: str) -> DataFrame:
    """The whole evaluation: every fifth recording is held out of the index, each is asked for unaltered, cut, higher and faster, and the first results make the matrix."""
    x = _points(spark, folder)
    base, kind = F.col("query_id") % 100, F.floor(F.col("query_id") / 100)
    tail = F.when(kind == 2, "___pitch_shift_1.02").when(kind == 3, "___time_stretched_0.96").otherwise("")
    path = F.concat(F.lit("q/"), base.cast("string"), F.when(kind == 1, "_10s-34s").otherwise("_0s-60s"), tail, F.lit(".mp3"))
    asked = fixtures.query_prints(x)
    names_ = asked.select("query_id").distinct().withColumn("query_path", path)
    held = fixtures.index(x.where("resource_id % 5 <> 0"))
    found = match.with_empty(names_, match.query(asked, held, SMALL, 1)).select("query_path", F.concat(F.lit("a/"), F.col("ref_id").cast("string"), F.lit(".mp3")).alias("ref_path"), "rank")
    resources = held.select(F.concat(F.lit("a/"), F.col("resource_id").cast("string"), F.lit(".mp3")).alias("path")).distinct()
    return rounded(evaluate.confusion(evaluate.with_in_index(found, resources)), "tp", "fp", "fn", "tn")


@query
def benchmark_speed(spark: SparkSession, folder: str) -> DataFrame:
    """A day is a step; lines of even queries stand for storing, and a line takes from its run to its loading."""
    x = table(spark, folder, "result_lines").where("run_at IS NOT NULL AND loaded_at IS NOT NULL AND query_index IS NOT NULL")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    runs = x.select(
        F.to_date("run_at").alias("step"), F.when(F.col("query_index") % 2 == 0, "store").otherwise("query").alias("kind"),
        F.greatest(millis("query_stop") - millis("query_start"), F.lit(0)).alias("a"), (micros("loaded_at") - micros("run_at")).alias("w"),
    )
    sums = runs.groupBy("step", "kind").agg((F.sum("a") / 1000).alias("audio_seconds"), (F.sum("w") / 1_000_000).alias("wall_seconds"))
    return rounded(evaluate.speeds(sums), "cumulative_seconds", "store_speed", "query_speed")


@query
def result_line_print(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "dedup_lines").where("query_path IS NOT NULL")
    return cachefiles.result_lines(x.withColumns({"query_index": F.lit(1), "total_queries": F.lit(1)}), "line_id")


# --- names, units, hashes of content


@query
def identifier_from_name(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of either sign, and 0 where a resource has no count: then the name's own hash counts."""
    hashed = (F.coalesce(F.col("num_fingerprints"), F.lit(0)) * F.when(F.col("resource_id") % 2 == 0, 100_003).otherwise(-99_991) % 2_000_000_000).cast("int")
    x = table(spark, folder, "resource_metadata").withColumn("name", F.when(F.col("resource_id") % 3 == 0, names.basename(F.col("path"))).otherwise(F.col("path")))
    return x.select("name", names.identifier(F.col("name"), hashed).alias("identifier"), names.basename(F.col("name")).alias("base"), names.extension(F.col("name")).alias("ext"), names.folder(F.col("name")).alias("folder"))


@query
def parse_query_name(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "result_lines").where("query_path IS NOT NULL").select(trimmed("query_path").alias("query_path")).distinct()
    start, stop = names.query_range(F.col("query_path"))
    ev = names.evaluation_name(F.col("query_path"))
    return x.select("query_path", names.query_id(F.col("query_path")).alias("id"), start.alias("start"), stop.alias("stop"), ev["base"].alias("base"), ev["modification"].alias("modification"), ev["factor"].alias("factor"))


@query
def pitch_units(spark: SparkSession, folder: str) -> DataFrame:
    hz = F.col("value") + 20
    x = table(spark, folder, "events").select(
        "event_id", units.hertz_to_absolute_cent(hz).alias("absolute_cent"), units.hertz_to_relative_cent(hz).alias("relative_cent"), units.hertz_to_midi_cent(hz).alias("midi_cent"), units.hertz_to_midi_key(hz).alias("midi_key"),
        units.ratio_to_cent(hz / 440).alias("cents"), units.convert_pitch(units.hertz_to_absolute_cent(hz), "absolute_cent", "hertz").alias("back"),
    )
    return rounded(x, "absolute_cent", "relative_cent", "midi_cent", "cents", "back")


@query
def time_format(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "resource_metadata").where("duration IS NOT NULL")
    s = F.floor("duration").cast("int")
    return x.select("resource_id", units.clock_time(F.concat(F.lit("20310102-235950-"), F.col("path")), s).alias("clock"), units.span_text(F.floor("duration").cast("double")).alias("span"), F.round(units.convert_time(F.col("duration"), "seconds", "minutes"), 6).alias("minutes"))


@query
def stopwatch_format(spark: SparkSession, folder: str) -> DataFrame:
    """Durations from nanoseconds to days."""
    n = table(spark, folder, "resource_metadata").where("num_fingerprints IS NOT NULL").select("resource_id", (F.col("num_fingerprints") * F.element_at(F.lit([1, 1_000, 1_000_000, 1_000_000_000]), (F.pmod("resource_id", F.lit(4)) + 1).cast("int"))).alias("nanos"))
    return n.select("resource_id", "nanos", units.stopwatch_time(F.col("nanos")).alias("shown"))


@query
def prefix_completion(spark: SparkSession, folder: str) -> DataFrame:
    """The names of all resources as words, asked for by the beginnings of every name, of one to eight characters."""
    words = table(spark, folder, "resource_metadata").where("path IS NOT NULL").select(names.basename(F.col("path")).alias("word"))
    prefixes = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda n: F.substring("word", F.lit(1), n))).alias("prefix"))
    return names.complete(words, prefixes)


@query
def murmur_file_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", file_hash(F.col("text")).alias("file_hash"), murmur32(F.col("source")).alias("source_hash"))


@query
def stft_peaks(spark: SparkSession, folder: str) -> DataFrame:
    config = FFT.but(time_max_filter=9)
    spectra = audio.spectrogram(fixtures.pcm_blocks(spark, folder), config)
    return peaks.event_points(spectra, config, config.block_size // 2).select("resource_id", "t", "f", F.round("m", 3).alias("m"))


@query
def streaming_monitor(spark: SparkSession, folder: str) -> DataFrame:
    """The stored prints as a stream: a frame is a second of event time; the windows that closed, matched against the index."""
    base = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    stored = _stored(spark, folder)
    prints = stored.withColumn("at", F.timestamp_seconds(F.col("t1")))
    closing = prints.select("resource_id", F.lit(-1).cast("bigint").alias("hash"), F.lit(0).alias("t1"), F.lit(0).alias("f1"), F.timestamp_seconds(F.lit(100_000)).alias("at")).distinct()
    prints.select("resource_id", "hash", "t1", "f1", "at").write.parquet(f"{base}/in/0")
    closing.write.parquet(f"{base}/in/1")
    stream = spark.readStream.schema(closing.schema).option("maxFilesPerTrigger", 1000).parquet(f"{base}/in/*")

    def sink(found: DataFrame, batch: int) -> None:
        found.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    run = live.start(stream, stored, SMALL, f"{base}/state", sink, durations=_lasting(spark, folder)).start()
    run.processAllAvailable()
    run.stop()
    return spark.read.parquet(f"{base}/out").select("resource_id", "start", "ref_id", "score", "rank")
