"""Pitch-class histograms and their best circular shift."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolattice.functions.units import hertz_to_relative_cent
from echolattice.runtime import Written

BINS = 1200
#: References whose shifts are added up together, queries that a task ranks (few, so tasks are many and end together), and most references that it compares with them.
TOGETHER, RANKED, MOST_REFS = 128, 32, 200_000
KINDS = {"int": pa.int32(), "bigint": pa.int64()}


def pitch_class_histogram(pitches: DataFrame, bins: int = BINS) -> DataFrame:
    """``resource_id, bin, cnt`` from ``resource_id, hz``: bin = rounded cent within the octave; a value that rounds to the octave itself is dropped, as are unpitched ones."""
    x = pitches.select("resource_id", F.floor(hertz_to_relative_cent(F.col("hz")) + 0.5).cast("int").alias("bin"))
    return x.where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("resource_id", "bin").agg(F.count(F.lit(1)).alias("cnt"))


def dense(histogram: DataFrame, bins: int = BINS) -> DataFrame:
    """``resource_id, bins ARRAY<BIGINT>`` with all bins in order."""
    kind = histogram.schema["resource_id"]
    entries = histogram.groupBy("resource_id").agg(F.collect_list("bin").alias("at"), F.collect_list("cnt").alias("cnt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))
            full = np.zeros((b.num_rows, bins), np.int64)
            full[row, b.column(1).flatten().to_numpy()] = b.column(2).flatten().to_numpy()
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * bins)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(full.reshape(-1)))], names=["resource_id", "bins"])

    return entries.mapInArrow(run, T.StructType([kind, T.StructField("bins", T.ArrayType(T.LongType()))]))


def sparse(histogram: DataFrame, bins: int = BINS) -> DataFrame:
    """``resource_id, n, at ARRAY<SMALLINT>, cnt ARRAY<BIGINT>``: the filled bins of each histogram of ``n`` bins."""
    at = F.collect_list(F.col("bin").cast("smallint"))
    return histogram.groupBy("resource_id").agg(F.lit(bins).alias("n"), at.alias("at"), F.collect_list("cnt").alias("cnt"))


def _filled(x: DataFrame) -> DataFrame:
    """:func:`sparse` of ``resource_id, bins``."""
    at = F.filter(F.sequence(F.lit(0), F.size("bins") - 1), lambda i: F.get("bins", i) != 0)
    return x.select("resource_id", F.size("bins").alias("n"), at.cast("array<smallint>").alias("at"), F.filter("bins", lambda v: v != 0).alias("cnt"))


def best_shifts(queries: list[tuple[np.ndarray, np.ndarray]], refs: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query and reference, given by their filled bins and counts: the largest intersection over all circular shifts of the reference, relative to the larger sum, and its first shift; (0, 0) if both are empty.

    The shifts of some references at a time lie beside each other, so a filled bin of the query adds one contiguous piece, of the narrowest integers that hold the sums.
    """
    total = [np.array([c.sum() for _, c in x], np.int64) for x in (queries, refs)]
    bound = min(int(t.max()) for t in total)
    kind = next(k for k in (np.uint8, np.uint16, np.int64) if bound <= np.iinfo(k).max)
    most, shift = np.empty((len(queries), len(refs)), np.int64), np.empty((len(queries), len(refs)), np.int16)
    for r0 in range(0, len(refs), TOGETHER):
        some = refs[r0 : r0 + TOGETHER]
        turned = np.zeros((2 * n - 1, len(some)), kind)
        # no sum exceeds the bound, so neither does what a larger count adds to it
        turned[np.concatenate([a for a, _ in some]), np.repeat(np.arange(len(some)), [len(a) for a, _ in some])] = np.minimum(np.concatenate([c for _, c in some]), bound)
        turned[n:] = turned[: n - 1]
        highest, capped = int(turned.max()), {}
        sums = np.empty((n, len(some)), kind)
        for j, (at, cnt) in enumerate(queries):
            sums[:] = 0
            for i, c in zip(at.tolist(), cnt.tolist(), strict=True):  # empty bins of the query add nothing to any shift
                if c >= highest:
                    full = turned
                elif c <= 16:
                    full = capped[c] if c in capped else capped.setdefault(c, np.minimum(turned, kind(c)))
                else:
                    np.add(sums, np.minimum(turned[i : i + n], kind(c)), out=sums)
                    continue
                np.add(sums, full[i : i + n], out=sums)
            by_ref = np.ascontiguousarray(sums.T)
            best = by_ref.argmax(1)
            shift[j, r0 : r0 + len(some)] = best
            most[j, r0 : r0 + len(some)] = by_ref[np.arange(len(some)), best]
    return most / np.maximum(np.maximum(total[0][:, None], total[1][None, :]), 1), shift


def _one_each(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers that hash partitioning sends to ``n`` different partitions."""
    x = spark.range(n * 40 + 1000).select(F.col("id").cast("int").alias("k"))
    found = dict(x.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect())
    return [found.get(p, p) for p in range(n)]


def _compared(queries: DataFrame, references: DataFrame, block_rows: int, most_refs: int) -> tuple[DataFrame, bool]:
    """All comparisons of two tables like :func:`sparse`, with ``place`` among the references of the query's block; whether that is the rank, as each block of queries meets all references at once."""
    spark = queries.sparkSession
    kind = queries.schema["resource_id"].dataType.simpleString()
    asked, held = Written(queries, "queries"), Written(references, "references")
    na, nb = (max(1, -(-x.rows // k)) for x, k in ((asked, block_rows), (held, most_refs)))
    block = lambda n: F.pmod(F.xxhash64("resource_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # few bytes but much work: each pair of blocks is a task of its own, and adaptive execution doesn't join them
    keys = F.lit(_one_each(spark, na * nb))
    g = lambda x: x.withColumn("g", F.get(keys, F.col("a") * nb + F.col("b"))).drop("a", "b").repartition(na * nb, "g")
    a, b = g(asked.df.withColumn("a", block(na)).withColumn("b", every(nb))), g(held.df.withColumn("b", block(nb)).withColumn("a", every(na)))

    def pairs(t: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        x = [t[c].combine_chunks() for c in ("at", "cnt")]
        ends = np.cumsum(pc.list_value_length(x[0]).to_numpy())[:-1]
        return list(zip(*(np.split(c.flatten().to_numpy(), ends) for c in x), strict=True))

    schema = pa.schema([("query_id", KINDS[kind]), ("ref_id", KINDS[kind]), ("match", pa.float64()), ("shift", pa.int32()), ("place", pa.int32())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids, refs = left["resource_id"].combine_chunks(), right["resource_id"].combine_chunks()
        match, shift = best_shifts(pairs(left), pairs(right), left["n"][0].as_py())
        order = pc.rank(refs, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        place = np.empty(match.shape, np.int32)
        for c in range(code.max() + 1):  # rows of one id share its ranks
            rows = np.flatnonzero(code == c)
            ranks = np.empty(len(rows) * len(refs), np.int32)
            ranks[np.lexsort((np.tile(order, len(rows)), -match[rows].reshape(-1)))] = np.arange(1, len(ranks) + 1)
            place[rows] = ranks.reshape(len(rows), -1)
        q = ids.take(pa.array(np.repeat(np.arange(len(ids)), len(refs))))
        r = refs.take(pa.array(np.tile(np.arange(len(refs)), len(ids))))
        return pa.table([q, r, pa.array(match.reshape(-1)), pa.array(shift.reshape(-1).astype(np.int32)), pa.array(place.reshape(-1))], schema)

    out = a.groupBy("g").cogroup(b.groupBy("g")).applyInArrow(run, f"query_id {kind}, ref_id {kind}, match double, shift int, place int")
    return out.withColumn("ratio", F.lit(100.0) * F.pow(F.lit(2.0), F.col("shift") / F.lit(1200.0))), nb == 1


def shift_matches(queries: DataFrame, references: DataFrame, block_rows: int = 256) -> DataFrame:
    """``query_id, ref_id, match, shift, ratio``: each stated query against every reference, of ``resource_id, bins``.

    Both are cut into blocks of about ``block_rows`` histograms, and each task takes one block of either: a block nested loop whose memory doesn't grow with the number of queries or references. Repeated rows have a result each; an empty side gives none.
    """
    return _compared(_filled(queries), _filled(references), block_rows, block_rows)[0].drop("place")


def ranked_matches(queries: DataFrame, references: DataFrame) -> DataFrame:
    """The rows of :func:`shift_matches` with the ``rank`` of :func:`ranked`, for tables like :func:`sparse`. Up to MOST_REFS references a task compares some queries with all of them and ranks them itself, so no result is shuffled; more are ranked by a window."""
    out, done = _compared(queries, references, RANKED, MOST_REFS)
    return out.withColumnRenamed("place", "rank") if done else ranked(out.drop("place"))


def ranked(matches: DataFrame, most: int | None = None) -> DataFrame:
    """``rank`` of the references of each query, best first, at most ``most``; equal matches all keep a place."""
    x = matches.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("match"), "ref_id")))
    return x if most is None else x.where(F.col("rank") <= most)
