"""A mixture of sources at target weights, by pivotal dependent rounding.

Each record of a source is wanted the same fractional number of times. The whole part is certain; the fractions are rounded by
pairing: of two fractional copies, size-weighted mass moves at random until one of them is whole, and the other goes on. Disjoint pairs of a bucket are settled together, in about log2(rows) passes. So the total size never moves by more
than the one record left at the end. Records are rounded in buckets side by side; what a bucket leaves over is at most one fraction of each source, and the left-overs are paired in a reduction tree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolattice.llm.tokens import BYTE_BPE_50K, token_counts
from echolattice.runtime import Written

_LEFT = "source string, id bigint, size bigint, p double, bucket bigint, copy int"


def pair(p: np.ndarray, size: np.ndarray, draw: Callable[[np.ndarray, int], np.ndarray]) -> tuple[np.ndarray, int]:
    """Rounded copies (0 or 1) of fractions ``p``, -1 for the one left fractional, and its place (-1: none). The new fractions replace ``p``.

    In each pass neighbours among the fractions left form disjoint pairs, and one of each pair becomes whole: about log2(n) passes. ``draw(places, pass)`` gives a number in [0, 1) for the pairs that begin there.
    """
    copy = np.full(len(p), -1, np.int32)
    left, turn = np.arange(len(p)), 0
    while len(left) > 1:
        even = len(left) & ~1
        i, j = left[0:even:2], left[1:even:2]
        a, b, wa, wb = p[i], p[j], size[i].astype(float), size[j].astype(float)
        up = np.minimum((1 - a) * wa, b * wb)  # mass that can move to the first
        down = np.minimum(a * wa, (1 - b) * wb)
        rises = draw(i, turn) * (up + down) < down  # chosen with the odds that keep each expectation
        moved = np.where(rises, up, -down)
        a, b = a + moved / wa, b - moved / wb
        p[i], p[j] = a, b
        near_a, near_b = np.minimum(a, 1 - a), np.minimum(b, 1 - b)
        first = near_a <= near_b  # the one that became whole
        copy[np.where(first, i, j)] = np.round(np.where(first, a, b)).astype(np.int32)
        rest, near = np.where(first, j, i), np.where(first, near_b, near_a)
        both = near <= 1e-9
        copy[rest[both]] = np.round(p[rest[both]]).astype(np.int32)
        left = np.concatenate([rest[~both], left[even:]])
        turn += 1
    if len(left) and not 1e-9 < p[left[0]] < 1 - 1e-9:
        copy[left[0]], left = round(p[left[0]]), left[:0]
    return copy, int(left[0]) if len(left) else -1


def _uniform(ids: np.ndarray, level: int, turn: int, seed: int) -> np.ndarray:
    """Numbers in [0, 1) that depend only on the record, the level, the pass and the seed, so a task that runs again decides alike."""
    x = ids.astype(np.uint64) + np.uint64(((seed * 1_000_003 + level) * 1_009 + turn) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53


def _rounding(level: int, seed: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """One group of one source; a copy of -1 marks the fraction left over. In the ``last`` level it is drawn with its own odds, so every record keeps its expectation."""
        rows = rows.sort_values("id", ignore_index=True)
        p, ids = rows["p"].to_numpy(copy=True), rows["id"].to_numpy()
        copy, held = pair(p, rows["size"].to_numpy(), lambda at, turn: _uniform(ids[at], level, turn, seed))
        if last and held >= 0:
            copy[held] = int(_uniform(ids[held : held + 1], level, -1, seed)[0] < p[held])
        return rows.assign(copy=copy, p=p)

    return run


def _wanted(targets: DataFrame) -> list[tuple[str, float, int]]:
    return [(r[0], float(r[1]), int(r[2])) for r in targets.where("source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL").select("source", "target_share", "max_repeats").collect()]


def plan_rates(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: float | None) -> dict[str, float]:
    """How often each record of a source is wanted: share * total / size, at most its cap.

    Without ``total`` it is the largest at which no source with records exceeds its cap, so that all shares are met. Shares are taken among the sources that have records. With a ``total`` beyond that, capped
    sources give all they may and the others share the remainder at their relative weights.
    """
    live = [(s, w, cap) for s, w, cap in targets if sizes.get(s, 0) > 0 and w > 0 and cap > 0]
    weight = sum(w for _, w, _ in live)
    if not live:
        return {}
    if total is None:
        total = min(cap * sizes[s] * weight / w for s, w, cap in live)
    rates: dict[str, float] = {}
    rest, open_ = float(total), live
    while open_:
        weight = sum(w for _, w, _ in open_)
        full = [(s, w, cap) for s, w, cap in open_ if w / weight * rest >= cap * sizes[s] * (1 - 1e-12)]
        if not full:
            rates |= {s: w / weight * rest / sizes[s] for s, w, _ in open_}
            break
        for s, _, cap in full:
            rates[s] = float(cap)
            rest -= cap * sizes[s]
        open_ = [x for x in open_ if x not in full]
    return rates


def mix(records: DataFrame, targets: DataFrame, key: str, source: str, size: str, total: float | None = None, seed: int = 1, bucket_rows: int = 50_000, fan_in: int = 64) -> DataFrame:
    """``key, source, size, copies, target_share, reached_share`` of each record used at least once.

    ``targets`` has ``source, target_share, max_repeats``, one row a source, and is small: it comes to the driver, as do the sums of the sources in it. ``records`` is read twice, so pass a stored table.

    * No record is used more than ``max_repeats`` times, and each source's size differs from its planned one by less than one record.
    * Records of sources that aren't targets (null ones too) and records without size (null, 0) are never used. A source without records reaches no share; see :func:`plan_rates` for what the others then get.
    * Choices depend on ``key`` (a unique BIGINT) and ``seed`` alone, not on partitions. Empty tables give no rows; other columns aren't read.
    """
    spark = records.sparkSession
    wanted = _wanted(targets)
    schema = T._parse_datatype_string("source string, target_share double, rate double, buckets bigint")
    rows = records.where(F.col(key).isNotNull() & (F.col(size) > 0)).select(F.col(source).alias("source"), F.col(key).cast("bigint").alias("id"), F.col(size).cast("bigint").alias("size"))
    listed = F.broadcast(spark.createDataFrame([(s,) for s, _, _ in wanted], "source string"))
    sums = {r[0]: (r[1], r[2]) for r in rows.join(listed, "source", "left_semi").groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).collect()}
    rates = plan_rates({s: x[0] for s, x in sums.items()}, wanted, total)
    plan = spark.createDataFrame([(s, w, rates[s], -(-sums[s][1] // bucket_rows)) for s, w, _ in wanted if s in rates], schema)
    planned = rows.join(F.broadcast(plan), "source")
    whole = F.floor(F.col("rate") + F.lit(1e-9)).cast("int")
    part = F.col("rate") - whole
    planned = planned.withColumn("base", whole).withColumn("p", F.when(part > 1e-9, part).otherwise(0.0)).withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("buckets")))

    open_ = planned.where("p > 0").select("source", "id", "size", "p", "bucket")
    done: DataFrame | None = None
    most = max([1, *(-(-sums[s][1] // bucket_rows) for s in rates)])
    level = 0
    while True:
        rounded = Written(open_.groupBy("source", "bucket").applyInPandas(_rounding(level, seed, most == 1), _LEFT), "rounded").df
        settled = rounded.where("copy >= 0").select("id", "copy")
        done = settled if done is None else done.unionByName(settled)
        if most == 1:
            break
        most, level = -(-most // fan_in), level + 1
        open_ = rounded.where("copy < 0").select("source", "id", "size", "p", F.expr(f"bucket div {fan_in}").alias("bucket"))
    copies = planned.where("p = 0").select("source", "id", "size", F.col("base").alias("copies"), "target_share").unionByName(
        planned.where("p > 0").join(done, "id").select("source", "id", "size", (F.col("base") + F.col("copy")).alias("copies"), "target_share")
    )
    used = Written(copies.where("copies > 0"), "mixture").df
    reached = {r[0]: r[1] for r in used.groupBy("source").agg(F.sum(F.col("copies") * F.col("size"))).collect()}
    whole_size = sum(reached.values())
    shares = spark.createDataFrame([(s, n / whole_size) for s, n in reached.items()], "source string, reached_share double")
    return used.join(F.broadcast(shares), "source").select(F.col("id").alias(key), F.col("source").alias(source), F.col("size").alias(size), "copies", "target_share", "reached_share")


def shares(mixture: DataFrame, targets: DataFrame, source: str, size: str) -> DataFrame:
    """``source, target_share, max_repeats, records, size, reached_share`` of each source of ``targets``, 0 where nothing was used."""
    got = mixture.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("copies") * F.col(size)).alias("size"), F.max("copies").alias("most_copies"))
    x = targets.select("source", "target_share", "max_repeats").join(F.broadcast(got), "source", "left").fillna(0, ["records", "size", "most_copies"])
    total = x.agg(F.sum("size")).scalar()
    return x.select("source", "target_share", "max_repeats", "records", "most_copies", "size", F.coalesce(F.try_divide(F.col("size").cast("double"), total.cast("double")), F.lit(0.0)).alias("reached_share"))


def kept(mixture: DataFrame, records: DataFrame, targets: DataFrame, key: str, source: str, size: str, total: float | None = None) -> DataFrame:
    """What must hold of a mixture, a row for each source of ``targets``: ``source, available`` (records with a size), ``once`` (no record stands twice in it), ``capped`` (none is used more than ``max_repeats`` times),
    ``close`` (the source's size differs from its planned one by less than its largest record, and all sources together from ``total`` by less than the sum of these, or have all their caps allow)."""
    wanted = _wanted(targets)
    held = {r[0]: r[1:] for r in records.where(F.col(size) > 0).groupBy(F.col(source)).agg(F.count(F.lit(1)), F.sum(size), F.max(size)).collect()}
    used = {r[0]: r[1:] for r in mixture.groupBy(F.col(source)).agg(F.count(F.lit(1)), F.count_distinct(key), F.max("copies"), F.sum(F.col("copies") * F.col(size))).collect()}
    rates = plan_rates({s: x[1] for s, x in held.items()}, wanted, total)
    most = sum(cap * held[s][1] for s, w, cap in wanted if s in held and w > 0)
    whole = total is None or abs(sum(x[3] for x in used.values()) - min(total, most)) < sum(x[2] for x in held.values())
    rows = []
    for s, _, cap in wanted:
        n, amount, largest = held.get(s, (0, 0, 1))
        count, distinct, copies, got = used.get(s, (0, 0, 0, 0))
        rows.append((s, n, count == distinct, copies <= cap, bool(whole and abs(got - rates.get(s, 0.0) * amount) < largest)))
    return targets.sparkSession.createDataFrame(rows, "source string, available bigint, once boolean, capped boolean, close boolean")


def sized(documents: DataFrame, key: str, source: str, text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """``key, source (trimmed, lower case), n_tokens`` of each document with a source, stored once: texts are encoded a single time."""
    rows = documents.select(key, F.lower(F.btrim(F.col(source), F.lit(" \t"))).alias(source), text).where(F.col(source).isNotNull())
    return Written(token_counts(rows, [key, source], text, path=path), "sized").df
