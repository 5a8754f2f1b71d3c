"""Duplicates by content and by fingerprint, and how much two recordings share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolattice.config import AlgorithmConfig
from echolattice.operators.match import near_hash_join, ranked, results
from echolattice.operators.monitor import monitor
from echolattice.operators.skew import join_unique
from echolattice.runtime import Written


def content_groups(files: DataFrame, key: str, content: str) -> DataFrame:
    """``content_hash, first_key, members``: content that occurs at least twice. The members themselves are :func:`content_members`, so no group has to fit into a row."""
    x = files.where(F.col(content).isNotNull()).select(F.md5(F.col(content).cast("binary")).alias("content_hash"), key)
    return x.groupBy("content_hash").agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("members")).where("members >= 2")


def content_members(files: DataFrame, key: str, content: str) -> DataFrame:
    """``key, content_hash, first_key, members`` of each file that has a duplicate; a group that holds many of the files is split."""
    stored = Written(files.where(F.col(content).isNotNull()).select(key, F.md5(F.col(content).cast("binary")).alias("content_hash")), "hashes")
    x = stored.df
    groups = x.groupBy("content_hash").agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("members")).where("members >= 2")
    return join_unique(x, groups, "content_hash", rows=stored.rows).select(key, "content_hash", "first_key", "members")


def by_fingerprint(prints: DataFrame, index: DataFrame, durations: DataFrame, config: AlgorithmConfig, window: float = 25.0, overlap: float = 5.0, most: int = 10) -> DataFrame:
    """Windows of each stored recording that match another one."""
    return monitor(prints, index, durations, config, window, overlap, most, avoid_self=True)


def shared_percent(pairs: DataFrame, prints: DataFrame, config: AlgorithmConfig) -> DataFrame:
    """``first_id, second_id, percent``: the covered share of the first recording found with the second as query, rounded; 0 without a match.

    Each pair (``first_id, second_id``) is matched on its own: the prints of its second recording meet those of its first by (pair, hash), never those of other pairs. Repeated pairs count once.
    """
    pairs = pairs.select("first_id", "second_id").distinct()
    pair = F.struct("first_id", "second_id").alias("query_id")
    mine = lambda side: prints.join(pairs.withColumn("resource_id", F.col(side)), "resource_id").select(pair, "hash", "resource_id", "t1", "f1")
    found = ranked(results(near_hash_join(mine("second_id"), mine("first_id"), config), config), 1)
    got = found.select(F.col("query_id.first_id").alias("first_id"), F.col("query_id.second_id").alias("second_id"), F.round(F.col("coverage") * 100).cast("int").alias("percent"))
    return pairs.join(got, ["first_id", "second_id"], "left").fillna(0, ["percent"])
