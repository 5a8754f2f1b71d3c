"""The best N items of every group, by partition lower bounds.

Each partition keeps, in one pass and in memory bounded by N times its groups, its own best N distinct items of each group: the candidates, which are
stored. Where a partition has N items of a group, its N-th is a lower bound of the group: N distinct items at least as good exist. The best bound of each group is joined to the
candidates where they lie, before any shuffle of them; those that don't reach it drop out, and only the survivors are shuffled and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolattice.operators.skew import join_unique
from echolattice.runtime import Written

#: Most bytes of bounds that are sent to all tasks; beyond them bounds and candidates meet in a shuffle with hot groups split.
MOST_BROADCAST = 64 << 20


def _best(rows: pa.Table, n: int) -> tuple[pa.Table, np.ndarray]:
    """The first ``n`` distinct rows of each group in rank order, and their ranks from 1."""
    code = rows["_g"].combine_chunks().dictionary_encode().indices
    rows = rows.append_column("_code", code)
    keys = [("_code", "ascending"), *((c, "ascending") for c in rows.column_names if c[:2] in ("_k", "_i")), ("_id", "ascending")]
    rows = rows.take(pc.sort_indices(rows, sort_keys=keys))
    same = pd.DataFrame({c: rows[c].to_numpy() for c in ("_code", "_h1", "_h2")}).duplicated().to_numpy()
    if same.any():
        rows = rows.filter(pa.array(~same))
    code = rows["_code"].to_numpy()
    rows = rows.drop_columns(["_code"])
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    at = np.arange(len(code))
    rank = at - np.maximum.accumulate(np.where(new, at, 0)) + 1
    keep = rank <= n
    return rows.filter(pa.array(keep)), rank[keep]


def _local(batches: Iterator[pa.RecordBatch], n: int, every: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    fresh = kept = 0
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        fresh += b.num_rows
        if fresh >= max(every, kept):
            best, _ = _best(pa.concat_tables(held).combine_chunks(), n)
            held, fresh, kept = [best], 0, len(best)
    if held and sum(map(len, held)):
        best, rank = _best(pa.concat_tables(held).combine_chunks(), n)
        yield from best.append_column("_rank", pa.array(rank.astype(np.int32))).combine_chunks().to_batches(max_chunksize=20_000)


def within(best: DataFrame, bounds: DataFrame, place: Column, most_broadcast: int) -> DataFrame:
    """The candidates ``best`` that reach the bound of their group; all of those without one (groups of which no partition has enough items)."""
    bounds = Written(bounds, "bounds").df
    size = bounds.agg(F.sum(F.octet_length("_g") + F.lit(64))).first()[0] or 0
    met = best.join(F.broadcast(bounds), "_g", "left") if size <= most_broadcast else join_unique(best, bounds, "_g", "left")
    return met.where(F.col("_bound").isNull() | (place <= F.col("_bound"))).drop("_bound")


def top_n(df: DataFrame, group: str, score: str, ties: list[str], row_id: str, n: int, same: list[str] | None = None, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``group, score, ties..., row_id, rank`` of the first ``n`` items of each group: score descending, ``ties`` ascending (nulls first), ``row_id`` ascending.

    * Rows equal in all columns of ``same`` are one item, that of the smallest ``row_id``; with ``same=None`` each row is an item. Equality is tested by 128 bits of hash over these columns and which of them are null.
      ``same`` must hold the group, the score and the ties.
    * Rows with a null group, score or row_id are not ranked. An empty table gives no rows. Columns not named are not read, so they may have any name.
    * ``score`` and ``ties`` are whole numbers or doubles, ``row_id`` a whole number, unique.
    * A group of any size is cut to at most ``n`` candidates a partition, and these to the ones that reach the group's bound, before any shuffle of rows.
    """
    keys = [score, *ties]
    kind = df.schema[score].dataType
    descending = F.expr(f"~CAST(`{score}` AS BIGINT)") if isinstance(kind, T.IntegralType) else -F.col(score)
    cols = [F.col(c) for c in (same or [row_id])]
    nulls = F.concat(*(F.when(c.isNull(), "1").otherwise("0") for c in cols))
    order = [descending.alias("_k0")]
    for i, c in enumerate(ties):
        order += [F.col(c).isNotNull().cast("tinyint").alias(f"_i{i}a"), F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)).alias(f"_i{i}b")]
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (group, score, row_id))).select(
        F.col(group).alias("_g"), *order, F.col(row_id).cast("bigint").alias("_id"), F.xxhash64(F.lit(1), nulls, *cols).alias("_h1"), F.xxhash64(F.lit(2), nulls, *cols[::-1]).alias("_h2")
    )
    schema = T.StructType([*rows.schema.fields, T.StructField("_rank", T.IntegerType())])
    best = Written(rows.mapInArrow(lambda b: _local(b, n, 100_000), schema), "candidates").df
    names = [c for c in rows.columns if c[:2] in ("_k", "_i") and c != "_id"]
    place = F.struct(*names, "_id")
    reach = within(best, best.where(F.col("_rank") == n).groupBy("_g").agg(F.min(place).alias("_bound")), place, most_broadcast)
    # repeated items of a hot group spread by item; the ranking then sees distinct survivors, cut to n a task before they meet
    items = reach.groupBy("_g", *names, "_h1", "_h2").agg(F.min("_id").alias("_id"))
    ranked = items.withColumn("rank", F.row_number().over(W.partitionBy("_g").orderBy(*names, "_id"))).where(F.col("rank") <= n)
    back = F.expr("~_k0") if isinstance(kind, T.IntegralType) else -F.col("_k0")
    tie = [F.when(F.col(f"_i{i}a") == 1, F.col(f"_i{i}b")).alias(c) for i, c in enumerate(ties)]
    return ranked.select(F.col("_g").alias(group), back.cast(kind).alias(score), *tie, F.col("_id").alias(row_id), "rank")
