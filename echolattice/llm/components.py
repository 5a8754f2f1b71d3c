"""Groups of records linked directly or through others, by seed-tree pruning.

In each round every vertex tells its neighbours the smallest vertex among them and itself. A vertex that nobody proposes - no
neighbourhood has it as its minimum - drops out and becomes a child of the smallest proposal it received; the others stay, linked to each
other by the proposals. The rounds shrink the graph until only seeds are left, the smallest vertex of each component. Then the seeds flow down the forest
of dropped vertices, in reverse order of the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolattice.operators.skew import join_unique
from echolattice.runtime import Written, shuffle_partitions


def number(values: DataFrame, column: str) -> DataFrame:
    """``column, id BIGINT`` for distinct values: ids are in the order of the values, from 0. Sorted in ranges, so no task sees all of them."""
    schema = T.StructType([T.StructField(column, values.schema[column].dataType), T.StructField("pid", T.IntegerType()), T.StructField("seq", T.LongType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(np.arange(n, n + b.num_rows))], names=schema.names)
            n += b.num_rows

    ordered = values.select(column).repartitionByRange(shuffle_partitions(values.sparkSession), column).sortWithinPartitions(column)
    rows = Written(ordered.mapInArrow(label, schema), "numbered").df
    sizes = {r[0]: r[1] for r in rows.groupBy("pid").agg(F.count(F.lit(1))).collect()}  # one row a partition
    start, offsets = 0, []
    for pid in sorted(sizes):
        offsets.append((pid, start))
        start += sizes[pid]
    first = values.sparkSession.createDataFrame(offsets, "pid int, first bigint")
    return rows.join(F.broadcast(first), "pid").select(column, (F.col("first") + F.col("seq")).alias("id"))


def seeds(links: DataFrame) -> DataFrame:
    """``v, seed`` of each vertex that isn't itself the smallest of its component, from links ``a, b`` (BIGINT, non-null): that smallest vertex. Seeds and vertices without a link have no row.

    Every round drops at least one vertex of each component that still has links, so it ends; the number of rounds grows with the logarithm of the longest chain.
    """
    both = links.where("a <> b").select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))).distinct()
    graph = Written(both, "links")
    forest: list[Written] = []
    while graph.rows:
        least = graph.df.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        told = join_unique(graph.df, least, "u", rows=graph.rows).select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m")).distinct()
        told = Written(told, "told")
        mine = Written(told.df.groupBy("v").agg(F.min("m").alias("low"), F.max(F.col("m") == F.col("v")).alias("stays")), "forest")
        forest.append(mine)
        linked = join_unique(told.df, mine.df.select("v", "low"), "v", rows=told.rows).where("m <> low").select(F.inline(F.array(F.struct(F.col("m").alias("u"), F.col("low").alias("v")), F.struct(F.col("low").alias("u"), F.col("m").alias("v"))))).distinct()
        rest = Written(linked, "links")
        graph.drop()
        told.drop()
        graph = rest
    spark = links.sparkSession
    known = None
    for mine in reversed(forest):
        level = mine.df.where("NOT stays").select("v", F.col("low").alias("parent"))
        # parents without an entry were never dropped: they are the seeds
        below = level.select("v", F.col("parent").alias("seed")) if known is None else join_unique(level, known.select(F.col("v").alias("parent"), "seed"), "parent", "left", mine.rows).select("v", F.coalesce("seed", "parent").alias("seed"))
        known = below if known is None else known.unionByName(below)
        if mine is not forest[0]:
            known = Written(known, "known").df
    if known is None:
        return spark.createDataFrame([], "v bigint, seed bigint")
    return known


def groups(df: DataFrame, left: str, right: str) -> DataFrame:
    """``item, group_item`` for every value in a row where both ``left`` and ``right`` are non-null: the smallest value (in code point order) of its group.

    Links have no direction; repeated, mirrored and self links change nothing, and a value linked only with itself is its own group. Rows with a null on either side are no links.
    An empty table gives no rows; other columns aren't read. A value linked with any number of others, and a group of any size, spreads over tasks: minima combine before the shuffle, and in every
    join on a vertex the few that hold most rows are met by broadcast.
    """
    pairs = Written(df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).alias("x"), F.col(right).alias("y")).distinct(), "pairs")
    ids = Written(number(pairs.df.select(F.inline(F.array(F.struct(F.col("x").alias("item")), F.struct(F.col("y").alias("item"))))).distinct(), "item"), "ids").df
    half = Written(join_unique(pairs.df.where("x <> y"), ids.select(F.col("item").alias("x"), F.col("id").alias("a")), "x", rows=pairs.rows).select("a", "y"), "half")
    links = join_unique(half.df, ids.select(F.col("item").alias("y"), F.col("id").alias("b")), "y", rows=half.rows).select("a", "b")
    seed = seeds(links)
    named = Written(ids.join(seed, ids["id"] == seed["v"], "left").select("item", F.coalesce("seed", "id").alias("seed")), "named")
    return join_unique(named.df, ids.select(F.col("item").alias("group_item"), F.col("id").alias("seed")), "seed", rows=named.rows).select("item", "group_item")
