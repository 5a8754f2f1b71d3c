"""The most frequent values of a column: space-saving summaries, merged in a tree, then an exact second pass."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from echolattice.runtime import Written

#: A summary: values in ascending order, counts that are never too low, by how much each may be too high, and the most an absent value may have.
Summary = tuple[np.ndarray, np.ndarray, np.ndarray, int]
EMPTY: Summary = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0)


def merge(a: Summary, b: Summary, counters: int) -> Summary:
    """Space-saving merge: a value that only one side holds may have occurred as often as the other side's smallest counter."""
    items = np.union1d(a[0], b[0])
    count, error, floor = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64), 0
    for values, c, e, absent in (a, b):
        held = np.zeros(len(items), bool)
        at = np.searchsorted(items, values)
        held[at] = True
        count[at] += c
        error[at] += e
        count[~held] += absent
        error[~held] += absent
        floor += absent
    if len(items) > counters:
        cut = np.argpartition(-count, counters - 1)
        keep = np.sort(cut[:counters])
        floor = int(count[cut[counters:]].max())
        items, count, error = items[keep], count[keep], error[keep]
    return items, count, error, floor


def _rows(summary: Summary, n: int, node: int) -> dict[str, np.ndarray]:
    """The summary as rows; the first has its floor and number of rows and no value."""
    size = len(summary[0]) + 1
    return {"node": np.full(size, node, np.int64), "head": np.arange(size) == 0, "item": np.append(0, summary[0]), "n": np.append(n, summary[1]), "err": np.append(summary[3], summary[2]), "total": np.full(size, n, np.int64)}


_SCHEMA = "node bigint, head boolean, item bigint, n bigint, err bigint, total bigint"


def _scan(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    summary, n = EMPTY, 0
    wait: list[np.ndarray] = []
    for b in batches:
        wait.append(b.column(0).to_numpy(zero_copy_only=False))
        n += b.num_rows
        if sum(map(len, wait)) > 8 * counters:
            values, counts = np.unique(np.concatenate(wait), return_counts=True)
            summary, wait = merge(summary, (values, counts, np.zeros(len(values), np.int64), 0), counters), []
    if n:
        if wait:
            values, counts = np.unique(np.concatenate(wait), return_counts=True)
            summary = merge(summary, (values, counts, np.zeros(len(values), np.int64), 0), counters)
        yield pa.RecordBatch.from_pydict(_rows(summary, n, TaskContext.get().partitionId()))


def _join(rows: pd.DataFrame, counters: int, fan_in: int, node: int) -> pd.DataFrame:
    if len(rows) > fan_in * (counters + 1):
        raise RuntimeError(f"{len(rows)} rows of summaries in one task")
    summary, n = EMPTY, 0
    for _, x in rows.sort_values(["node", "head", "item"], ascending=[True, False, True]).groupby("node", sort=True):
        body = x[~x["head"]]
        n += int(x.loc[x["head"], "n"].iloc[0])
        summary = merge(summary, (*(body[c].to_numpy() for c in ("item", "n", "err")), int(x.loc[x["head"], "err"].iloc[0])), counters)
    return pd.DataFrame(_rows(summary, n, node))


def summarize(df: DataFrame, column: str, counters: int, fan_in: int = 16) -> DataFrame:
    """One merged summary over all non-null values: rows of ``_SCHEMA``. A task holds ``fan_in`` summaries of ``counters`` rows at most, however many partitions there are.

    Each count exceeds the true one by at most ``err``, and ``err`` is at most rows / counters. The summaries of the partitions are stored, so the levels of the tree are known.
    """
    parts = df.select(F.col(column).cast("bigint")).where(F.col(column).isNotNull()).mapInArrow(lambda b: _scan(b, counters), _SCHEMA)
    seen = Observation()
    parts = Written(parts.observe(seen, F.max("node").alias("last")), "summaries").df
    last = seen.get["last"]
    nodes = 1 if last is None else last + 1
    while nodes > 1:
        # neighbours meet: ceil(nodes / fan_in) groups of at most fan_in summaries
        parts = parts.groupBy(F.expr(f"node div {fan_in}").alias("at")).applyInPandas(lambda key, x: _join(x, counters, fan_in, int(key[0])), _SCHEMA)
        nodes = -(-nodes // fan_in)
    return parts


def frequent(df: DataFrame, column: str, share: float, counters: int | None = None) -> DataFrame:
    """``column, n_rows, n_estimated, n_over`` of each value in at least ``share`` of the rows with a non-null value.

    ``n_rows`` is exact, from a second pass that counts only the candidates; ``n_estimated`` is the merged summary's count, too high by at most ``n_over``.
    Repeated rows count each time, nulls never; a table without values gives no rows; other columns aren't read. The column is a whole number.
    No value is missed: ``counters`` (default 4 / share) must be at least 1 / share, else it raises ValueError, and then a value outside the summary has fewer rows than the smallest counter. The candidates broadcast to the second pass are at most ``counters``.
    """
    part = Fraction(share).limit_denominator(10**9)
    enough = lambda n: n * F.lit(part.denominator) >= F.col("_total") * F.lit(part.numerator)
    counters = int(np.ceil(4 / share)) if counters is None else counters
    if counters * part < 1:
        raise ValueError(f"{counters} counters can't hold every value with a share of {share}")
    merged = summarize(df, column, counters).where("NOT head").withColumnRenamed("total", "_total")
    found = merged.where(enough(F.col("n"))).select(F.col("item").alias("_item"), F.col("n").alias("n_estimated"), F.col("err").alias("n_over"), "_total")
    rows = df.select(F.col(column).cast("bigint").alias("_item")).where("_item IS NOT NULL")
    exact = rows.join(F.broadcast(found), "_item").groupBy("_item").agg(F.count(F.lit(1)).alias("n_rows"), F.first("n_estimated").alias("n_estimated"), F.first("n_over").alias("n_over"), F.first("_total").alias("_total"))
    return exact.where(enough(F.col("n_rows"))).select(F.col("_item").cast(df.schema[column].dataType).alias(column), "n_rows", "n_estimated", "n_over")
