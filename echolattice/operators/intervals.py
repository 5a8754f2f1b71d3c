"""Continuous periods and gaps of overlapping intervals.

The rows are range-sorted by entity and start, so an entity of any size spreads over many partitions. Each partition merges
its own rows into local islands in one streaming pass and so yields a summary (first island, last island). A prefix
combination over the summaries - one row a partition - gives each partition the island that is still open when it begins.
The local islands are then scanned again against that carried state; this last step is a projection in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolattice.runtime import shuffle_partitions, written

_ISLAND = "_pid int, _first boolean, _last boolean, _start bigint, _stop bigint, _prev_stop bigint, _next_start bigint"


def running_max(values: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Cumulative maximum that begins anew with each segment (segments numbered upwards from 0)."""
    low, high = int(values.min()), int(values.max())
    span = high - low + 1
    if span * (int(segment[-1]) + 1) < 2**62:
        shift = segment * span
        return np.maximum.accumulate((values - low) + shift) - shift + low
    order = np.sort(values)
    rank = np.searchsorted(order, values) + segment * len(values)
    return order[np.maximum.accumulate(rank) - segment * len(values)]


def _islands(batches: Iterator[pa.RecordBatch], entity: list[str], start: str, stop: str) -> Iterator[pa.RecordBatch]:
    """Local islands of a partition sorted by entity and start. What is kept between batches is one open island."""
    pid = TaskContext.get().partitionId()
    carry: pa.Table | None = None
    carry_prev: int | None = None
    first = True

    def emit(rows: pa.Table, stops: np.ndarray, prev: np.ndarray, prev_ok: np.ndarray, nxt: np.ndarray, nxt_ok: np.ndarray, last: bool) -> pa.RecordBatch:
        nonlocal first
        n = len(rows)
        firsts = np.zeros(n, bool)
        firsts[0], first = first, False
        cols = [rows[c].combine_chunks() for c in entity]
        cols += [pa.array(np.full(n, pid, np.int32)), pa.array(firsts), pa.array(np.full(n, last)), rows[start].combine_chunks(), pa.array(stops), pa.array(prev, mask=~prev_ok), pa.array(nxt, mask=~nxt_ok)]
        return pa.RecordBatch.from_arrays(cols, names=[*entity, "_pid", "_first", "_last", "_start", "_stop", "_prev_stop", "_next_start"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if carry is not None:
            rows = pa.concat_tables([carry, rows])
        rows = rows.combine_chunks()
        n = len(rows)
        s, t = (rows[c].combine_chunks().to_numpy() for c in (start, stop))
        fresh = np.zeros(n, bool)
        fresh[0] = True
        for c in entity:
            col = rows[c].combine_chunks()
            fresh[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
        top = running_max(t, np.cumsum(fresh) - 1)
        head = fresh.copy()
        head[1:] |= s[1:] > top[:-1]
        at = np.flatnonzero(head)
        stops = top[np.append(at[1:], n) - 1]
        prev_ok = ~fresh[at]
        prev = np.where(prev_ok, top[at - 1], 0)
        if carry_prev is not None:
            prev_ok[0], prev[0] = True, carry_prev
        nxt_ok = np.append(~fresh[at[1:]], False)
        nxt = np.append(s[at[1:]], 0)
        done = at[:-1]
        if len(done):
            yield emit(rows.take(pa.array(done)), stops[:-1], prev[:-1], prev_ok[:-1], nxt[:-1], nxt_ok[:-1], False)
        carry = rows.slice(int(at[-1]), 1).set_column(rows.schema.get_field_index(stop), rows.schema.field(stop), pa.array(stops[-1:]))
        carry_prev = int(prev[-1]) if prev_ok[-1] else None
    if carry is not None:
        no = np.zeros(1, np.int64)
        yield emit(carry, carry[stop].to_numpy(), np.array([carry_prev or 0]), np.array([carry_prev is not None]), no, np.array([False]), True)


def _carried(frames: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Prefix combination over the partitions' summaries: the island open before each, and whether the next one goes on with it."""
    names = [f"_c{i}" for i in range(width)]
    parts = [f for f in frames if len(f)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True).sort_values("_pid")
    ends = rows[["first_start", "last_start", "last_stop"]].astype("int64").to_numpy().tolist()
    heads, tails = (rows[[f"{end}_e{i}" for i in range(width)]].to_numpy().tolist() for end in ("first", "last"))
    out: list[list] = []
    state: tuple[list, int | None, int | None] = ([None] * width, None, None)
    for pid, head, tail, (first_start, last_start, last_stop) in zip(rows["_pid"].tolist(), heads, tails, ends):
        goes_on = state[1] is not None and state[0] == head and first_start <= state[2]
        if out:
            out[-1][-1] = goes_on
        out.append([pid, *state[0], state[1], state[2], False])
        if goes_on and head == tail and last_start <= state[2]:
            state = (tail, state[1], max(state[2], last_stop))
        else:
            state = (tail, last_start, last_stop)
    frame = pd.DataFrame(out, columns=["_pid", *names, "_c_start", "_c_stop", "_goes_on"])
    frame[["_c_start", "_c_stop"]] = frame[["_c_start", "_c_stop"]].astype("Int64")
    yield frame


def periods_and_gaps(df: DataFrame, entity: list[str], start: str, stop: str) -> DataFrame:
    """Rows ``entity..., kind ('period' or 'gap'), start_at, stop_at`` of the intervals [start, stop] of each entity.

    * ``start`` and ``stop`` are whole numbers. Rows with a null in an entity column, start or stop, and rows whose start isn't before their stop, are no intervals and don't count.
    * Intervals that overlap, nest or touch make one period; repeated intervals count once. A gap lies between two periods of an entity, none before the first or after the last.
    * An empty table gives no rows. Other columns are not read.
    * Entity columns may be of any orderable type but must not be named ``kind``, ``start_at`` or ``stop_at``; others, clashing or not, are not read.

    One range shuffle of the narrow rows; the islands are written to the shared folder once, since a range partitioning mustn't be drawn twice.
    """
    keep = [F.col(c).alias(f"_e{i}") for i, c in enumerate(entity)]
    names = [f"_e{i}" for i in range(len(entity))]
    rows = df.select(*keep, F.col(start).cast("bigint").alias("_s"), F.col(stop).cast("bigint").alias("_t")).where(" AND ".join(f"{c} IS NOT NULL" for c in [*names, "_s", "_t"]) + " AND _s < _t")
    fields = [T.StructField(c, rows.schema[c].dataType) for c in names]
    schema = T.StructType([*fields, *T._parse_datatype_string(_ISLAND).fields])
    ordered = rows.repartitionByRange(shuffle_partitions(df.sparkSession), *names, "_s").sortWithinPartitions(*names, "_s")
    islands = written(ordered.mapInArrow(lambda b: _islands(b, names, "_s", "_t"), schema), "islands")

    ends = [(end, c) for end in ("first", "last") for c in (*names, "_start", "_stop")]
    summary = islands.where("_first OR _last").groupBy("_pid").agg(*(F.max(F.when(F.col(f"_{end}"), F.col(c))).alias(end + c) for end, c in ends))
    carried_schema = T.StructType([T.StructField("_pid", T.IntegerType()), *(T.StructField(f"_c{i}", f.dataType) for i, f in enumerate(fields)), T.StructField("_c_start", T.LongType()), T.StructField("_c_stop", T.LongType()), T.StructField("_goes_on", T.BooleanType())])
    width = len(names)
    carried = summary.repartition(1).mapInPandas(lambda f: _carried(f, width), carried_schema)

    x = islands.join(F.broadcast(carried), "_pid", "left")
    same = F.coalesce(F.expr(" AND ".join(f"_e{i} = _c{i}" for i in range(width))), F.lit(False))
    merged = same & (F.col("_start") <= F.col("_c_stop"))
    open_still = F.col("_last") & F.coalesce("_goes_on", F.lit(False))
    before = F.greatest(F.col("_prev_stop"), F.when(same, F.col("_c_stop")))
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("start_at"), b.alias("stop_at"))
    period = F.when(~open_still & ~merged, row("period", F.col("_start"), F.col("_stop"))).when(
        ~open_still & merged & (F.col("_next_start").isNull() | (F.col("_next_start") > F.col("_c_stop"))), row("period", F.col("_c_start"), F.greatest("_c_stop", "_stop"))
    )
    gap = F.when(~merged & before.isNotNull(), row("gap", before, F.col("_start")))
    return x.select(*names, F.explode(F.array_compact(F.array(period, gap))).alias("_o")).select(*(F.col(n).alias(c) for n, c in zip(names, entity)), "_o.kind", "_o.start_at", "_o.stop_at")
