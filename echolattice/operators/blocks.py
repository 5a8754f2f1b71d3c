"""Matching by blocks of queries and references, for indexes whose hot hashes give nearly every pair of them some hits.

Such a pair's hits are a product of rows and far more than either side, so none is listed in a shuffle: a task holds the postings of a block of references that a block of queries can meet, counts hits without making them, makes
those that it must look at, a few at a time in memory, and returns only what is asked for of each pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolattice.config import AlgorithmConfig
from echolattice.operators.index import only_parts, small
from echolattice.runtime import Written

#: Queries and postings in a block, and hits, or cells of a table of pairs, made at a time.
QUERIES, POSTINGS, CHUNK, CELLS = 512, 200_000, 500_000, 1_000_000
#: Cells of a table of windows and references, and postings of windows of a single query, that a task holds at a time.
TABLE = 2_000_000
#: A hash whose meetings fill at least one in so many cells is counted in a matrix product.
DENSE = 64
_ARROW = {"int": pa.int32(), "bigint": pa.int64()}


def _in_blocks(asked: DataFrame, index: DataFrame, config: AlgorithmConfig, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on each pair of blocks of ``asked`` (``query_id, hash`` and more, one row each) and of the postings of ``index`` that lie near one of its hashes (all columns, ``resource_id`` as ``ref_id``)."""
    r, spark = config.query_range, asked.sparkSession
    rows = Written(asked, "asked")
    queries = rows.df.select("query_id").distinct().count()
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    stored = rows.df.withColumn("a", block("query_id", na := max(1, -(-queries // QUERIES))))
    near = Written(stored.select("a", F.explode(F.sequence(F.col("hash") - r, F.col("hash") + r)).alias("near_hash")).distinct(), "near")
    held = index.where("hash IS NOT NULL AND resource_id IS NOT NULL")
    if "part" in held.columns:
        held = only_parts(held, near, "near_hash").drop("part")
    # at most one row for each block of queries: hashes that no query is near to drop out here
    met = held.join(small(near.df.withColumnRenamed("near_hash", "hash"), near.rows), "hash").withColumnRenamed("resource_id", "ref_id")
    nb = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // POSTINGS))
    left = stored.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    right = met.withColumn("b", block("ref_id", nb))
    # few bytes but much work: a number of partitions of its own keeps adaptive execution from joining them
    left, right = (x.repartition(na * nb, "a", "b") for x in (left, right))
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(work, schema)


def _sorted_asked(left: pa.Table, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ids of the queries; near hashes in order, and of each the number of its query and its row."""
    ids, q = np.unique(left["query_id"].to_numpy(), return_inverse=True)
    h = (left["hash"].to_numpy()[:, None] + np.arange(-r, r + 1)).reshape(-1)
    row = np.repeat(np.arange(left.num_rows), 2 * r + 1)
    order = np.argsort(h, kind="stable")
    return ids, h[order], q[row[order]], row[order]


def _expanded(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that meet ``n`` places from ``first`` on: row and place of each meeting."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) + np.repeat(first - (np.cumsum(n) - n), n)


def _chunks(ref: np.ndarray, cost: np.ndarray, most: int) -> Iterator[slice]:
    """Rows ordered by ``ref`` in slices of whole references that cost at most ``most``, or of one reference."""
    ends = np.append(np.flatnonzero(ref[1:] != ref[:-1]) + 1, len(ref))
    total, at, last = np.cumsum(cost), 0, 0
    for e, nxt in zip(ends, [*ends[1:], None], strict=True):
        if nxt is None or total[nxt - 1] - last > most:
            yield slice(at, e)
            at, last = e, total[e - 1]


def _ordered(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Columns of non-negative integers in the order of all of them, packed into one if they fit."""
    bits = [int(k.max()).bit_length() for k in keys]
    if sum(bits) > 63:
        order = np.lexsort(keys[::-1])
        return tuple(k[order] for k in keys)
    packed = keys[0].astype(np.int64)
    for k, b in zip(keys[1:], bits[1:], strict=True):
        packed = packed << b | k
    packed.sort()
    out = []
    for b in bits[:0:-1]:
        out.append(packed & ((1 << b) - 1))
        packed = packed >> b
    return (packed, *out[::-1])


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _modes(pair: np.ndarray, delta: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of each pair (numbered from 0 without gaps) the ``delta`` with most ``weight``, the smallest among equals."""
    low = delta.min()
    p, d, w = _ordered((pair, delta - low, weight))
    run = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (d[1:] != d[:-1])))
    n, k = np.add.reduceat(w, run), len(run)
    best = np.maximum.reduceat(n * k + (k - 1 - np.arange(k)), _starts(p[run]))
    return d[run][k - 1 - best % k] + low


@dataclass
class _Asked:
    """Prints of some queries by (query, time), and the windows in which they meet postings: a hash that is its query's only one at that time, whoever asks for it, or all hashes of a query at one time."""

    query: np.ndarray
    time: np.ndarray
    unknown: np.ndarray  # whether the time is
    window: np.ndarray
    times: np.ndarray  # how often the prints repeat each hit of the window
    # windows, each with one hash or several
    hashes: tuple[np.ndarray, np.ndarray, np.ndarray]  # window, hash and times in it

    @classmethod
    def of(cls, q: np.ndarray, t: np.ndarray, unknown: np.ndarray, h: np.ndarray, times: np.ndarray) -> _Asked:
        """From rows in the order of ``q`` and ``t``."""
        at, alone = _groups(q, t)
        own, number = np.unique(h[alone], return_inverse=True)
        group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(q))))
        window = np.empty(len(at), np.int64)
        window[group[alone]] = number
        shared = np.unique(group[~alone])
        window[shared] = len(own) + np.arange(len(shared))
        one = np.ones(len(own), np.int64)
        hashes = (np.append(np.arange(len(own)), window[group[~alone]]), np.append(own, h[~alone]), np.append(one, times[~alone]))
        return cls(q[at], t[at], unknown[at], window, np.where(alone[at], times[at], 1), hashes)


def _groups(q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows ordered by ``q`` and ``t``: where each pair of them begins; the rows that have theirs for themselves."""
    at = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (t[1:] != t[:-1])))
    n = np.diff(np.append(at, len(q)))
    return at, np.repeat(n == 1, n)


class _Met:
    """The postings of each window and of each of ``refs`` references in the order of time: no hits, but what they are made of."""

    def __init__(self, asked: _Asked, r: int, rh: np.ndarray, ref: np.ndarray, mt: np.ndarray, unknown: np.ndarray, refs: int):
        """Postings in the order of their hashes ``rh``."""
        w, h, times = asked.hashes
        lo = np.searchsorted(rh, h - r, "left")
        row, place = _expanded(lo, np.searchsorted(rh, h + r, "right") - lo)
        cell = w[row] * refs + ref[place]
        self.refs, self.low, self.high = refs, int(mt.min()), int(mt.max())
        self.span = self.high - self.low + 2
        key = cell * self.span + (mt[place] - self.low)
        order = np.argsort(key)
        self.key, self.time, self.weight = key[order], mt[place][order], times[row][order]
        shape = (int(w.max()) + 1, refs)
        n = np.bincount(cell, minlength=shape[0] * refs)
        self.start, self.ahead = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(self.weight))
        self.hits = (self.ahead[self.start[1:]] - self.ahead[self.start[:-1]]).reshape(shape)
        self.unknown = np.bincount(cell[unknown[place]], minlength=len(n)).reshape(shape) > 0 if unknown.any() else None

    def near(self, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of the postings of each cell from time ``low`` to ``high``, and their number; of a cell with few postings all."""
        s, e = self.start[cell], self.start[cell + 1]
        many = np.flatnonzero(e - s > 32)
        at = cell[many] * self.span - self.low
        s[many] = np.searchsorted(self.key, at + np.clip(np.ceil(low[many]), self.low, self.high + 1).astype(np.int64), "left")
        e[many] = np.searchsorted(self.key, at + np.clip(np.floor(high[many]), self.low - 1, self.high).astype(np.int64), "right")
        return s, np.maximum(e - s, 0)


def _on_a_line(t: np.ndarray, unknown: np.ndarray, window: np.ndarray, times: np.ndarray, met: _Met, config: AlgorithmConfig) -> np.ndarray:
    """The references that one query, its windows and their repeats given by time, may match: with enough hits, of these enough on a line of a plausible slope, over a long enough time and with enough seconds covered. The rules of :mod:`match`, with a margin for rounding, but for the frequency factor; and those with a hit of unknown time.

    Hits are counted for all references; made are only those of the first and last part and, where these give a plausible line, those near it.
    """
    hits = met.hits[window] * times[:, None]
    kept = np.zeros(met.refs, bool) if met.unknown is None else met.unknown[window].any(0)
    kept |= (hits[unknown] > 0).any(0)
    until = hits.cumsum(0)
    cols = np.flatnonzero((until[-1] >= config.min_hits_unfiltered) & ~kept)
    sure = np.flatnonzero(kept)
    if not len(cols):
        return sure
    hits, until = hits[:, cols], until[:, cols]
    n = until[-1]
    size = np.minimum(config.part_max_size, np.maximum(config.min_hits_unfiltered, n // config.part_divider))

    def mode(before: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """The most frequent time difference of the first or last part, and the query time of its first or last hit there."""
        k, r = np.nonzero((hits > 0) & (before < size))
        room, again, cell = size[r] - before[k, r], times[k], window[k] * met.refs + cols[r]
        s, e = met.start[cell], met.start[cell + 1]
        take = np.minimum(e - s, -(-room // again))
        g, at = _expanded(e - take if last else s, take)
        ahead = met.ahead[e][g] - met.ahead[at + 1] if last else met.ahead[at] - met.ahead[s][g]
        weight = np.minimum(met.weight[at] * again[g], room[g] - ahead * again[g])
        if weight.min() <= 0:
            g, at, weight = (x[weight > 0] for x in (g, at, weight))
        p, qt = r[g], t[k][g]
        delta = met.time[at] - qt
        y = _modes(p, delta, weight)
        mine = np.flatnonzero(delta == y[p])  # by query time, so the last that is assigned is the one
        mine = mine if last else mine[::-1]
        x = np.empty(len(cols), np.int64)
        x[p[mine]] = qt[mine]
        return y, x

    (y1, x1), (y2, x2) = mode(until - hits, False), mode(n - until, True)
    slope = (y2 - y1) / np.where(x2 == x1, 1, x2 - x1)
    with np.errstate(divide="ignore"):
        a, b = np.float64(config.min_time_factor), np.float64(config.max_time_factor)
        low, high = (1 - 1 / a, 1 - 1 / b) if config.kind == "constant_q" else (1 - b, 1 - a)
    fits = np.flatnonzero((x2 != x1) & (slope > low - 1e-9) & (slope < high + 1e-9))
    slope, offset, cols = slope[fits], (y1 - x1 * slope)[fits], cols[fits]
    k, r = np.nonzero(hits[:, fits] > 0)
    line, reach = slope[r] * t[k] + offset[r], config.query_range + 1e-6
    g, at = _expanded(*met.near(window[k] * met.refs + cols[r], t[k] + line - reach - 1, t[k] + line + reach + 1))
    qt, mt = t[k][g], met.time[at]
    on = np.abs(mt - qt - line[g]) <= reach
    p, qt, mt, score = r[g][on], qt[on], mt[on], (met.weight[at] * times[k][g])[on]
    sec = lambda t: t * config.seconds_per_block + (config.latency_seconds if config.kind == "constant_q" else 0.0)
    first, last = np.zeros(len(cols), np.int64), np.zeros(len(cols), np.int64)
    first[p[::-1]], last[p] = qt[::-1], qt
    good = (np.bincount(p, score, len(cols)) > config.min_hits_filtered) & (sec(last) - sec(first) >= config.min_match_duration - 1e-6)
    some = good[p]
    if not some.any():
        return sure
    p, qt, mt = _ordered((p[some], qt[some] - qt.min(), mt[some] - (m0 := mt.min())))
    mt += m0
    s = _starts(p)
    size = np.diff(np.append(s, len(p)))
    start, stop = sec(mt[s]), sec(mt[s + size - 1])
    second = (sec(mt) - np.repeat(start, size)).astype(np.int64)
    i, sl = _ordered((np.repeat(np.arange(len(s)), size), second - second.min()))
    bins = np.bincount(i[np.append(True, (i[1:] != i[:-1]) | (sl[1:] != sl[:-1]))], minlength=len(s))
    span = np.ceil(stop - start)
    cover = np.where(span != 0, 1 - (span - bins) / np.where(span == 0, 1, span), -np.inf)
    return np.append(sure, cols[p[s[cover >= config.min_seconds_with_match - 1e-6]]])


def _times(x: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Times as integers, unknown ones less than all others; which are unknown."""
    none = x.is_null().to_numpy()
    least = (pc.min(x).as_py() or 0) - 1
    return x.fill_null(least).to_numpy().astype(np.int64), none


def lines(left: pa.Table, right: pa.Table, config: AlgorithmConfig) -> tuple[np.ndarray, np.ndarray]:
    """Queries and references of all pairs, of the prints ``query_id, hash, times, qt`` and the postings ``ref_id, hash, t1``, that :func:`_on_a_line` finds."""
    found_q, found_r = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not left.num_rows or not right.num_rows:
        return found_q[0], found_r[0]
    ids, q = np.unique(left["query_id"].to_numpy(), return_inverse=True)
    h, times, (qt, lost) = left["hash"].to_numpy(), left["times"].to_numpy(), _times(left["qt"])
    order = np.lexsort((qt, q))
    q, h, times, qt, lost = (x[order] for x in (q, h, times, qt, lost))
    refs, ref = np.unique(right["ref_id"].to_numpy(), return_inverse=True)
    rh, (mt, gone) = right["hash"].to_numpy(), _times(right["t1"])
    order = np.lexsort((rh, ref))
    rh, ref, mt, gone = (x[order] for x in (rh, ref, mt, gone))
    step = max(1, TABLE // int(np.bincount(q).max()))
    for r0 in range(0, len(refs), step):
        part = np.arange(*np.searchsorted(ref, (r0, r0 + step)))
        part = part[np.argsort(rh[part], kind="stable")]
        width = min(step, len(refs) - r0)
        held = rh[part]
        n = np.searchsorted(held, h + config.query_range, "right") - np.searchsorted(held, h - config.query_range, "left")
        rows = np.flatnonzero(n)
        if not len(rows):
            continue
        # a window costs a row of the table, one of a single query also its postings
        cost = width + np.where(_groups(q[rows], qt[rows])[1], 0, n[rows])
        for some in _chunks(q[rows], cost, TABLE):
            mine = rows[some]
            asked = _Asked.of(q[mine], qt[mine], lost[mine], h[mine], times[mine])
            met = _Met(asked, config.query_range, held, ref[part] - r0, mt[part], gone[part], width)
            starts = _starts(asked.query)
            for at, end in zip(starts, [*starts[1:], len(asked.query)], strict=True):
                got = _on_a_line(asked.time[at:end], asked.unknown[at:end], asked.window[at:end], asked.times[at:end], met, config)
                found_q.append(np.full(len(got), asked.query[at]))
                found_r.append(got + r0)
    return ids[np.concatenate(found_q)], refs[np.concatenate(found_r)]


def aligned_pairs(queries: DataFrame, index: DataFrame, config: AlgorithmConfig) -> DataFrame:
    """``query_id, resource_id``: every pair that can have a result without the fallback, and few others. :func:`match.query` lists and judges the hits of these pairs.

    ``queries`` and ``index`` as for :func:`match.near_hash_join`. A pair with a hit of unknown time is kept, for that to decide.
    """
    asked = queries.where("hash IS NOT NULL AND query_id IS NOT NULL").groupBy("query_id", "hash").agg(F.count(F.lit(1)).alias("times"), F.max(F.struct("t1", "f1"))["t1"].alias("qt"))
    kinds = [(c, x.schema[k].dataType.simpleString()) for c, x, k in (("query_id", queries, "query_id"), ("resource_id", index, "resource_id"))]
    schema = ", ".join(f"{c} {k}" for c, k in kinds)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.table({c: pa.array(x, _ARROW[k]) for (c, k), x in zip(kinds, lines(left, right, config), strict=True)})

    slim = index.select("hash", "resource_id", "t1", *(["part"] if "part" in index.columns else []))
    return _in_blocks(asked, slim, config, work, schema)


def _products(h: np.ndarray, aq: np.ndarray, times: np.ndarray, rh: np.ndarray, ref: np.ndarray, queries: int, refs: int) -> np.ndarray:
    """The number of hits of each reference and query, as a table: hashes that fill many cells by a matrix product, the meetings of all others one by one."""
    lo = np.searchsorted(h, rh, "left")
    n = np.searchsorted(h, rh, "right") - lo
    met = n > 0
    lo, n, ref = lo[met], n[met], ref[met]
    first, number, held = np.unique(lo, return_inverse=True, return_counts=True)  # a hash is named by its first place in h
    width = n[np.unique(number, return_index=True)[1]] if len(n) else n
    hot = np.flatnonzero(width * held * DENSE >= queries * refs)
    cells = np.zeros(refs * queries)
    if len(hot):
        k, place = _expanded(first[hot], width[hot])
        a = np.bincount(k * queries + aq[place], times[place], len(hot) * queries).reshape(len(hot), queries)
        to = np.full(len(first), -1)
        to[hot] = np.arange(len(hot))
        at = to[number]
        b = np.bincount(ref[at >= 0] * len(hot) + at[at >= 0], minlength=refs * len(hot)).reshape(refs, len(hot)).astype(float)
        cells += (b @ a).reshape(-1)
        lo, n, ref = lo[at < 0], n[at < 0], ref[at < 0]
    for rows in _chunks(np.arange(len(n)), n, CHUNK) if len(n) else ():
        row, place = _expanded(lo[rows], n[rows])
        np.add.at(cells, ref[rows][row] * queries + aq[place], times[place].astype(float))
    return cells


def hit_counts(queries: DataFrame, index: DataFrame, config: AlgorithmConfig) -> DataFrame:
    """``query_id, ref_id, hits``: the hits of :func:`match.near_hash_join` of each pair that has enough of them, without listing them or shuffling pairs: each pair is counted in one task, and only those with enough leave it."""
    asked = queries.where("hash IS NOT NULL AND query_id IS NOT NULL").groupBy("query_id", "hash").agg(F.count(F.lit(1)).alias("times"))
    kinds = [x.schema[k].dataType.simpleString() for x, k in ((queries, "query_id"), (index, "resource_id"))]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, h, aq, row = _sorted_asked(left, config.query_range)
            times = left["times"].to_numpy()[row]
            right = right.sort_by("ref_id")
            refs, ref = np.unique(right["ref_id"].to_numpy(), return_inverse=True)
            rh, step = right["hash"].to_numpy(), max(1, CELLS // len(ids))
            for r0 in range(0, len(refs), step):
                part = slice(*np.searchsorted(ref, (r0, r0 + step)))
                cells = _products(h, aq, times, rh[part], ref[part] - r0, len(ids), min(step, len(refs) - r0))
                at = np.flatnonzero(cells >= config.min_hits_unfiltered)
                for to, x in zip(found, (ids[at % len(ids)], refs[at // len(ids) + r0], cells[at].astype(np.int64)), strict=True):
                    to.append(x)
        return pa.table({c: pa.array(np.concatenate(x) if x else [], _ARROW[k]) for c, x, k in zip(("query_id", "ref_id", "hits"), found, (*kinds, "bigint"), strict=True)})

    return _in_blocks(asked, index.select("hash", "resource_id", *(["part"] if "part" in index.columns else [])), config, work, f"query_id {kinds[0]}, ref_id {kinds[1]}, hits bigint")
