"""Delimited lines with quoting: typed rows, or the reason and place of the failure.

A finite-state tokenizer runs over the bytes of a whole Arrow batch at once. The buffer is cut into chunks of equal length; for each
chunk the composition of its transitions is computed for every start state at once (all chunks side by side), the compositions are
combined over the chunks, and a second scan with the true start state gives the state at each byte. So one very long line costs the
same a byte as many short ones. The end of a record is a symbol of its own that leads back to the start state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Symbols and states.
OTHER, QUOTE, SEP, SPACE, END = range(5)
START, PLAIN, QUOTED, CLOSING, AFTER, BROKEN = range(6)
#: State after (state, symbol).
STEP = np.array([
    [PLAIN, QUOTED, START, START, START],
    [PLAIN, BROKEN, START, PLAIN, START],
    [QUOTED, CLOSING, QUOTED, QUOTED, START],
    [BROKEN, QUOTED, START, AFTER, START],
    [BROKEN, BROKEN, START, AFTER, START],
    [BROKEN, BROKEN, BROKEN, BROKEN, START],
], np.uint8)


def scan_states(symbols: np.ndarray, chunk: int = 512) -> np.ndarray:
    """State before each symbol; the first is START."""
    n, k = len(symbols), len(STEP)
    if not n:
        return np.zeros(0, np.uint8)
    blocks = -(-n // chunk)
    padded = np.full(blocks * chunk, END, np.uint8)
    padded[:n] = symbols
    grid = np.ascontiguousarray(padded.reshape(blocks, chunk).T)
    flat = STEP.reshape(-1)
    reach = np.repeat(np.arange(k, dtype=np.uint8)[:, None], blocks, 1)
    for row in grid:
        reach = flat[reach * np.uint8(5) + row]
    ahead = 1
    while ahead < blocks:  # compositions over 1, 2, 4, ... chunks, until each reaches back to the first
        reach[:, ahead:] = np.take_along_axis(reach[:, ahead:], reach[:, :-ahead], 0)
        ahead *= 2
    begin = np.append(np.zeros(1, np.uint8), reach[START, :-1])
    before = np.empty_like(grid)
    state = begin
    for j, row in enumerate(grid):
        before[j] = state
        state = flat[state * np.uint8(5) + row]
    return before.T.reshape(-1)[:n]


def tokenize(lines: pa.Array, width: int, sep: str, quote: str) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray]:
    """Of each line: its ``width`` fields and the byte offsets where they begin (empty lists if it fails), the reason, the byte offset of the failure."""
    null = lines.is_null().to_numpy(zero_copy_only=False)
    lines = lines.fill_null("").cast(pa.large_binary())
    count = len(lines)
    offs = np.frombuffer(lines.buffers()[1], np.int64, count + 1, lines.offset * 8)
    size = np.diff(offs)
    text = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    ends = np.cumsum(size + 1) - 1  # place of each line's end symbol
    begins = ends - size
    data = np.zeros(len(text) + count, np.uint8)
    is_end = np.zeros(len(data), bool)
    is_end[ends] = True
    data[~is_end] = text
    kind = np.full(256, OTHER, np.uint8)
    kind[[9, 13, 32]] = SPACE
    kind[ord(sep)], kind[ord(quote)] = SEP, QUOTE
    symbols = kind[data]
    symbols[is_end] = END
    state = scan_states(symbols)

    line = np.repeat(np.arange(count), size + 1)
    bad = np.flatnonzero((state == BROKEN) | (is_end & (state == QUOTED)))
    broken = np.full(count, -1, np.int64)
    broken[line[bad[::-1]]] = bad[::-1]
    entering = np.maximum(broken - 1, begins)  # the byte that broke it stands before the first broken state
    quoting = broken >= 0
    unclosed = quoting & (broken == ends) & (state[ends] == QUOTED)

    cut = is_end | ((symbols == SEP) & (state != QUOTED) & (state != BROKEN))
    where = np.flatnonzero(cut)
    owner = line[where]
    fields = np.bincount(owner, minlength=count)
    good = ~quoting & (fields == width) & ~null
    first_cut = np.cumsum(fields) - fields
    surplus = where[np.minimum(first_cut + width - 1, len(where) - 1)] - begins  # the separator after the last field a line may have
    place = np.where(quoting, np.where(unclosed, size, entering - begins), np.where(fields < width, size, surplus))
    place[good] = -1
    reason = pa.array(["quoting", "columns"]).take(pa.array(np.where(quoting, 0, 1), mask=good))

    # bytes that belong to values: content symbols, no separators, no surrounding blanks, no delimiting quotes
    value = (state == QUOTED) & (symbols != QUOTE) & ~is_end
    value |= (state == CLOSING) & (symbols == QUOTE)  # the second of a doubled quote
    value |= ((state == START) | (state == PLAIN)) & (symbols == OTHER)
    inner = (state == PLAIN) & (symbols == SPACE)
    if inner.any():  # blanks within an unquoted field count only if something follows
        spot = np.where(symbols == SPACE, len(data), np.arange(len(data)))
        follows = np.minimum.accumulate(spot[::-1])[::-1]
        value |= inner & ~cut[np.minimum(follows, len(data) - 1)]
    keep = value & good[line]
    ok = good[owner]
    total = np.cumsum(keep)
    offsets = np.concatenate([[0], total[where[ok]]])
    strings = pa.LargeStringArray.from_buffers(int(ok.sum()), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[keep]))
    starts = np.concatenate([[0], where[:-1] + 1])[ok] - begins[owner[ok]] if len(where) else np.zeros(0, np.int64)
    lists = np.concatenate([[0], np.cumsum(np.where(good, width, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), strings.cast(pa.string())), pa.ListArray.from_arrays(pa.array(lists), pa.array(starts.astype(np.int32))), reason, place


def split_records(df: DataFrame, keys: list[str], text: str, width: int, sep: str = ";", quote: str = '"') -> DataFrame:
    """``keys..., fields ARRAY<STRING>, starts ARRAY<INT>, reason STRING, reason_at INT`` of each row of ``df``.

    Blanks, tabs and carriage returns around a field don't belong to it. A field that begins with a quote is quoted: a doubled quote inside
    is a quote, a separator is text, and after the closing quote only white space may follow. A line is either split into ``width`` fields (reason
    null) or has empty arrays, a reason - 'quoting' before 'columns' - and the byte offset of the failure.
    A null line has no columns: reason 'columns', offset 0; an empty one is a single empty field. Repeated lines stay; an empty table gives no rows; columns other than keys and text are not read, and a key must not be named like an output.
    """
    schema = T.StructType([*(df.schema[k] for k in keys), *T._parse_datatype_string("fields array<string>, starts array<int>, reason string, reason_at int").fields])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                fields, starts, reason, place = tokenize(b.column(n), width, sep, quote)
                at = pa.array(place.astype(np.int32), mask=place < 0)
                yield pa.RecordBatch.from_arrays([*b.columns[:n], fields, starts, reason, at], names=schema.names)

    return df.select(*keys, text).mapInArrow(run, schema)


_NUMBER = r"-?[0-9]+(\.[0-9]+)?"
#: Name and kind of the fields of a printed result line.
RESULT_FIELDS = (
    ("query_index", "int"), ("total_queries", "int"), ("query_path", "path"), ("query_start", "double"), ("query_stop", "double"),
    ("ref_path", "path"), ("ref_id", "id"), ("ref_start", "double"), ("ref_stop", "double"), ("match_score", "bigint"),
    ("time_factor", "factor"), ("frequency_factor", "factor"), ("seconds_with_match", "double"),
)


def _typed(x: Column, kind: str) -> tuple[Column, Column]:
    """The value of a field, and whether it is valid."""
    if kind == "path":
        return x, F.btrim(x, F.lit(" \t\r")) != ""
    if kind in ("int", "bigint", "id"):
        v = F.when(x.rlike(r"^-?[0-9]+\z"), x).try_cast("bigint" if kind == "bigint" else "int")
        return v, v.isNotNull() | (x == "null" if kind == "id" else F.lit(False))
    number = F.regexp_extract(x, rf"^({_NUMBER})[ \t\r]*%?\z", 1) if kind == "factor" else F.regexp_extract(x, rf"^({_NUMBER})\z", 1)
    v = F.when(number != "", number).try_cast("double")
    return v, F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False))


def parse_result_lines(df: DataFrame, key: str = "line_no", text: str = "raw_line") -> DataFrame:
    """Result lines as typed columns beside ``reason`` and ``reason_at``: rows with a null reason are valid, others have null values.

    Reasons, the first that applies: 'quoting', 'columns', 'value'; ``reason_at`` is the byte offset in the line (for 'value', of the first field that fails). An empty result (reference id ``null``) has a null id.
    Lines are otherwise handled as :func:`split_records` says.
    """
    parts = split_records(df, [key], text, len(RESULT_FIELDS))
    checks = [_typed(F.get("fields", F.lit(i)), kind) for i, (_, kind) in enumerate(RESULT_FIELDS)]
    wrong = F.lit(None).cast("int")
    for i in reversed(range(len(checks))):
        wrong = F.when(~checks[i][1], F.lit(i)).otherwise(wrong)
    x = parts.select(key, "fields", "starts", "reason", "reason_at", F.when(F.col("reason").isNull(), wrong).alias("_wrong"))
    fine = F.col("reason").isNull() & F.col("_wrong").isNull()
    return x.select(
        key, *(F.when(fine, v).alias(name) for (name, _), (v, _) in zip(RESULT_FIELDS, checks)),
        F.when(F.col("_wrong").isNotNull(), F.lit("value")).otherwise(F.col("reason")).alias("reason"),
        F.coalesce(F.col("reason_at"), F.get("starts", "_wrong")).alias("reason_at"),
    )
