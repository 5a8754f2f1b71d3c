import random

import numpy as np
import pyarrow as pa
import pytest

from echolattice.sources.rawlines import STEP, parse_result_lines, scan_states, split_records, tokenize

GOOD = "1 ; 5 ; q.wav ; 0.5 ; 9.25 ; r.mp3 ; 12 ; 1.000 ; 2 ; 40 ; 1.01 % ; 0.99% ; 0.83"


def brute(line, width):
    """Fields or the reason, one character after the other."""
    fields, i, n = [], 0, len(line)
    while True:
        while i < n and line[i] in " \t\r":
            i += 1
        if i < n and line[i] == '"':
            i, text = i + 1, ""
            while True:
                if i >= n:
                    return "quoting"
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        text, i = text + '"', i + 2
                        continue
                    i += 1
                    break
                text, i = text + line[i], i + 1
            while i < n and line[i] in " \t\r":
                i += 1
            if i < n and line[i] != ";":
                return "quoting"
            fields.append(text)
        else:
            j = line.find(";", i)
            j = n if j < 0 else j
            if '"' in line[i:j]:
                return "quoting"
            fields.append(line[i:j].rstrip(" \t\r"))
            i = j
        if i >= n:
            return fields if len(fields) == width else "columns"
        i += 1
        if i == n:  # a separator at the end: one more, empty field
            fields.append("")
            return fields if len(fields) == width else "columns"


def test_scan_equals_step_by_step():
    r = np.random.default_rng(3)
    for n in (0, 1, 5, 511, 512, 513, 5000):
        symbols = r.integers(0, 5, n).astype(np.uint8)
        state, want = 0, []
        for s in symbols:
            want.append(state)
            state = STEP[state, s]
        assert scan_states(symbols, 64).tolist() == want == scan_states(symbols).tolist()


@pytest.mark.parametrize("seed", range(6))
def test_random_lines(seed):
    r = random.Random(seed)
    lines = ["".join(r.choice('a"; \t\ré"";b') for _ in range(r.randrange(0, 14))) for _ in range(3000)]
    for width in (1, 2, 3):
        fields, starts, reason, place = tokenize(pa.array(lines), width, ";", '"')
        for line, f, s, why, at in zip(lines, fields.to_pylist(), starts.to_pylist(), reason.to_pylist(), place):
            want = brute(line, width)
            assert (why or f) == want, (line, why, f, want)
            assert (at >= 0) == (why is not None) and at <= len(line.encode())
            assert len(s) == len(f)


def test_nulls_slices_and_long_lines():
    long = '"' + "x;" * 300_000 + '"'
    lines = pa.array(["drop", None, "", long, "a;b"])[1:]
    fields, _, reason, _ = tokenize(lines, 1, ";", '"')
    assert reason.to_pylist() == ["columns", None, None, "columns"] and fields.to_pylist()[1:3] == [[""], ["x;" * 300_000]]


def test_typed_lines_and_reasons(spark):
    change = lambda i, v: " ; ".join(v if k == i else x.strip() for k, x in enumerate(GOOD.split(";")))
    cases = [
        (GOOD, None), (change(6, "null"), None), (change(9, '"40"'), None), (change(2, '"a; ""b"" "'), None), (change(10, "-1.000 %"), None), (change(10, "5"), None),
        (change(2, '""'), "value"), (change(2, '"  "'), "value"), (change(9, "1_0"), "value"), (change(9, "+4"), "value"), (change(0, "2147483648"), "value"), (change(9, "9223372036854775808"), "value"),
        (change(9, "9223372036854775807"), None), (change(3, "1e3"), "value"), (change(3, ".5"), "value"), (change(3, "5."), "value"), (change(3, "NaN"), "value"), (change(6, "NULL"), "value"), (change(10, "1 %%"), "value"), (change(12, "0.5 %"), "value"), (change(9, "٣"), "value"),
        (change(9, "40\n"), "value"), (change(9, '"40\n"'), "value"), (change(9, "\n40"), "value"), (change(0, "1\n"), "value"), (change(6, "null\n"), "value"), (change(10, "5 %\n"), "value"), (change(10, "5\n"), "value"), (GOOD + "\n", "value"), (GOOD + "\r", None), (change(3, "0.5\u2028"), "value"), (change(3, "0.5\u0085"), "value"),
        (change(9, '"4'), "quoting"), (change(9, '4"'), "quoting"), (change(9, '"4"x'), "quoting"), (GOOD + " ; ", "columns"), ("done", "columns"), ("", "columns"), (None, "columns"), ('x"', "quoting"),
    ]
    df = spark.createDataFrame([(i, c[0], "reason") for i, c in enumerate(cases)], "line_no bigint, raw_line string, reason string")
    rows = {r.line_no: r for r in parse_result_lines(df).collect()}
    assert {i: rows[i].reason for i in rows} == {i: c[1] for i, c in enumerate(cases)}
    r = rows[0]
    assert (r.query_index, r.query_path, r.query_stop, r.ref_id, r.match_score, r.time_factor, r.frequency_factor, r.seconds_with_match) == (1, "q.wav", 9.25, 12, 40, 1.01, 0.99, 0.83)
    assert rows[1].ref_id is None and rows[3].query_path == 'a; "b" ' and rows[6].query_path is None
    assert rows[8].reason_at == change(9, "1_0").index(" 1_0")


def test_empty_table(spark):
    df = spark.createDataFrame([], "line_no bigint, raw_line string")
    assert parse_result_lines(df).count() == 0 and split_records(df, ["line_no"], "raw_line", 3).count() == 0
