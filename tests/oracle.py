"""Compare a query with its SQL in DuckDB over the same tables."""

from collections import Counter
from pathlib import Path

import duckdb

FOLDER = "/root/testdata/sf0.001"


def norm(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


def assert_same(spark, query, sql, folder=FOLDER):
    df = query(spark, folder)
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cols = sorted(df.columns)
    assert sorted(con.sql(sql).columns) == cols
    got = Counter(tuple(map(norm, r)) for r in df.select(*cols).collect())
    want = Counter(tuple(map(norm, r)) for r in con.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({sql})").fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
