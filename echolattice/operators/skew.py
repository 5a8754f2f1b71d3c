"""Per-key results where a handful of keys hold most rows.

A key is heavy when it holds more rows than a task should: about the rows of the table over the number of shuffle partitions. Heavy keys are found in a
sample whose size follows the number of partitions, never the table, and there are at most twice as many as partitions: that bounds
what is broadcast. The sample only steers the path a key takes; results don't depend on it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from echolattice.runtime import Written, shuffle_partitions

#: Sampled rows for each shuffle partition: a key that fills a task is expected so often in the sample, and counts as heavy from half of that on.
SAMPLED = 64


def heavy_keys(df: DataFrame, keys: list[Column], rows: int | None = None) -> list[list]:
    """For each of the columns ``keys`` the values that hold more than half a shuffle partition's share of ``df``, going by a sample; at most 2 * partitions of each.

    ``df`` should be a stored table; ``rows``, its number of rows, is counted if not given. Whole numbers and strings; nulls are never heavy.
    """
    parts = shuffle_partitions(df.sparkSession)
    rows = df.count() if rows is None else rows
    want = SAMPLED * parts
    part = df.sample(want / rows, seed=7) if rows > 2 * want else df
    sampled = min(rows, want) if rows > 2 * want else rows
    out: list[list] = []
    counted = part.select(F.inline(F.array(*(F.struct(F.lit(i).alias("i"), k.cast("string").alias("v")) for i, k in enumerate(keys))))).where("v IS NOT NULL")
    found = counted.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * 2 * parts > sampled).collect()
    for i, k in enumerate(keys):
        text = df.select(k.alias("k")).schema["k"].dataType.simpleString() == "string"
        out.append(sorted(r["v"] if text else int(r["v"]) for r in found if r["i"] == i))
    return out


def key_table(df: DataFrame, key: str, values: list) -> DataFrame:
    """The given keys as a table of one literal, typed like ``df[key]``."""
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")).alias(key))


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """``left.join(right, key, how)`` ('inner' or 'left') where ``right`` has at most one row a key and a few keys may hold most rows of ``left``.

    Rows of the heavy keys of ``left`` meet their partners by broadcast - at most two for each shuffle partition, by :func:`heavy_keys` - and stay where they are; all others take an ordinary join.
    ``left`` is read more than once, so pass a stored table. Null keys meet nothing.
    """
    (heavy,) = heavy_keys(left, [F.col(key)], rows)
    if not heavy:
        return left.join(right, key, how)
    few = F.broadcast(key_table(left, key, heavy))
    hot = left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key, how)
    return hot.unionByName(left.join(few, key, "left_anti").join(right, key, how))


def profile_both_ways(df: DataFrame, left: str, right: str, value: str) -> DataFrame:
    """``field_name, key_value, n_rows, n_partners (distinct, non-null), first_value, last_value, field_rows`` of each non-null key of both columns.

    The table is read once, into a stored pre-aggregate by (left, right), which no single key can skew and in which partners are distinct. It serves both columns: rows of heavy keys,
    picked by a broadcast join, are spread over slots by their partner and added up again, all other keys take one ordinary shuffle on the key with a partial aggregate before
    it, and the two are united. Nulls: a null partner counts as a row but not as a partner; null values don't count for first and last; rows with
    a null key belong to no key. An empty table gives no rows; columns beside the three are not read. Keys are whole numbers.
    """
    slots = shuffle_partitions(df.sparkSession)
    rows = df.select(F.col(left).cast("bigint").alias("_l"), F.col(right).cast("bigint").alias("_r"), F.col(value).alias("_v")).where("_l IS NOT NULL OR _r IS NOT NULL")
    seen = Observation()
    count = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col("_n"))), F.lit(0))
    pairs = rows.groupBy("_l", "_r").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # the numbers of rows come from the tasks that write the table, each of which counts once
    stored = Written(pairs.observe(seen, count("_l").alias("l"), count("_r").alias("r")), "pairs")
    pairs, total = stored.df, seen.get
    heavy = heavy_keys(pairs, [F.col("_l"), F.col("_r")], stored.rows)
    listed = [[0, k] for k in heavy[0]] + [[1, k] for k in heavy[1]]
    few = df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"_f": f, "_k": k} for f, k in listed])), "array<struct<_f int, _k bigint>>"))).withColumn("_heavy", F.lit(True))
    side = lambda f, key, partner: F.struct(F.lit(f).alias("_f"), F.col(key).alias("_k"), F.col(partner).alias("_p"), F.col("_n"), F.col("_lo"), F.col("_hi"))
    both = pairs.select(F.inline(F.array(side(0, "_l", "_r"), side(1, "_r", "_l")))).where("_k IS NOT NULL")
    tagged = both.join(F.broadcast(few), ["_f", "_k"], "left").withColumn("_slot", F.when(F.col("_heavy"), F.pmod(F.xxhash64("_p"), F.lit(slots))))
    first = tagged.groupBy("_f", "_k", "_slot").agg(F.sum("_n").alias("_n"), F.count("_p").alias("_d"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_heavy").alias("_heavy"))
    # both filters are on an aggregate, so neither goes below the shuffle and the two branches share it
    sums = (F.sum("_n").alias("_n"), F.sum("_d").alias("_d"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    out = ("_f", "_k", "_n", "_d", "_lo", "_hi")
    united = first.where("_heavy").groupBy("_f", "_k").agg(*sums).select(*out).unionByName(first.where("_heavy IS NULL").select(*out))
    named = F.col("_f") == 0
    return united.select(
        F.when(named, F.lit(left)).otherwise(F.lit(right)).alias("field_name"), F.col("_k").alias("key_value"), F.col("_n").alias("n_rows"), F.col("_d").alias("n_partners"), F.col("_lo").alias("first_value"), F.col("_hi").alias("last_value"),
        F.when(named, F.lit(total["l"])).otherwise(F.lit(total["r"])).cast("bigint").alias("field_rows"),
    )
