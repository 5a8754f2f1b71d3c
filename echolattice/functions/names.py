"""Identifiers, paths and the names of query files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INT_MAX = 2**31 - 1


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def basename(path: Column) -> Column:
    """File name up to its last dot; all of it without one."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def combine(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def expand_home(path: Column, home: str) -> Column:
    return F.when(path.startswith("~"), F.concat(F.lit(home), F.substr(path, F.lit(2)))).otherwise(path)


def java_string_hash(text: Column) -> Column:
    """31-polynomial over the characters, as a signed 32-bit number (characters of the basic plane)."""
    wrapped = lambda x: F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    return F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), lambda h, ch: F.when(ch == "", h).otherwise(wrapped(h * 31 + F.ascii(ch)))).cast("int")


def identifier(path: Column, hashed: Column) -> Column:
    """A file name of digits with an extension is the identifier itself; otherwise, also for digits without one or beyond the integers, the upper half of the integers, offset by half the file's hash (or, if that is 0, half the name's hash)."""
    number = F.regexp_extract(file_name(path), r"^([0-9]+)\.[^.]+\z", 1).try_cast("int")
    h = F.when(hashed == 0, F.abs(java_string_hash(path))).otherwise(hashed)
    return F.coalesce(number, F.expr(f"{INT_MAX} div 2") + F.when(h >= 0, F.floor(h / 2)).otherwise(F.ceil(h / 2))).cast("int")


def query_id(name: Column) -> Column:
    """First number of a test file's name."""
    return F.regexp_extract(file_name(name), r"^(\d+).*mp3$", 1).try_cast("int")


def query_range(name: Column) -> tuple[Column, Column]:
    """Start and stop in seconds of a name like ``123_5s-25s.mp3``."""
    at = r"^(\d+)_(\d+)s-(\d+)s.*mp3$"
    return tuple(F.regexp_extract(file_name(name), at, i).try_cast("int") for i in (2, 3))


def evaluation_name(path: Column) -> dict[str, Column]:
    """base, start, stop, modification and factor of ``<base>_<start>s-<stop>s[___<modification>[_<factor>]].ext``."""
    name = basename(path)
    part = lambda pattern, i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    head = r"^(.+)_(\d+)s-(\d+)s"
    tail = head + r"___(.+?)(?:_(\d+(?:\.\d+)?))?$"
    return {"base": part(head, 1), "start": part(head, 2).try_cast("int"), "stop": part(head, 3).try_cast("int"), "modification": F.coalesce(part(tail, 4), F.lit("reference")), "factor": part(tail, 5).try_cast("double")}


# The shown names of the modifications.
MODIFICATIONS = {
    "reference": "Reference", "pitch_shift": "Pitch shift", "time_stretched": "Time stretch", "speed_up": "Speed up", "flanger": "Flanger",
    "band_passed_2000Hz": "Band-pass 2000 Hz", "chorus": "Chorus", "echo": "Echo", "tremolo": "Tremolo",
}


def modification_label(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in MODIFICATIONS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, code), code)


def window_label(path: Column, start: Column, stop: Column) -> Column:
    """``path-0.0_25.0``."""
    return F.concat(path, F.lit("-"), start.cast("double").cast("string"), F.lit("_"), stop.cast("double").cast("string"))


def complete(words: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``prefix, word``: the only word that begins with a prefix, null if there is none or more than one. Each word of ``words (word)`` is met by equality with all its beginnings, however many words there are."""
    starts = words.select("word", F.explode(F.transform(F.sequence(F.lit(0), F.length("word")), lambda n: F.substring("word", F.lit(1), n))).alias("prefix"))
    only = starts.groupBy("prefix").agg(F.min("word").alias("word"), F.max("word").alias("_last"))
    return prefixes.select("prefix").distinct().join(only, "prefix", "left").select("prefix", F.when(F.col("word") == F.col("_last"), F.col("word")).alias("word"))
