"""Command line: ``python -m echolattice.cli COMMAND [files] [name=value ...]``. A unique prefix of a command is enough; without one the settings are shown. ``stats N`` shows them every N seconds (``polls=K``: K times)."""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echolattice import __version__
from echolattice.config import EngineConfig
from echolattice.engine import Engine
from echolattice.sources.cachefiles import HEADER, result_lines

COMMANDS = ("clear", "configuration", "deduplicate", "delete", "load", "metadata", "monitor", "print", "query", "resolve", "same", "stats", "store")


def command(word: str) -> str:
    """The only command that begins with ``word``; commands that equal it win."""
    hits = [c for c in COMMANDS if c == word.lower()] or [c for c in COMMANDS if c.startswith(word.lower())]
    if len(hits) != 1:
        raise SystemExit(f"{'ambiguous' if hits else 'unknown'} command {word}; known: {' '.join(COMMANDS)}")
    return hits[0]


def split(argv: list[str]) -> tuple[str, list[str], dict[str, str]]:
    """Command, its arguments, and the ``name=value`` settings among them."""
    settings = dict(a.split("=", 1) for a in argv if "=" in a and not os.path.exists(a))
    words = [a for a in argv if not ("=" in a and not os.path.exists(a))]
    return command(words[0]) if words else "configuration", words[1:], settings


def show(df: DataFrame) -> None:
    """Print rows as they come, a partition at a time."""
    for row in df.toLocalIterator():
        print(" ; ".join("null" if v is None else str(v) for v in row))


def printable(found: DataFrame) -> DataFrame:
    """Result lines in the order of the queries and their ranks, each with the number of its query and how many there are. Queries are numbered by path: one row each, in one task."""
    w = W.orderBy("query_path")
    numbered = found.select("query_path").distinct().select("query_path", F.row_number().over(w).alias("query_index"), F.count(F.lit(1)).over(W.partitionBy(F.lit(0))).alias("total_queries"))
    x = found.join(numbered, "query_path").orderBy("query_index", "rank")
    return result_lines(x.select("query_index", "total_queries", "query_path", "query_start", "query_stop", "ref_path", "ref_id", "ref_start", "ref_stop", F.col("score").alias("match_score"), "time_factor", F.col("freq_factor").alias("frequency_factor"), "coverage"))


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    flags = {a.lower() for a in argv if a.startswith("-")}
    if flags & {"-h", "--help"}:
        print(f"{__doc__}\nCommands: {' '.join(COMMANDS)}")
        return 0
    if flags & {"-v", "--version"}:
        print(__version__)
        return 0
    name, args, settings = split([a for a in argv if a.lower() not in ("-h", "--help", "-v", "--version")])
    where = settings.pop("index", os.path.expanduser("~/.echolattice"))
    file = settings.pop("settings", "")
    text = open(file, encoding="utf-8").read() if file else ""
    config = EngineConfig.load(text, **{k: v for k, v in settings.items() if k != "polls"})
    if name == "configuration":
        for k, v in config.dump():
            print(f"{k} = {v}")
        return 0
    engine = Engine(spark or SparkSession.builder.appName("echolattice").getOrCreate(), where, config)
    paths = [a for a in args if not a.startswith("-")]
    if name in ("query", "monitor"):
        print(HEADER)
        show(printable(getattr(engine, name)(paths)))
    elif name == "same":
        show(engine.same(*paths[:2]))
    elif name == "print":
        show(engine.print(paths, "-ep" in flags, "-sv" in flags))
    elif name == "deduplicate":
        show(engine.deduplicate(paths, "-content" in flags))
    elif name == "stats":
        every, times = (float(args[0]) if args else 0.0), int(settings.pop("polls", 0))
        show(engine.stats())
        while args and (times := times - 1) != 0:
            time.sleep(every)
            show(engine.stats())
    elif name == "load":
        engine.load(*paths[:2])
    elif name in ("clear", "delete"):
        engine.clear() if name == "clear" else engine.delete(paths)
    else:
        show(getattr(engine, name)(paths))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
