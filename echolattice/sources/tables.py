"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet``, a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def trimmed(column: Column | str) -> Column:
    """Without surrounding blanks and tabs."""
    return F.btrim(column if isinstance(column, Column) else F.col(column), F.lit(" \t"))


def millis(column: Column | str) -> Column:
    """Seconds as whole milliseconds."""
    return F.round((column if isinstance(column, Column) else F.col(column)) * 1000).cast("bigint")
