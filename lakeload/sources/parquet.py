"""Parquet files with their own types; NaN becomes null."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lakeload.sources.listing import Paths, as_list, suffix_filter
from lakeload.sources.raw import RawTable, typed_table


def scan_parquet_raw(spark: SparkSession, paths: Paths, by_suffix: bool = False) -> RawTable:
    """All Parquet files below ``paths``; columns are merged over the files."""
    reader = spark.read.options(recursiveFileLookup="true", mergeSchema="true")
    if by_suffix:
        reader = reader.option("pathGlobFilter", suffix_filter("parquet"))
    return typed_table(reader.parquet(*as_list(paths)), probe=True)
