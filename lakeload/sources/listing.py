"""Source files as rows, and paths that mean exactly one file."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Paths = str | Sequence[str]

_GLOB_CHARACTERS = re.compile(r"([\\*?\[\]{}])")


def as_list(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def escape_glob(path: str) -> str:
    """The path of one file, whatever characters its name holds."""
    return _GLOB_CHARACTERS.sub(r"\\\1", path)


def plain_path(path: str) -> str:
    """The path as people write it, without the escapes of ``escape_glob``."""
    return re.sub(r"\\([\\*?\[\]{}])", r"\1", path)


def literal_path(file_path: str) -> str:
    """A path for a reader from the URI in ``_metadata.file_path``."""
    return escape_glob(unquote(file_path))


def suffix_filter(suffix: str) -> str:
    """A file-name glob for one suffix in any letter case."""
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def suffix_of(path: Column) -> Column:
    return F.lower(F.substring_index(F.substring_index(path, "/", -1), ".", -1))


def source_manifest(spark: SparkSession, paths: Paths) -> DataFrame:
    """One row per source file; file contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(as_list(paths))
    )
    return files.select(
        "path",
        F.substring_index("path", "/", -1).alias("file_name"),
        suffix_of(F.col("path")).alias("file_format"),
        "length",
        F.col("modificationTime").alias("modified_at"),
    )
