"""Choose the reader by file suffix."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.functions.names import Naming, quoted, reader_names
from lakeload.operators.cleaning import read_types
from lakeload.sources.csv import scan_csv_text
from lakeload.sources.listing import Paths, as_list, source_manifest
from lakeload.sources.parquet import scan_parquet_raw
from lakeload.sources.raw import InputError, RawTable, typed_table
from lakeload.sources.workbook import scan_xlsx_text

SUFFIXES = ("csv", "xlsx", "parquet")

__all__ = ["SUFFIXES", "read_raw", "read_source", "scan_csv", "scan_parquet", "scan_xlsx", "source_manifest"]


def scan_csv(spark: SparkSession, paths: Paths, encoding: str = "UTF-8") -> DataFrame:
    """CSV files with inferred types under their header names."""
    return read_types(scan_csv_text(spark, paths, encoding=encoding))


def scan_xlsx(spark: SparkSession, paths: Paths, sheet: str | int | None = 0) -> DataFrame:
    """One sheet of each workbook with inferred types."""
    return read_types(scan_xlsx_text(spark, paths, sheet))


def scan_parquet(spark: SparkSession, paths: Paths) -> DataFrame:
    """Parquet files with their own types and NaN as null."""
    raw = scan_parquet_raw(spark, paths)
    return raw.frame.select(*[c.alias(n) for c, n in zip(raw.cells, raw.names)])


def _raw_of(
    spark: SparkSession,
    suffix: str,
    paths: Paths,
    sheet: str | int | None,
    by_suffix: bool,
    naming: Naming,
    encoding: str,
) -> RawTable:
    if suffix == "csv":
        return scan_csv_text(spark, paths, by_suffix, naming, encoding)
    if suffix == "xlsx":
        return scan_xlsx_text(spark, paths, sheet, by_suffix, naming)
    raw = scan_parquet_raw(spark, paths, by_suffix)
    return raw if naming is reader_names else replace(raw, names=naming(raw.names))


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return name.rsplit(".", 1)[-1] if "." in name else ""


def _common_type(types: set[str], wide: bool = False) -> str:
    """A type that holds all values of columns to be stacked, without loss.

    ``wide`` says that a whole number among them is beyond 2^53.
    """
    if len(types) == 1:
        return next(iter(types))
    whole = {"tinyint", "smallint", "int", "bigint"}
    if types <= whole:
        return "bigint"
    if types <= {"float", "double"}:
        return "double"
    if types <= whole | {"float", "double"}:
        # of whole numbers a double holds those of up to 2^53 for certain
        return "double" if not wide else "string"
    return "string"


def _beyond_double(frames: list[DataFrame], names: set[str]) -> set[str]:
    """Those of the columns that hold a whole number beyond 2^53; a pass over them where needed."""
    found: set[str] = set()
    for frame in frames if names else []:
        fields = [f.name for f in frame.schema.fields if f.name in names and f.dataType.typeName() == "long"]
        if fields:
            limit = 2**53
            outside = [F.bool_or(~F.col(quoted(n)).between(-limit, limit)).alias(f"w{i}") for i, n in enumerate(fields)]
            found |= {n for n, hit in zip(fields, frame.agg(*outside).first()) if hit}
    return found


def _stack(frames: list[DataFrame]) -> DataFrame:
    """Union by exact name; columns of unlike types become text."""
    types: dict[str, set[str]] = {}
    for frame in frames:
        for field in frame.schema.fields:
            types.setdefault(field.name, set()).add(field.dataType.simpleString())
    mixed = {n for n, found in types.items() if "bigint" in found and found & {"float", "double"}}
    wide = _beyond_double(frames, mixed)
    common = {name: _common_type(found, name in wide) for name, found in types.items()}

    def aligned(frame: DataFrame) -> DataFrame:
        cells: list[Column] = []
        for name, target in common.items():
            cell = F.col(quoted(name)) if name in frame.columns else F.lit(None)
            cells.append(cell.cast(target).alias(name))
        return frame.select(*cells)

    return reduce(DataFrame.unionAll, map(aligned, frames))


def read_raw(
    spark: SparkSession,
    paths: Paths,
    sheet: str | int | None = 0,
    naming: Naming = reader_names,
    encoding: str = "UTF-8",
) -> RawTable:
    """Files of one format, or files and folders that mix formats.

    ``naming`` gives the column names of one header; columns of several files
    are matched by these names. ``encoding`` is that of CSV files.

    A path whose name ends in a known suffix is read by it, any other path is
    taken as a folder or glob whose files are read by their own suffixes.
    """
    listed = as_list(paths)
    by_suffix: dict[str, list[str]] = {}
    for path in listed:
        by_suffix.setdefault(_suffix(path), []).append(path)
    if by_suffix.keys() <= set(SUFFIXES):
        raws = [
            _raw_of(spark, s, by_suffix[s], sheet, False, naming, encoding)
            for s in SUFFIXES
            if s in by_suffix
        ]
    else:
        found = {
            row.file_format
            for row in source_manifest(spark, listed).select("file_format").distinct().collect()
        }
        if not found or found - set(SUFFIXES):
            raise InputError(f"cannot read {sorted(found)}; known are {', '.join(SUFFIXES)}")
        raws = [_raw_of(spark, s, listed, sheet, True, naming, encoding) for s in SUFFIXES if s in found]
    if len(raws) == 1:
        return raws[0]
    stacked = typed_table(
        _stack([read_types(raw) if raw.is_text else _named(raw) for raw in raws])
    )
    return replace(stacked, stored=[folder for raw in raws for folder in raw.stored])


def _named(raw: RawTable) -> DataFrame:
    return raw.frame.select(*[c.alias(n) for c, n in zip(raw.cells, raw.names)])


def read_source(spark: SparkSession, paths: Paths, sheet: str | int | None = 0) -> DataFrame:
    """The input with types and header names, before cleaning."""
    raw = read_raw(spark, paths, sheet)
    return read_types(raw) if raw.is_text else _named(raw)
