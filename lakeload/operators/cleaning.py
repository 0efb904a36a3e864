"""Cleaning: column names, cell text, null markers, empty columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeload.functions.names import column_names, quoted
from lakeload.functions.text import clean_text, markers_to_null, trim_text
from lakeload.operators.inference import Profile, is_empty, profile, spark_type, typed_cell
from lakeload.sources.raw import InputError, RawTable, typed_table


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename every column; a projection only."""
    return df.toDF(*column_names(df.columns))


def _on_strings(df: DataFrame, change) -> DataFrame:
    return df.select(
        *[
            change(F.col(quoted(field.name))).alias(field.name)
            if field.dataType.typeName() == "string"
            else F.col(quoted(field.name))
            for field in df.schema.fields
        ]
    )


def trim_strings(df: DataFrame) -> DataFrame:
    """Take blanks of any kind off both ends of every string cell."""
    return _on_strings(df, trim_text)


def null_markers(df: DataFrame) -> DataFrame:
    """Null for string cells that are a marker as a whole."""
    return _on_strings(df, markers_to_null)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Keep the columns with at least one value; one aggregate over the input."""
    raw = typed_table(df)
    counts = raw.frame.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(raw.cells)]).first()
    kept = [c.alias(n) for c, n, count in zip(raw.cells, raw.names, counts) if count]
    return raw.frame.select(*kept)


@dataclass(frozen=True)
class CleanTable:
    """A cleaned input with the counts its profile already knows."""

    frame: DataFrame
    n_rows: int
    n_columns: int
    stored: list[str] = field(default_factory=list)


def read_types(raw: RawTable, found: Profile | None = None) -> DataFrame:
    """The input with inferred types, uncleaned, under its own header names."""
    found = found or profile(raw)
    return raw.frame.select(
        *[typed_cell(raw, i, bits).alias(raw.names[i]) for i, bits in enumerate(found.bits)]
    )


def _exact_doubles(raw: RawTable, cells: dict[str, Column]) -> None:
    """Refuse whole numbers that a double cannot hold; a pass over these columns only."""
    if not cells:
        return
    limit = 2**53
    outside = [F.bool_or(~cell.between(-limit, limit)).alias(f"w{i}") for i, cell in enumerate(cells.values())]
    wide = [name for name, hit in zip(cells, raw.frame.agg(*outside).first()) if hit]
    if wide:
        raise InputError(f"whole numbers beyond 2^53 for double columns: {', '.join(wide)}")


def clean_raw(
    raw: RawTable, missing_text: str | None = None, target: dict[str, str] | None = None
) -> CleanTable:
    """Types, names, text and empty columns of an input in one profile pass.

    Types are inferred before markers become null, and suffixes of repeated
    names are given before empty columns go. ``missing_text`` stands for
    missing cells of text columns (``nan`` gives what pandas would store).

    ``target`` gives types by lower-case name that a table has already. Whole
    numbers go into its decimal columns if they fit exactly, and cells of text
    inputs go into its text columns as they are written, so that a feed does
    not depend on the values of each file. Other types stay as inferred.
    """
    found = profile(raw, keep_missing=missing_text is not None and raw.is_text)
    if not found.n_rows:
        raise InputError("the input has no data rows")
    types = {field.name: field.dataType.typeName() for field in raw.frame.schema.fields}
    frame_columns = raw.frame.columns
    kept: list[Column] = []
    doubles: dict[str, Column] = {}
    for i, (name, bits) in enumerate(zip(column_names(raw.names), found.bits)):
        if is_empty(bits, keep_missing=missing_text is not None):
            continue
        cell = typed_cell(raw, i, bits, missing_text)
        found_type = spark_type(bits) if raw.is_text else types[frame_columns[i]]
        is_string = found_type == "string"
        wanted = (target or {}).get(name.lower())
        if wanted == "string" and raw.is_text and not is_string:
            cell, is_string = raw.cells[i], True
            if missing_text is not None:
                cell = F.coalesce(cell, F.lit(missing_text))
        elif wanted == "double" and found_type in ("bigint", "long"):
            doubles[name] = cell
            cell = cell.cast("double")
        kept.append((clean_text(cell) if is_string else cell).alias(name))
    if not kept:
        raise InputError("no column of the input holds a value")
    _exact_doubles(raw, doubles)
    return CleanTable(raw.frame.select(*kept), found.n_rows, len(kept), raw.stored)


def clean(df: DataFrame) -> DataFrame:
    """Normalise names, trim text, apply null markers, drop empty columns."""
    return clean_raw(typed_table(df)).frame


def preview(df: DataFrame, n_rows: int = 100) -> DataFrame:
    """The first rows of a cleaned frame."""
    return df.limit(n_rows)


def load_metrics(cleaned: CleanTable, spark) -> DataFrame:
    """Row and column count of a cleaned input, as one row."""
    return spark.range(1).select(
        F.lit(cleaned.n_rows).cast("bigint").alias("n_rows"),
        F.lit(cleaned.n_columns).cast("int").alias("n_columns"),
    )
