"""What a reader hands on before types are known."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class InputError(ValueError):
    """The input cannot be loaded as it is."""


@dataclass(frozen=True)
class RawTable:
    """An unread input: one frame, its header names and where each cell lies.

    ``cells[i]`` is the value of column ``names[i]``. Text inputs (CSV and
    workbooks) hold strings that still need a type; ``kinds[i]`` tells, for
    workbooks, what the sheet itself says about the cell. ``overflow`` is not
    null on rows with more fields than the header. ``probe`` says that looking
    at the first rows before the whole input is cheap and likely to pay.
    ``stored`` are folders of intermediate rows, needed until the load is done.
    """

    frame: DataFrame
    names: list[str]
    cells: list[Column]
    is_text: bool
    kinds: list[Column] | None = None
    overflow: Column | None = None
    probe: bool = False
    stored: list[str] = field(default_factory=list)


def typed_table(df: DataFrame, probe: bool = False) -> RawTable:
    """A frame that already has types; NaN counts as missing."""
    frame = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    cells = [
        F.when(~F.isnan(field.name), F.col(field.name))
        if field.dataType.typeName() in ("float", "double")
        else F.col(field.name)
        for field in frame.schema.fields
    ]
    return RawTable(frame, list(df.columns), cells, is_text=False, probe=probe)
