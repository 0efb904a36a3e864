"""Whole-input type inference and emptiness in one aggregate.

Every cell is mapped to a bit that says what it looks like; a column's type
follows from the OR of its cells, which also tells whether it is empty. Rows
are turned into (position, cell) pairs within their task, so that the plan is
equally small for ten and for ten thousand columns; the pairs are merged by
position before the shuffle, to one row per task and column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeload.functions.text import NULL_MARKERS, clean_text, trim_text
from lakeload.sources.raw import InputError, RawTable

# What a cell looks like.
INTEGER, DECIMAL, BOOLEAN, MARKER, TEXT = 1, 2, 4, 8, 16
WIDE_INTEGER, SHEET_DATE, SHEET_BOOLEAN, TYPED, MISSING, SHEET_DURATION = 32, 64, 128, 256, 512, 1024

# What a workbook says about a cell (see sources.workbook).
KIND_TEXT, KIND_NUMBER, KIND_BOOLEAN, KIND_DATE, KIND_DURATION = 0, 1, 2, 3, 4

# Spellings the reader accepts as booleans (in any case) and as numbers.
BOOLEAN_WORDS = ("true", "false")
NUMBER = (
    r"^(?:\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*"
    r"|[+-]?(?:[iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY]))\z"
)

# Rows that the probe looks at, and its limit for very wide inputs.
HEAD_ROWS = 1000
HEAD_CELLS = 200_000


def _number_bit(cell: Column) -> Column:
    """The bit of a cell that is spelled as a number.

    Integers beyond 64 bits are WIDE_INTEGER; a number too large for a double
    is TEXT. Short cells need no look at their value.
    """
    has_exponent = cell.contains("e") | cell.contains("E")
    is_infinity = cell.contains("n") | cell.contains("N")
    too_large = F.abs(cell.cast("double")) == F.lit(float("inf"))
    limit = F.lit(2**63 - 1).cast("decimal(38,0)")
    fits = cell.try_cast("decimal(38,0)").between(-limit - 1, limit)
    return (
        F.when(
            has_exponent | ((F.length(cell) > 300) & cell.contains(".")),
            F.when(too_large & ~is_infinity, TEXT).otherwise(DECIMAL),
        )
        .when(cell.contains(".") | is_infinity, DECIMAL)
        .when((F.length(cell) <= 18) | fits, INTEGER)
        .otherwise(WIDE_INTEGER)
    )


def text_bit(cell: Column) -> Column:
    return (
        F.when(cell.isNull(), F.lit(None).cast("int"))
        .when(cell.rlike(NUMBER), _number_bit(cell))
        .when(F.lower(cell).isin(*BOOLEAN_WORDS), BOOLEAN)
        .when(trim_text(cell).isin(*NULL_MARKERS), MARKER)
        .otherwise(TEXT)
    )


def sheet_bit(cell: Column, kind: Column) -> Column:
    return (
        F.when(cell.isNull(), F.lit(None).cast("int"))
        .when(kind == KIND_DATE, SHEET_DATE)
        .when(kind == KIND_BOOLEAN, SHEET_BOOLEAN)
        .when(kind == KIND_DURATION, SHEET_DURATION)
        .otherwise(text_bit(cell))
    )


def spark_type(bits: int) -> str:
    """The type of a text column whose cells have these bits."""
    bits &= ~MISSING
    if not bits:
        return "double"
    if bits in (BOOLEAN, SHEET_BOOLEAN, BOOLEAN | SHEET_BOOLEAN):
        return "boolean"
    if bits == SHEET_DATE:
        return "timestamp"
    if bits == SHEET_DURATION:
        return "interval day to second"
    numbers = bits & ~SHEET_BOOLEAN
    if numbers == INTEGER:
        return "bigint"
    if numbers & DECIMAL and not numbers & ~(INTEGER | DECIMAL | WIDE_INTEGER):
        return "double"
    return "string"


def is_empty(bits: int, keep_missing: bool) -> bool:
    """No cell is left after cleaning.

    When missing cells become text, a column of markers and missing cells
    keeps that text; a column of nothing but missing cells never does.
    """
    if keep_missing and bits == MARKER | MISSING:
        return False
    return bits & ~MISSING in (0, MARKER)


def is_settled(bits: int) -> bool:
    """No further cell can change the type or empty the column."""
    seen = bits & ~MISSING
    if seen & (TEXT | TYPED):
        return True
    booleans = BOOLEAN | SHEET_BOOLEAN
    return any(seen & bit and seen & ~others for bit, others in ((BOOLEAN, booleans), (MARKER, MARKER), (SHEET_DATE, SHEET_DATE),
                                                               (SHEET_DURATION, SHEET_DURATION)))


@dataclass(frozen=True)
class Profile:
    n_rows: int
    bits: list[int]


def _elements(raw: RawTable) -> list[Column]:
    """What has to be known of each cell to find its bit."""
    if raw.kinds is not None:
        return [F.struct(c.alias("cell"), k.alias("kind")) for c, k in zip(raw.cells, raw.kinds)]
    if raw.is_text:
        return raw.cells
    types = [field.dataType.typeName() for field in raw.frame.schema.fields]
    return [
        (clean_text(c) if kind == "string" else c).isNotNull() for c, kind in zip(raw.cells, types)
    ]


def _bit(raw: RawTable, element: Column, keep_missing: bool) -> Column:
    """The bit of an element; columns with a type only need to know if they are empty."""
    if raw.kinds is not None:
        bit = sheet_bit(element["cell"], element["kind"])
    elif raw.is_text:
        bit = text_bit(element)
    else:
        bit = F.when(element, TYPED)
    return F.coalesce(bit, F.lit(MISSING)) if keep_missing and raw.is_text else bit


def _first_rows(raw: RawTable, elements: Sequence[Column], keep_missing: bool) -> list[int]:
    """Bits of the first rows: the job stops at the first partitions it needs."""
    n_rows = min(HEAD_ROWS, HEAD_CELLS // max(1, len(elements)) + 1)
    bits = F.transform(F.array(*elements), lambda element: _bit(raw, element, keep_missing))
    found = [0] * len(elements)
    for row in raw.frame.select(bits.alias("bits")).head(n_rows):
        found = [known | (bit or 0) for known, bit in zip(found, row.bits)]
    return found


def bit_table(raw: RawTable, elements: Sequence[Column], keep_missing: bool = False) -> DataFrame:
    """Bits by position of the element; a last position counts the rows.

    That last element is not null on rows with too many fields.
    """
    last = F.lit(None) if raw.overflow is None else raw.overflow
    if raw.kinds is not None:
        last = F.struct(last.cast("string").alias("cell"), F.lit(None).cast("int").alias("kind"))
    elif not raw.is_text:
        last = last.cast("boolean")
    pairs = raw.frame.select(F.posexplode(F.array(*elements, last)))
    return pairs.groupBy("pos").agg(
        F.bit_or(_bit(raw, F.col("col"), keep_missing)).alias("bits"),
        F.count("col").alias("filled"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def profile(raw: RawTable, keep_missing: bool = False, probe: bool | None = None) -> Profile:
    """Row count, type bits and emptiness of the whole input.

    A probed input has its first rows looked at before. A column whose type
    and presence no later row can change is then left out of the full pass, so
    the scan does not even materialise it. The answer is the same either way.
    """
    elements = _elements(raw)
    probe = raw.probe if probe is None else probe
    bits = _first_rows(raw, elements, keep_missing) if probe else [0] * len(elements)
    pending = [i for i, known in enumerate(bits) if not is_settled(known)]
    table = bit_table(raw, [elements[i] for i in pending], keep_missing)
    found = {row.pos: row for row in table.collect()}
    if not found:
        return Profile(0, bits)
    total = found[len(pending)]
    if raw.overflow is not None and total.filled:
        raise InputError(
            f"{total.filled} row(s) have more fields than the {len(raw.names)} of the header"
        )
    for pos, i in enumerate(pending):
        bits[i] |= found[pos].bits or 0
    return Profile(total.n_rows, bits)


def typed_cell(raw: RawTable, position: int, bits: int, missing_text: str | None = None) -> Column:
    """The cell cast to the inferred type; text is left untrimmed."""
    cell = raw.cells[position]
    if not raw.is_text:
        return cell
    target = spark_type(bits)
    if target == "string":
        return cell if missing_text is None else F.coalesce(cell, F.lit(missing_text))
    if bits & SHEET_BOOLEAN and target in ("bigint", "double"):
        cell = F.when(cell == "True", "1").when(cell == "False", "0").otherwise(cell)
    return cell.cast(target)
