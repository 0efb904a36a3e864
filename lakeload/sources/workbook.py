"""Excel workbooks (.xlsx): one task reads a workbook, Spark does the rest.

The file format bounds a sheet at 1,048,576 rows, so a workbook is a bounded
unit of work. Its rows leave the worker as text cells plus the kind the sheet
states for each; they are stored once in the shared folder, since every later
pass (header, types, load) would otherwise unpack the workbook again.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.functions.names import Naming, reader_names
from lakeload.functions.text import missing_to_null
from lakeload.operators.inference import KIND_BOOLEAN, KIND_DATE, KIND_DURATION, KIND_NUMBER, KIND_TEXT
from lakeload.session import shared_folder
from lakeload.sources.listing import Paths, as_list, suffix_filter
from lakeload.sources.raw import InputError, RawTable

# Built-in number formats that show a date or a time, and an elapsed time.
DATE_FORMAT_IDS = frozenset(range(14, 23)) | {45, 47}
ELAPSED_FORMAT_IDS = frozenset({46})

ROWS_SCHEMA = "file string, header_id string, row_no bigint, cells array<string>, kinds array<int>"
ROWS_PER_BATCH = 2000

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ROW, _CELL, _SHEET_DATA = f"{_MAIN}row", f"{_MAIN}c", f"{_MAIN}sheetData"
_VALUE, _INLINE = f"{_MAIN}v", f"{_MAIN}is"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Parts of a format code: text, brackets, escaped, padding and filling characters, section ends, others.
_FORMAT_PART = re.compile(r'"[^"]*"?|\[[^\]]*\]?|\\.|_.|\*.|;|.', re.DOTALL)
_ELAPSED_PART = re.compile(r"\[(?:h+|m+|s+)\]", re.IGNORECASE)
_WHOLE = re.compile(r"-?\d+").fullmatch
_DATE_LETTERS = frozenset("dmyhsDMYHS")

Cell = tuple[str, int]


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    strings = []
    with book.open("xl/sharedStrings.xml") as stream:
        for _, node in ET.iterparse(stream):
            if node.tag == _MAIN + "si":
                strings.append(_rich_text(node))
                node.clear()
    return strings


def _rich_text(node: ET.Element) -> str:
    """Text of a plain or rich string, without phonetic guides."""
    parts = [t.text or "" for t in node.findall(f"{_MAIN}t")]
    parts += [t.text or "" for t in node.findall(f"{_MAIN}r/{_MAIN}t")]
    return "".join(parts)


def format_kind(code: str) -> int:
    """What numbers are under a format code, by its first section: dates, elapsed times, or numbers.

    Elapsed times have hours, minutes or seconds in brackets, which then count on
    beyond a day, an hour or a minute. Other brackets are colours, conditions and
    locales; text and escaped characters mean nothing.
    """
    kind = KIND_NUMBER
    for part in _FORMAT_PART.findall(code):
        if part == ";":
            break
        if _ELAPSED_PART.fullmatch(part):
            return KIND_DURATION
        if part in _DATE_LETTERS:
            kind = KIND_DATE
    return kind


def _time_styles(book: zipfile.ZipFile) -> dict[int, int]:
    """The kind of numbers under the cell styles that show dates or elapsed times, by position."""
    if "xl/styles.xml" not in book.namelist():
        return {}
    root = ET.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(node.get("numFmtId")): node.get("formatCode", "")
        for node in root.iterfind(f"{_MAIN}numFmts/{_MAIN}numFmt")
    }
    styles = {}
    for position, style in enumerate(root.iterfind(f"{_MAIN}cellXfs/{_MAIN}xf")):
        number = int(style.get("numFmtId", 0))
        if number in custom:
            kind = format_kind(custom[number])
        elif number in ELAPSED_FORMAT_IDS:
            kind = KIND_DURATION
        else:
            kind = KIND_DATE if number in DATE_FORMAT_IDS else KIND_NUMBER
        if kind != KIND_NUMBER:
            styles[position] = kind
    return styles


def _sheet_part(book: zipfile.ZipFile, sheet: str | int) -> tuple[str, bool]:
    """Archive name of a sheet (by name or 0-based position) and the 1904 flag."""
    root = ET.fromstring(book.read("xl/workbook.xml"))
    settings = root.find(f"{_MAIN}workbookPr")
    from_1904 = settings is not None and settings.get("date1904") in ("1", "true")
    sheets = root.findall(f"{_MAIN}sheets/{_MAIN}sheet")
    if isinstance(sheet, int):
        chosen = sheets[sheet] if sheet < len(sheets) else None
    else:
        chosen = next((s for s in sheets if s.get("name") == sheet), None)
    if chosen is None:
        raise InputError(f"worksheet {sheet!r} not found")
    links = ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in links if r.get("Id") == chosen.get(_REL + "id"))
    return (target[1:] if target.startswith("/") else f"xl/{target}"), from_1904


def _date_text(serial: float, from_1904: bool) -> Cell:
    """A date serial as timestamp text; a serial below one is a time of day."""
    days, share = divmod(serial, 1)
    span = dt.timedelta(days=days, milliseconds=round(share * 86_400_000))
    if not from_1904:
        if 0 <= serial < 1:
            return str((dt.datetime.min + span).time()), KIND_TEXT
        # Day 60 of the 1900 system does not exist: count from one day later before it.
        epoch = dt.datetime(1899, 12, 31 if serial < 60 else 30)
    else:
        epoch = dt.datetime(1904, 1, 1)
    return str(epoch + span), KIND_DATE


def _duration_text(serial: float) -> Cell:
    """Days as the text of a day-time interval, to the millisecond as dates are."""
    millis = round(abs(serial) * 86_400_000)
    seconds, millis = divmod(millis, 1000)
    minutes, seconds = divmod(seconds, 60)
    hours, minutes = divmod(minutes, 60)
    days, hours = divmod(hours, 24)
    sign = "-" if serial < 0 else ""
    return f"{sign}{days} {hours:02}:{minutes:02}:{seconds:02}" + (f".{millis:03}" if millis else ""), KIND_DURATION


def _number(text: str) -> Cell:
    value = float(text)
    if value.is_integer():
        # Long integers keep their digits, which a float would round.
        return (str(int(text)) if _WHOLE(text) else str(int(value))), KIND_NUMBER
    return repr(value), KIND_NUMBER


def _cell(node: ET.Element, strings: list[str], times: dict[int, int], from_1904: bool) -> Cell | None:
    kind = node.get("t", "n")
    if kind == "inlineStr":
        inline = node.find(_INLINE)
        return None if inline is None else (_rich_text(inline), KIND_TEXT)
    text = node.findtext(_VALUE)
    if text is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(text)], KIND_TEXT
    if kind == "b":
        return str(text == "1"), KIND_BOOLEAN
    if kind == "d":
        return str(dt.datetime.fromisoformat(text.removesuffix("Z"))), KIND_DATE
    if kind == "n":
        shown = times.get(int(node.get("s", 0)))
        if shown == KIND_DURATION:
            return _duration_text(float(text))
        return _date_text(float(text), from_1904) if shown == KIND_DATE else _number(text)
    return text, KIND_TEXT


def _position(reference: str | None, default: int) -> int:
    """0-based column of a reference such as ``AB12``."""
    if reference is None:
        return default
    column = 0
    for char in reference:
        if not char.isalpha():
            break
        column = column * 26 + ord(char.upper()) - 64
    return column - 1


def sheet_rows(content: bytes, sheet: str | int) -> Iterator[tuple[int, list[Cell | None]]]:
    """Numbered rows of one sheet up to its last row with a value.

    Trailing blank cells are cut off. Blank rows in between are given as empty
    rows, also those that the file leaves out.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        part, from_1904 = _sheet_part(book, sheet)
        strings, times = _shared_strings(book), _time_styles(book)
        given = number = 0
        with book.open(part) as stream:
            for event, node in ET.iterparse(stream, events=("start", "end")):
                tag = node.tag
                if tag != _ROW or event == "start":
                    if tag == _SHEET_DATA and event == "start":
                        data = node
                    continue
                number = int(node.get("r", number + 1))
                cells: list[Cell | None] = []
                for cell in node:
                    if cell.tag != _CELL:
                        continue
                    place = _position(cell.get("r"), len(cells))
                    if place != len(cells):
                        cells.extend([None] * (place - len(cells)))
                    cells.append(_cell(cell, strings, times, from_1904))
                data.clear()
                while cells and (cells[-1] is None or cells[-1][0] == ""):
                    cells.pop()
                if cells:
                    yield from ((blank, []) for blank in range(given + 1, number))
                    yield number, cells
                    given = number


def workbook_rows(books: DataFrame, sheet: str | int = 0) -> DataFrame:
    """Rows of workbooks given as ``path``, ``content``.

    ``header_id`` is the same for all rows below equal headers.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("file", pa.string()),
                ("header_id", pa.string()),
                ("row_no", pa.int64()),
                ("cells", pa.list_(pa.string())),
                ("kinds", pa.list_(pa.int32())),
            ]
        )

        def batch_of(file: str, header_id: str, numbers: list, cells: list, kinds: list) -> pa.RecordBatch:
            n = len(numbers)
            columns = zip(([file] * n, [header_id] * n, numbers, cells, kinds), schema.types, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in columns], schema=schema)

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                file, header_id, numbers, texts, kinds = path.as_py(), None, [], [], []
                for number, row in sheet_rows(content.as_py(), sheet):
                    cells = [cell and cell[0] for cell in row]
                    header_id = header_id or hashlib.md5(repr(cells).encode()).hexdigest()
                    numbers.append(number)
                    texts.append(cells)
                    kinds.append([cell[1] if cell else KIND_TEXT for cell in row])
                    if len(numbers) == ROWS_PER_BATCH:
                        yield batch_of(file, header_id, numbers, texts, kinds)
                        numbers, texts, kinds = [], [], []
                if numbers:
                    yield batch_of(file, header_id, numbers, texts, kinds)

    return books.select("path", "content").mapInArrow(unpack, ROWS_SCHEMA)


def scan_xlsx_text(
    spark: SparkSession,
    paths: Paths,
    sheet: str | int | None = 0,
    by_suffix: bool = False,
    naming: Naming = reader_names,
) -> RawTable:
    """One sheet of every workbook below ``paths`` as text columns with kinds.

    ``sheet`` is a name or a 0-based position; none or an empty name is the
    first. The first row is the header; columns are matched by ``naming``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if by_suffix:
        reader = reader.option("pathGlobFilter", suffix_filter("xlsx"))
    folder = shared_folder(spark, "sheet-rows")
    workbook_rows(reader.load(as_list(paths)), sheet or 0).write.parquet(folder)
    rows = spark.read.parquet(folder)

    # One row per distinct header, however many workbooks there are.
    widths = rows.groupBy("header_id").agg(F.max(F.size("cells")).alias("width"))
    heads = rows.where("row_no = 1").select("header_id", "cells").distinct()
    headers = {
        row.header_id: naming(row.cells + [None] * (row.width - len(row.cells)))
        for row in heads.join(widths, "header_id").orderBy("header_id").collect()
    }
    if not headers:
        raise InputError(f"no cells in {', '.join(as_list(paths))}")
    names = list(dict.fromkeys(name for header in headers.values() for name in header))

    def at(column: str, name: str) -> Column:
        """The entry of ``column`` that lies under ``name`` in the row's own sheet."""
        places: dict[int, list[str]] = {}
        for header_id, header in headers.items():
            if name in header:
                places.setdefault(header.index(name), []).append(header_id)
        if len(places) == 1 and len(next(iter(places.values()))) == len(headers):
            return F.get(column, F.lit(next(iter(places))))
        found = F.lit(None)
        for place, header_ids in places.items():
            found = F.when(F.col("header_id").isin(header_ids), F.get(column, F.lit(place))).otherwise(found)
        return found

    frame = rows.where("row_no > 1").select(
        *[at("cells", name).alias(f"c{i}") for i, name in enumerate(names)],
        *[at("kinds", name).alias(f"k{i}") for i, name in enumerate(names)],
    )
    frame = frame.select(
        *[missing_to_null(f"c{i}").alias(f"c{i}") for i in range(len(names))],
        *[f"k{i}" for i in range(len(names))],
    )
    return RawTable(
        frame=frame,
        names=names,
        cells=[F.col(f"c{i}") for i in range(len(names))],
        is_text=True,
        kinds=[F.col(f"k{i}") for i in range(len(names))],
        stored=[folder],
    )
