"""Land tables as the files people send: inputs for the registered queries.

Everything is written by Spark tasks below the shared folder.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.session import shared_folder

# The parts of a minimal workbook.
_TYPES = (
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType='
    '"application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/></Types>'
)
_MAIN_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG_NS = "http://schemas.openxmlformats.org/package/2006/relationships"


def land_csv(df: DataFrame, label: str, folder: str | None = None, name: str = "data.csv") -> str:
    """The frame as CSV files, cell text unchanged, in a folder ``name``."""
    path = f"{folder or shared_folder(df.sparkSession, label)}/{name}"
    df.write.options(
        header="true",
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace="false",
        ignoreTrailingWhiteSpace="false",
    ).csv(path)
    return path


def land_parquet(
    df: DataFrame, label: str, folder: str | None = None, name: str = "data.parquet"
) -> str:
    path = f"{folder or shared_folder(df.sparkSession, label)}/{name}"
    df.write.parquet(path)
    return path


_STYLES = (
    f'<styleSheet xmlns="{_MAIN_NS}"><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="46"/></cellXfs></styleSheet>'
)
_DAY_ZERO = dt.datetime(1899, 12, 30)


def _cell_xml(value: object) -> str:
    if value is None or value != value:
        return "<c/>"
    if isinstance(value, dt.datetime):
        return f'<c s="1"><v>{(value - _DAY_ZERO) / dt.timedelta(days=1)!r}</v></c>'
    if isinstance(value, dt.timedelta):
        return f'<c s="2"><v>{value / dt.timedelta(days=1)!r}</v></c>'
    if isinstance(value, str):
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
    return f"<c><v>{value!r}</v></c>"


def _sheet_xml(rows: Iterable[Iterable[object]]) -> str:
    body = "".join(f"<row>{''.join(_cell_xml(v) for v in row)}</row>" for row in rows)
    return f'<worksheet xmlns="{_MAIN_NS}"><sheetData>{body}</sheetData></worksheet>'


def workbook_bytes(sheets: dict[str, Iterable[Iterable[object]]]) -> bytes:
    """A workbook of plain sheets, each given as rows of cells."""
    numbered = list(enumerate(sheets.items(), 1))
    listed = "".join(
        f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"/>' for i, (name, _) in numbered
    )
    links = "".join(
        f'<Relationship Id="rId{i}" Type="{_REL_NS}/worksheet" Target="worksheets/sheet{i}.xml"/>'
        for i, _ in numbered
    )
    target = io.BytesIO()
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", _TYPES)
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{_MAIN_NS}" xmlns:r="{_REL_NS}"><sheets>{listed}</sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PKG_NS}">{links}</Relationships>'
        )
        book.writestr("xl/styles.xml", _STYLES)
        for i, (_, rows) in numbered:
            book.writestr(f"xl/worksheets/sheet{i}.xml", _sheet_xml(rows))
    return target.getvalue()


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, found once on the driver as Spark's readers find it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = path.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()
    # Hadoop writes file:/x, Arrow reads file:///x
    return re.sub(r"^file:/+", "file:///", uri)


def land_workbooks(
    df: DataFrame,
    key: str,
    label: str,
    folder: str | None = None,
    rows_per_book: int = 5000,
    sheet: str = "Dados",
    first_sheet: str | None = None,
) -> str:
    """The frame as workbooks ``book-<n>.xlsx`` of ``rows_per_book`` key values.

    With ``first_sheet`` the data lies behind another sheet of that name.
    """
    folder = folder or shared_folder(df.sparkSession, label)
    uri = _qualified(df.sparkSession, folder)

    def write_book(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["book"].iloc[0])
        data = group.drop(columns="book").sort_values(key)
        rows = [list(data.columns), *data.astype(object).itertuples(index=False)]
        sheets = {sheet: rows}
        if first_sheet is not None:
            sheets = {first_sheet: [["note"], ["see the other sheet"]], **sheets}
        system, path = pafs.FileSystem.from_uri(uri)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/book-{number}.xlsx") as stream:
            stream.write(workbook_bytes(sheets))
        return pd.DataFrame({"book": [number]})

    books = df.withColumn("book", F.expr(f"{key} div {rows_per_book}"))
    books.groupBy("book").applyInPandas(write_book, "book bigint").agg(F.count("book")).first()
    return folder
