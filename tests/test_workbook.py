"""Excel reading from hand-made workbooks."""

import datetime as dt
import io
import subprocess
import sys
import zipfile
from pathlib import Path

import pandas as pd
import pytest

from lakeload.plans.ingest import prepare
from lakeload.plans.landing import workbook_bytes
from lakeload.sources.dispatch import scan_xlsx
from lakeload.sources.raw import InputError
from lakeload.operators import inference
from lakeload.operators.tables import save_table
from lakeload.sources.workbook import format_kind, scan_xlsx_text

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _book(tmp_path, sheets, name="b.xlsx", strings=(), date1904=False, target="worksheets/"):
    """``sheets`` maps names to the XML of their rows. Style 1 is a date, 2 a custom date, 3 is 0.00, 4 is elapsed."""
    path = tmp_path / name
    numbered = list(enumerate(sheets.items(), 1))
    listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in numbered)
    links = "".join(
        f'<Relationship Id="r{i}" Type="w" Target="{target}sheet{i}.xml"/>' for i, _ in numbered
    )
    with zipfile.ZipFile(path, "w") as book:
        flag = ' date1904="1"' if date1904 else ""
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><workbookPr{flag}/><sheets>{listed}</sheets></workbook>',
        )
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        book.writestr(
            "xl/styles.xml",
            f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="164" formatCode="[$-416]dd\\/mm\\/yyyy;@"/>'
            '<numFmt numFmtId="165" formatCode="&quot;days&quot; 0.00"/><numFmt numFmtId="166" formatCode="[h]:mm;@"/></numFmts><cellXfs>'
            '<xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/></cellXfs></styleSheet>',
        )
        if strings:
            items = "".join(f"<si>{s}</si>" for s in strings)
            book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{items}</sst>')
        for i, (_, body) in numbered:
            book.writestr(
                f"xl/worksheets/sheet{i}.xml",
                f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>',
            )
    return str(path)


STRINGS = ["<t>Nome</t>", "<r><t>An</t></r><r><t>a</t></r><rPh><t>zz</t></rPh>", "<t>data</t>", "<t>NA</t>"]
DADOS = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>valor</t></is></c>'
    '<c r="C1" t="s"><v>2</v></c><c r="D1" t="inlineStr"><is><t>ok</t></is></c>'
    '<c r="E1" t="inlineStr"><is><t>erro</t></is></c><c r="G1"><v>2024</v></c></row>'
    '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>5.0</v></c><c r="C2" s="1"><v>45292</v></c>'
    '<c r="D2" t="b"><v>1</v></c><c r="E2" t="e"><v>#DIV/0!</v></c><c r="G2" t="str"><v>f</v></c></row>'
    '<row r="4"><c r="A4" t="s"><v>3</v></c><c r="B4" s="3"><v>7</v></c><c r="C4" s="2"><v>45292.5</v></c>'
    '<c r="D4" t="b"><v>0</v></c><c r="F4" t="inlineStr"><is><t>x</t></is></c></row>'
    '<row r="5"><c r="A5" s="1"/></row>'
)
OUTROS = '<row><c><v>1</v></c></row><row><c t="inlineStr"><is><t>007</t></is></c></row>'
NOON = dt.datetime(2024, 1, 1, 12)
NEW_YEAR = dt.datetime(2024, 1, 1)


def test_cells_and_types(spark, tmp_path, rows):
    df = scan_xlsx(spark, _book(tmp_path, {"Dados": DADOS, "Outros": OUTROS}, strings=STRINGS))
    assert df.dtypes == [
        ("Nome", "string"),
        ("valor", "bigint"),
        ("data", "timestamp"),
        ("ok", "boolean"),
        ("erro", "double"),
        ("Unnamed: 5", "string"),
        ("2024", "string"),
    ]
    assert rows(df) == sorted(
        [
            ("Ana", 5, NEW_YEAR, True, None, None, "f"),
            (None,) * 7,
            (None, 7, NOON, False, None, "x", None),
        ],
        key=repr,
    )


def test_named_sheet_and_unknown_sheet(spark, tmp_path, rows):
    path = _book(tmp_path, {"Dados": DADOS, "Outros": OUTROS}, strings=STRINGS, target="/xl/worksheets/")
    df = scan_xlsx(spark, path, sheet="Outros")
    assert (df.columns, rows(df)) == (["1"], [(7,)])
    assert scan_xlsx(spark, path, sheet="").columns[0] == "Nome"
    assert scan_xlsx(spark, path, sheet=None).columns[0] == "Nome"
    with pytest.raises(Exception, match="worksheet 'Nada' not found"):
        scan_xlsx(spark, path, sheet="Nada")


@pytest.mark.parametrize(
    "serial, date1904, expected",
    [
        ("45292", False, "2024-01-01 00:00:00"),
        ("43830", True, "2024-01-01 00:00:00"),
        ("1", False, "1900-01-01 00:00:00"),
        ("59", False, "1900-02-28 00:00:00"),
        ("61", False, "1900-03-01 00:00:00"),
        ("0.5", False, "12:00:00"),
        ("45292.000011574", False, "2024-01-01 00:00:01"),
    ],
)
def test_date_serials(spark, tmp_path, serial, date1904, expected):
    body = (
        '<row><c t="inlineStr"><is><t>d</t></is></c></row>'
        f'<row><c s="1"><v>{serial}</v></c></row>'
    )
    raw = scan_xlsx_text(spark, _book(tmp_path, {"S": body}, date1904=date1904))
    assert raw.frame.select(raw.cells[0]).first()[0] == expected


MIXES = [
    ([5, 6], "bigint"),
    ([5, None], "bigint"),
    ([5.5, 6], "double"),
    (["007", 5], "bigint"),
    (["1e3", 2], "double"),
    (["x", 5.5], "string"),
    (["-", 5], "string"),
    (["NA", "x"], "string"),
    (["True", "False"], "boolean"),
    ([12345678901234567, 1], "bigint"),
]


def test_mixed_columns_next_to_pandas(spark, tmp_path):
    """pandas hands the cells of a sheet to its text parser; so do we."""
    table = [[f"c{i}" for i in range(len(MIXES))], *map(list, zip(*[cells for cells, _ in MIXES]))]
    (tmp_path / "m.xlsx").write_bytes(workbook_bytes({"S": table}))
    df = scan_xlsx(spark, str(tmp_path / "m.xlsx"))
    assert [kind for _, kind in df.dtypes] == [wanted for _, wanted in MIXES]
    parsed = pd.io.parsers.TextParser(
        [["" if c is None else c for c in row] for row in table], header=0, skip_blank_lines=False
    ).read()
    for name in df.columns:
        found = [row[0] for row in df.select(name).collect()]
        wanted = [None if value != value else value for value in parsed[name].tolist()]
        if df.schema[name].dataType.typeName() == "string":
            wanted = [None if value is None else str(value) for value in wanted]
        assert sorted(map(str, found)) == sorted(map(str, wanted)) or found == wanted, name


def test_booleans_among_numbers_count_as_numbers(spark, tmp_path, rows):
    body = (
        '<row><c t="inlineStr"><is><t>a</t></is></c></row>'
        '<row><c t="b"><v>1</v></c></row><row><c><v>5</v></c></row>'
    )
    df = scan_xlsx(spark, _book(tmp_path, {"S": body}))
    assert (df.dtypes, rows(df)) == ([("a", "bigint")], [(1,), (5,)])


def test_folder_of_workbooks(spark, tmp_path, rows):
    """Equal and other headers; columns are matched by name."""
    for name, table in {
        "a.xlsx": [["k", "v"], [1, "x"]],
        "b.XLSX": [["k", "v"], [2, "y"]],
        "c.xlsx": [["v", "k", "w"], ["z", 3, 1.5]],
    }.items():
        (tmp_path / name).write_bytes(workbook_bytes({"S": table}))
    df = scan_xlsx(spark, str(tmp_path)).select("k", "v", "w")
    assert rows(df) == [(1, "x", None), (2, "y", None), (3, "z", 1.5)]


def test_cleaned_workbook(spark, tmp_path, rows):
    cleaned = prepare(spark, _book(tmp_path, {"Dados": DADOS}, strings=STRINGS))
    assert cleaned.frame.columns == ["NOME", "VALOR", "DATA", "OK", "UNNAMED_5", "2024"]
    assert (cleaned.n_rows, cleaned.n_columns) == (3, 6)


def test_no_cells(spark, tmp_path):
    with pytest.raises(InputError, match="no cells"):
        scan_xlsx(spark, _book(tmp_path, {"S": ""}))


def test_many_rows_stream(spark, tmp_path):
    content = workbook_bytes({"S": [["a", "b"], *[[i, f"n{i}"] for i in range(5000)]]})
    (tmp_path / "big.xlsx").write_bytes(content)
    df = scan_xlsx(spark, str(tmp_path))
    assert df.count() == 5000 and df.agg({"a": "sum"}).first()[0] == sum(range(5000))
    assert io.BytesIO(content).read(2) == b"PK"


def test_executors_need_no_package(tmp_path):
    """From another folder, where Python workers cannot import the package."""
    script = tmp_path / "elsewhere.py"
    (tmp_path / "b.xlsx").write_bytes(workbook_bytes({"S": [["a"], ["x"], ["ã"]]}))
    script.write_text(
        f"import sys; sys.path.insert(0, {str(Path(__file__).parent.parent)!r})\n"
        "from lakeload.session import build_session\n"
        "from lakeload.functions.names import normalize_name\n"
        "from lakeload.sources.dispatch import scan_xlsx\n"
        "spark = build_session('elsewhere', '2', '1g')\n"
        f"df = scan_xlsx(spark, {str(tmp_path / 'b.xlsx')!r})\n"
        "print(sorted(row[0] for row in df.select(normalize_name(df.a)).collect()))\n"
    )
    found = subprocess.run(
        [sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert found.stdout.strip() == "['a', 'x']", found.stderr[-2000:]


@pytest.mark.parametrize(
    ("code", "kind"),
    [
        ("General", inference.KIND_NUMBER), ("0.00", inference.KIND_NUMBER), ("#,##0 [Red]", inference.KIND_NUMBER),
        ('"days" 0', inference.KIND_NUMBER), (r"\h0", inference.KIND_NUMBER), ("0_h", inference.KIND_NUMBER),
        ("*d0", inference.KIND_NUMBER), ("0;yyyy", inference.KIND_NUMBER), ("[$-416]0", inference.KIND_NUMBER),
        ("yyyy-mm-dd", inference.KIND_DATE), ("[$-F800]dddd", inference.KIND_DATE), ("h:mm AM/PM", inference.KIND_DATE),
        ("[h]:mm:ss", inference.KIND_DURATION), ("[Red][MM]:ss", inference.KIND_DURATION), ("[ss].00", inference.KIND_DURATION),
        ('"[h]" 0', inference.KIND_NUMBER), ("[hm]", inference.KIND_NUMBER), ('"open', inference.KIND_NUMBER),
    ],
)
def test_format_codes(code, kind):
    assert format_kind(code) == kind


def test_elapsed_times(spark, schema, tmp_path, rows):
    cells = [1.5, 2.0, -0.25, 0.0000115741, 40.0]
    body = "<row><c t='str'><v>took</v></c><c t='str'><v>mixed</v></c></row>" + "".join(
        f'<row><c s="4"><v>{v}</v></c><c s="{4 if k else 1}"><v>{v}</v></c></row>' for k, v in enumerate(cells)
    )
    path = _book(tmp_path, {"S": body})
    cleaned = prepare(spark, str(path)).frame
    assert [t for _, t in cleaned.dtypes] == ["interval day to second", "string"]
    want = [dt.timedelta(days=1, hours=12), dt.timedelta(days=2), -dt.timedelta(hours=6), dt.timedelta(seconds=1), dt.timedelta(40)]
    assert sorted(r["TOOK"] for r in cleaned.collect()) == sorted(want)
    assert "1 12:00:00" not in {r["MIXED"] for r in cleaned.collect()} and "2 00:00:00" in {r["MIXED"] for r in cleaned.collect()}
    for mode in ("overwrite", "append", "overwrite"):
        assert save_table(cleaned, f"{schema}.t", mode).ok
    assert sorted(r["TOOK"] for r in spark.table(f"{schema}.t").collect()) == sorted(want)
