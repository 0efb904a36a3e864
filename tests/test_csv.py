"""CSV reading next to pandas, with files cut into small splits."""

import io
import random

import pandas as pd
import pytest

from lakeload.operators.inference import profile, spark_type
from lakeload.plans.ingest import prepare
from lakeload.sources import csv as csv_source
from lakeload.sources.csv import scan_csv_text
from lakeload.sources.dispatch import scan_csv
from lakeload.sources.raw import InputError

MESSY = (
    "a,b,b,c,d,e,f,g,,h\n"
    " x ,1,1.5,-,True,2024-01-01,,None,z,1\n"
    "y,2,,q,False,2024-01-02,,NA,,\n"
)


def _file(tmp_path, content, name="f.csv"):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def _cells(raw):
    return sorted(map(tuple, raw.frame.select(*raw.cells).collect()), key=repr)


def _pandas_cells(source):
    read = pd.read_csv(source, dtype=str)
    return sorted(
        (tuple(None if c != c else c for c in row) for row in read.itertuples(index=False)), key=repr
    )


def test_messy_file(spark, tmp_path, rows):
    cleaned = prepare(spark, _file(tmp_path, MESSY))
    assert [tuple(f) for f in cleaned.frame.dtypes] == [
        ("A", "string"),
        ("B", "bigint"),
        ("B_1", "double"),
        ("C", "string"),
        ("D", "boolean"),
        ("E", "string"),
        ("UNNAMED_8", "string"),
        ("H", "bigint"),
    ]
    assert rows(cleaned.frame) == [
        ("x", 1, 1.5, None, True, "2024-01-01", "z", 1),
        ("y", 2, None, "q", False, "2024-01-02", None, None),
    ]
    assert (cleaned.n_rows, cleaned.n_columns) == (2, 8)


def test_scan_keeps_cells_and_names(spark, tmp_path):
    df = scan_csv(spark, _file(tmp_path, MESSY))
    assert df.columns == list(pd.read_csv(io.StringIO(MESSY)).columns)
    assert {row.a for row in df.select("a").collect()} == {" x ", "y"}


COLUMNS = [
    ("1\n2", "bigint"),
    ("1\n-\n3", "string"),
    ("1\n\n3", "bigint"),
    ("1\n 3 ", "bigint"),
    ("1\n+5\n-7", "bigint"),
    (" 5\n007", "bigint"),
    ("1.5\n2", "double"),
    ("5.\n.5\n-1.e5\n1e+5", "double"),
    ("True\n\nFalse", "boolean"),
    ("TRUE\ntrue\nFalse", "boolean"),
    ("True\n1", "string"),
    ("tRue\nFalse", "boolean"),
    (" True\nFalse", "string"),
    ("1e3\n0x10", "string"),
    ("1e400\n2", "string"),
    ("1e\n2", "string"),
    ("1.5\n99999999999999999999", "double"),
    ("1\n99999999999999999999", "string"),
    ("9223372036854775807\n-9223372036854775808", "bigint"),
    ("000000000000000000000000000000000000000000042\n1", "bigint"),
    ("9223372036854775808\n1", "string"),
    ("inf\n-Infinity\n+INF\n2", "double"),
    (" inf\n2", "string"),
    ("1_000\n2", "string"),
    ("- 5\n1", "string"),
    ("1\nx", "string"),
    ("2024-01-01\n2024-01-02", "string"),
    ("1\n٣", "string"),
    ('"1,000"\n2', "string"),
    ('"  "\n1', "string"),
]
PANDAS_KIND = {"bigint": "if", "double": "f", "boolean": "b", "string": "O"}
# pandas turns gaps in booleans into text and reads integers up to 2**64 - 1.
DEPARTURES = {"True\n\nFalse", "9223372036854775808\n1", "000000000000000000000000000000000000000000042\n1"}


@pytest.mark.parametrize("probe", [False, True])
def test_inferred_types(spark, tmp_path, probe):
    """All columns at once, next to what pandas infers for each."""
    height = max(len(cells.split("\n")) for cells, _ in COLUMNS)
    columns = [cells.split("\n") + [""] * (height - len(cells.split("\n"))) for cells, _ in COLUMNS]
    lines = [",".join(f"c{i}" for i in range(len(columns)))] + [",".join(r) for r in zip(*columns)]
    raw = scan_csv_text(spark, _file(tmp_path, "\n".join(lines) + "\n"))
    found = [spark_type(bits) for bits in profile(raw, probe=probe).bits]
    assert found == [wanted for _, wanted in COLUMNS]
    for cells, wanted in COLUMNS:
        if cells not in DEPARTURES:
            content = "a,k\n" + "".join(f"{cell},k\n" for cell in cells.split("\n"))
            assert pd.read_csv(io.StringIO(content)).a.dtype.kind in PANDAS_KIND[wanted], cells


def test_values_after_casting(spark, tmp_path, rows):
    df = scan_csv(spark, _file(tmp_path, "a,b,c,d\n 5,1e3,TRUE,inf\n007,.5,false,2\n"))
    assert rows(df) == [(5, 1000.0, True, float("inf")), (7, 0.5, False, 2.0)]


def test_missing_tokens(spark, tmp_path):
    tokens = [
        "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
        "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
    ]
    content = "a,b\n" + "".join(f"{t},x\n" for t in tokens) + '"",x\n'
    raw = scan_csv_text(spark, _file(tmp_path, content))
    assert _cells(raw) == [(None, "x")] * 20 == _pandas_cells(io.StringIO(content))


@pytest.mark.parametrize(
    "content",
    [
        "a,b\n1\n2,3\n",
        "a,b\n\n  \n1,2\n\t\n3,4\n\n",
        'a,b\n1,"x\ny"\n2,"q""r"\n',
        'a,b\n1,5" pipe\n2,"x"y\n',
        "a\n1\n\n2\n",
        'a\n1\n""\n2\n',
        "a,b\n ,,\n".replace(",,", ","),
        b"\xef\xbb\xbfa,b\n1,2\n",
        b"a,b\r\n1,x\r\n2,y\r\n",
        b"a,b\r1,x\r2,y\r",
        '"h\n1",b\n1,2\n3,"4\n\n5"\n',
        '\n \n"h, 1","b ""q"""\n1,2\n',
        "a,b\n1,2",
        'a,b\n1,"2\n3"',
    ],
)
def test_same_cells_as_pandas(spark, tmp_path, content):
    path = _file(tmp_path, content)
    raw = scan_csv_text(spark, path)
    wanted = _pandas_cells(path)
    if content == 'a,b\n1,5" pipe\n2,"x"y\n':
        # Text after a closing quote is kept as written, where pandas drops the quotes.
        wanted = [("1", '5" pipe'), ("2", '"x"y')]
    assert _cells(raw) == wanted
    assert raw.names == list(pd.read_csv(path).columns)


def _random_csv(seed, n_rows=200):
    chance = random.Random(seed)

    def cell():
        kind = chance.random()
        if kind < 0.5:
            pieces = ["x", " ", ",", "y", '""', "\n", "\n\n", "z"]
            return '"' + "".join(chance.choices(pieces, k=chance.randint(1, 12))) + '"'
        return 'p" q' if kind < 0.6 else "plain"

    lines = ["id,a,b"]
    for number in range(n_rows):
        lines.append(f"{number},{cell()},{cell()}")
        if chance.random() < 0.1:
            lines.append("  \n")
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("seed, split", [(1, 48), (2, 300), (3, 5000), (4, 10**8)])
def test_quoted_line_ends_over_splits(spark, tmp_path, small_splits, seed, split):
    path = _file(tmp_path, _random_csv(seed))
    small_splits(split)
    assert _cells(scan_csv_text(spark, path)) == _pandas_cells(path)


def test_plain_file_over_splits(spark, tmp_path, small_splits):
    content = "a,b\n" + "".join(f'{i},"v, {i}"\n' for i in range(500))
    path = _file(tmp_path, content)
    small_splits(256)
    raw = scan_csv_text(spark, path)
    assert raw.frame.rdd.getNumPartitions() > 10
    assert _cells(raw) == _pandas_cells(path)


def test_too_many_fields(spark, tmp_path):
    with pytest.raises(InputError, match="1 row.* more fields than the 2"):
        scan_csv(spark, _file(tmp_path, "a,b\n1,2\n1,2,3\n"))


def test_open_quote_at_the_end(spark, tmp_path):
    with pytest.raises(InputError, match="quoted field"):
        scan_csv_text(spark, _file(tmp_path, 'a,b\n1,"2\n3,4\n'))


def test_no_rows(spark, tmp_path):
    with pytest.raises(InputError, match="no data rows"):
        prepare(spark, _file(tmp_path, "a,b\n"))
    with pytest.raises(InputError):
        prepare(spark, _file(tmp_path, "", "empty.csv"))


def test_folder_matches_columns_by_name(spark, tmp_path, rows):
    """Other order, other columns, odd file names, an upper-case suffix, quoted line ends."""
    _file(tmp_path, "a,b\n1,x\n", "one a%20b.csv")
    _file(tmp_path, "b,a\ny,2\n", "two[1].csv")
    _file(tmp_path, 'a,c\n3,"p\nq"\n', "three.CSV")
    (tmp_path / "deep").mkdir()
    _file(tmp_path, "a,b\n4,w\n", "deep/four.csv")
    df = scan_csv(spark, str(tmp_path)).select("a", "b", "c")
    assert rows(df) == [(1, "x", None), (2, "y", None), (3, None, "p\nq"), (4, "w", None)]


def test_settled_columns_leave_the_full_pass(spark, tmp_path):
    """The probe reads the head only; late surprises still count."""
    lines = ["t,n,late"] + [f"x{i},{i}," for i in range(3000)] + ["-,oops,5"]
    raw = scan_csv_text(spark, _file(tmp_path, "\n".join(lines) + "\n"))
    for probe in (False, True):
        found = profile(raw, probe=probe)
        assert found.n_rows == 3001
        assert [spark_type(bits) for bits in found.bits] == ["string", "string", "bigint"]


@pytest.mark.parametrize("cell", ["x", '"x\ny"'])
def test_many_files_of_one_header(spark, tmp_path, cell):
    for number in range(4):
        _file(tmp_path, f"a,b\n{number},{cell}\n", f"{number}.CSV")
    _file(tmp_path, "\n", "blank.csv")
    (tmp_path / "note.txt").write_text("x")
    raw = scan_csv_text(spark, str(tmp_path), by_suffix=True)
    assert raw.frame.count() == 4


@pytest.mark.parametrize("row", ["3,4,,X", "3,4,", "3,4,,", "3,4,5", '3,4,"x\ny"', '"3\n",4,,X'])
def test_rows_with_a_field_too_many_are_refused(spark, tmp_path, row):
    with pytest.raises(InputError, match="more fields"):
        scan_csv(spark, _file(tmp_path, f"a,b\n1,2\n{row}\n"))
    with pytest.raises(InputError, match="more fields"):  # with columns that the first rows settle
        scan_csv(spark, _file(tmp_path, "a,b\n" + "x,y\n" * 1500 + f"{row}\n"))


def test_short_rows_and_commas_in_quotes_are_kept(spark, tmp_path, rows):
    found = scan_csv(spark, _file(tmp_path, 'a,b\n1\n2,"x,y,z"\n3,"x,\ny,z"\n'))
    assert rows(found) == [(1, None), (2, "x,y,z"), (3, "x,\ny,z")]


def test_open_quote_in_the_header_is_refused(spark, tmp_path):
    with pytest.raises(InputError):
        scan_csv(spark, _file(tmp_path, 'a,"b\n' + "1,2\n" * 30_000))


def test_bytes_that_are_not_text_are_refused(spark, tmp_path, rows):
    path = tmp_path / "latin.csv"
    path.write_bytes('nome,b\nSão,"x\ny"\n'.encode("latin-1"))
    with pytest.raises(InputError, match="latin.csv"):
        scan_csv(spark, str(path))
    assert rows(scan_csv(spark, str(path), encoding="ISO-8859-1")) == [("São", "x\ny")]
    path.write_bytes("nome,b\nSão,ü\n".encode("latin-1"))
    assert rows(scan_csv(spark, str(path), encoding="ISO-8859-1")) == [("São", "ü")]


def test_line_ends_in_quotes_are_kept(spark, tmp_path, rows):
    path = tmp_path / "ends.csv"
    path.write_bytes(b'a,b\r\n1,"x\r\ny"\r\n\r\n2,"p\nq"\r\n3,z\r\n')
    assert rows(scan_csv(spark, str(path))) == [(1, "x\r\ny"), (2, "p\nq"), (3, "z")]


def _many_headers(tmp_path, count, quoted):
    """Files of different headers, orders and widths, and the rows they hold under table names."""
    chance, want = random.Random(count), []
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(count):
        columns = chance.sample(["a", "b", "c.d", f"own {k % 5}"], chance.randrange(1, 5))
        if "a" not in columns:
            columns.append("a")
        spelled = [" " * (k // 4) + name.upper() if k % 2 else name + "." * k for name in columns]
        if quoted and k % 3 == 0:
            spelled[0] += "\n"
        lines = [",".join(f'"{name}"' for name in spelled)]
        for row in range(3):
            cells = {name: f"{k}-{row}-{name}" + (" x,\ny" if quoted and row == 1 else "") for name in columns}
            cells = {name: cell for name, cell in cells.items() if row < 2 or len(columns) == 1 or name != columns[-1]}
            lines.append(",".join(f'"{cell}"' if "," in cell else cell for cell in cells.values()))
            want.append({name.upper().replace(".", "_").replace(" ", "_"): cell for name, cell in cells.items()})
        (folder / f"{k}.csv").write_text("\n\n".join(lines) + "\n")
    return str(folder), want


@pytest.mark.parametrize("quoted", [False, True])
def test_many_headers_are_one_plan(spark, tmp_path, small_splits, monkeypatch, quoted):
    folder, want = _many_headers(tmp_path, 40, quoted)
    monkeypatch.setattr(csv_source, "_header_record", None)  # no job for a header
    frame = prepare(spark, folder).frame
    found = [{name: cell for name, cell in row.asDict().items() if cell is not None} for row in frame.collect()]
    assert sorted(map(repr, map(sorted, map(dict.items, found)))) == sorted(map(repr, map(sorted, map(dict.items, want))))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 3  # one scan for each way of reading, whatever the number of headers
    monkeypatch.undo()
    small_splits(7)  # headers that run over splits, as all else
    raw = scan_csv_text(spark, folder)
    assert raw.frame.where("overflow IS NULL").count() == len(want)


def test_too_many_fields_under_many_headers(spark, tmp_path):
    folder, _ = _many_headers(tmp_path, 12, False)
    (tmp_path / "many" / "odd.csv").write_text("a,zz\n1,2,\n")
    with pytest.raises(InputError, match="more fields"):
        prepare(spark, folder)


def test_many_headers_without_broadcast(spark, tmp_path, monkeypatch):
    folder, want = _many_headers(tmp_path, 12, False)
    monkeypatch.setattr(csv_source, "SENT_FILES", 0)
    monkeypatch.setattr(csv_source, "SENT_PLACES", 0)
    assert prepare(spark, folder).n_rows == len(want)
