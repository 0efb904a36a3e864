"""Cell cleaning and empty columns."""

import datetime as dt
import decimal

import pytest

from lakeload.operators.cleaning import (
    clean,
    drop_empty_columns,
    load_metrics,
    normalize_columns,
    null_markers,
    preview,
    trim_strings,
)
from lakeload.operators.inference import (
    DECIMAL,
    INTEGER,
    MARKER,
    MISSING,
    bit_table,
    is_empty,
    spark_type,
)
from lakeload.plans.ingest import prepare
from lakeload.sources.csv import scan_csv_text
from lakeload.sources.raw import InputError


@pytest.mark.parametrize(
    "cell, expected",
    [
        ("  x ", "x"),
        ("\t x ", "x"),
        (" q\x1f", "q"),
        ("\u2003y\u00a0", "y"),
        ("-", None),
        (" - ", None),
        ("a-", "a-"),
        ("--", "--"),
        ("None", None),
        (" None ", None),
        ("none", "none"),
        ("nan", "nan"),
        ("   ", ""),
        (None, None),
    ],
)
def test_cell(spark, cell, expected):
    df = spark.createDataFrame([(cell, 1)], "c string, one int")
    assert null_markers(trim_strings(df)).first().c == expected


def test_clean(spark, rows):
    df = spark.createDataFrame(
        [
            (" a ", 1, None, float("nan"), "-", "   ", dt.date(2024, 1, 1), decimal.Decimal("1.50"), [1]),
            ("None", 2, None, 1.5, " - ", "  ", None, None, None),
        ],
        "`Nome do Cliente` string, b bigint, vazio string, d double, e string, f string,"
        " g date, h decimal(5,2), i array<int>",
    )
    cleaned = clean(df)
    assert cleaned.columns == ["NOME_DO_CLIENTE", "B", "D", "F", "G", "H", "I"]
    assert rows(cleaned) == [
        ("a", 1, None, "", dt.date(2024, 1, 1), decimal.Decimal("1.50"), [1]),
        (None, 2, 1.5, "", None, None, None),
    ]
    assert rows(clean(cleaned)) == rows(cleaned)


def test_suffixes_come_before_dropping(spark):
    df = spark.createDataFrame([(None, 1)], "a string, b int").toDF("a", "A")
    assert clean(df).columns == ["A_2"]


def test_names_with_dots_and_ticks(spark):
    df = spark.createDataFrame([(" x ", "y")], "a string, b string").toDF("a.b", "c`d")
    assert trim_strings(df).first()[0] == "x"
    assert normalize_columns(df).columns == ["A_B", "C_D"]


def test_drop_empty_columns(spark):
    df = spark.createDataFrame([(1, None, float("nan"), "")], "a int, b string, c double, d string")
    assert drop_empty_columns(df).columns == ["a", "d"]


def test_nothing_left(spark):
    with pytest.raises(InputError, match="no column"):
        clean(spark.createDataFrame([("-",)], "a string"))
    with pytest.raises(InputError, match="no data rows"):
        clean(spark.createDataFrame([], "a string"))


def _csv(tmp_path, content):
    (tmp_path / "f.csv").write_text(content)
    return str(tmp_path / "f.csv")


def test_missing_text(spark, tmp_path, rows):
    """What pandas would store for missing cells of text columns."""
    path = _csv(tmp_path, "t,dash,gone,n\nx,-,,1\n,,,\n")
    assert rows(prepare(spark, path).frame) == [("x", 1), (None, None)]
    kept = prepare(spark, path, missing_text="nan").frame
    assert kept.columns == ["T", "DASH", "N"]
    assert rows(kept) == [("nan", "nan", None), ("x", None, 1)]


def test_markers_come_after_inference(spark, tmp_path, rows):
    cleaned = prepare(spark, _csv(tmp_path, "a,b\n1,-\n-,-\n3,-\n")).frame
    assert cleaned.dtypes == [("A", "string")]
    assert rows(cleaned) == [("1",), ("3",), (None,)]


def test_bits():
    assert spark_type(INTEGER | MISSING) == "bigint"
    assert spark_type(INTEGER | DECIMAL) == "double"
    assert is_empty(MARKER | MISSING, keep_missing=False)
    assert not is_empty(MARKER | MISSING, keep_missing=True)
    assert is_empty(MISSING, keep_missing=True)


def test_counts_and_preview(spark, tmp_path):
    cleaned = prepare(spark, _csv(tmp_path, "a,b,c\n" + "1,x,-\n" * 30))
    assert tuple(load_metrics(cleaned, spark).first()) == (30, 2)
    assert preview(cleaned.frame, 10).count() == 10
    assert "Limit" in preview(cleaned.frame, 10)._jdf.queryExecution().optimizedPlan().toString()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_merges_before_its_only_shuffle(spark, tmp_path):
    """Hash aggregates in the JVM on both sides of one exchange, and only the asked columns."""
    raw = scan_csv_text(spark, _csv(tmp_path, "a,b,c\n1,x,2\n"))
    plan = _plan(bit_table(raw, [raw.cells[0], raw.cells[2]]))
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2
    assert "SortAggregate" not in plan and "Python" not in plan
    assert "ReadSchema: struct<f0:string,f2:string,odd_record:string>" in plan


def test_load_is_scan_and_projection(spark, tmp_path):
    cleaned = prepare(spark, _csv(tmp_path, "a,b,c\n1,-,x\n"))
    plan = _plan(cleaned.frame)
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<f0:string,f2:string>" in plan


def test_wide_input(spark, tmp_path):
    header = ",".join(f"col {i}" for i in range(400))
    lines = "".join(",".join(str(row * i) for i in range(400)) + "\n" for row in range(20))
    cleaned = prepare(spark, _csv(tmp_path, f"{header}\n{lines}"))
    assert (cleaned.n_rows, cleaned.n_columns) == (20, 400)
    assert {kind for _, kind in cleaned.frame.dtypes} == {"bigint"}
