"""Header rules, name columns and the small text functions."""

import base64
import io
import re
import unicodedata

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeload.functions import names, text, times


@pytest.mark.parametrize(
    "header, expected",
    [
        ("Código do Cliente", "CODIGO_DO_CLIENTE"),
        ("Razão Social / Nome", "RAZAO_SOCIAL_NOME"),
        ("Preço (R$)", "PRECO_R$"),
        ("Nº", "NO"),
        ("% Desc.", "DESC"),
        ("data-início", "DATA_INICIO"),
        ("__x__", "X"),
        ("Unnamed: 3", "UNNAMED_3"),
        ("ﬁm", "FIM"),
        ("½ ano", "12_ANO"),
        ("straße", "STRAE"),
        (2024, "2024"),
    ],
)
def test_header(header, expected):
    assert names.column_names([header]) == [expected]


@pytest.mark.parametrize(
    "headers, expected",
    [
        (["b", "b.1", "B"], ["B", "B_1", "B_2"]),
        (["a", "A", "á"], ["A", "A_2", "A_3"]),
        (["A_2", "A_2"], ["A_2", "A_2_2"]),
        (["a", "A", "a_2"], ["A", "A_2", "A_2_2"]),
        (["x", "y", "z", "---"], ["X", "Y", "Z", "COL_3"]),
    ],
)
def test_header_lists(headers, expected):
    assert names.column_names(headers) == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=8), max_size=8))
def test_header_properties(headers):
    found = names.column_names(headers)
    assert len(set(found)) == len(headers)
    assert all(name and name.isascii() and name == name.upper() for name in found)
    assert names.column_names(found) == found


@pytest.mark.parametrize(
    "header", ["a,b,b,c,,", "b,b,b.1,b", ",,x", "a,a,a,a.2", "NA,None,nan,NA"]
)
def test_reader_names_are_those_of_pandas(header):
    fields = header.split(",")
    read = pd.read_csv(io.StringIO(header + "\n" + ",".join("1" for _ in fields) + "\n"))
    assert names.reader_names(fields) == list(read.columns)


def _normalized(name):
    """The name rule, stated once more with Python's own tables."""
    ascii_only = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    return re.sub("[^a-z0-9]+", "_", ascii_only).strip("_")


def test_normalize_name(spark):
    given_names = ["VENDAS-Distribuição v1.2", "Big Data", "ﬁm ½ straße", "___", "", "日本 x", "Ａｂ①"]
    df = spark.createDataFrame([(n,) for n in [*given_names, None]], "n string")
    found = df.select("n", names.normalize_name(F.col("n")).alias("r")).collect()
    assert [row.r for row in found] == [*map(_normalized, given_names), None]
    assert found[0].r == "vendas_distribuicao_v1_2"


def test_normalize_name_on_whole_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = documents.select("text", names.normalize_name(F.col("text")).alias("r")).collect()
    assert all(row.r == _normalized(row.text) for row in found)


def test_share_token(spark):
    url = "https://x.y/ü?e=>>>" * 6
    assert len(url) == 114
    df = spark.createDataFrame([(url,)], "u string").select(text.share_token(F.col("u")))
    wanted = "u!" + base64.urlsafe_b64encode(url.encode()).decode().rstrip("=")
    assert df.first()[0] == wanted


def test_decode_text(spark):
    cells = [' "ab" ', "ã\n", '"', "x" * 200]
    df = spark.createDataFrame([(base64.b64encode(c.encode()).decode(),) for c in cells], "c string")
    found = [row[0] for row in df.select(text.decode_text(F.col("c"))).collect()]
    assert found == [c.strip().replace('"', "") for c in cells]


def test_paths(spark):
    df = spark.createDataFrame([("https://h/s/Big Data/f?e=1", "Plan.xlsx")], "u string, n string")
    path = names.landing_path(F.col("u"), F.col("n"), "/base/")
    assert df.select(path).first()[0] == "/base/big_data/Plan.xlsx"
    df = spark.createDataFrame([("Vendas.2024.CSV", "/v/ds/x/Vendas.CSV")], "up string, landed string")
    row = df.select(
        names.uploaded_file_name(F.col("up")),
        names.file_format(F.col("up")),
        names.landed_file_name(F.col("landed")),
        names.file_format(F.col("landed")),
    ).first()
    assert tuple(row) == ("vendas", "csv", "/v/ds/x/vendas", "csv")


def test_load_timestamp(spark):
    df = spark.sql("SELECT timestamp '2024-01-01 02:30:59 UTC' AS t, timestamp_ntz '2024-01-01 02:30:59' AS n")
    row = df.select(
        times.load_timestamp(F.col("t")), times.load_timestamp(F.col("n"), source_zone="UTC")
    ).first()
    assert tuple(row) == ("2023-12-31 23:30",) * 2
    now = spark.range(1).select(times.load_timestamp()).first()[0]
    assert re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d", now)


def test_qualified_name():
    assert names.qualified_name("c", "s", "a`b") == "`c`.`s`.`a``b`"


def test_blanks_are_those_of_strip():
    assert len(text.BLANKS) == 29
    assert all(char.isspace() for char in text.BLANKS)
