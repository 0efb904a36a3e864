"""Table writes, the control table, catalog names and whole loads."""

from pathlib import Path

import pytest

from lakeload.operators import catalog, control
from lakeload.operators.tables import save_table, type_conflicts, write_table
from lakeload.plans.ingest import ingest, prepare, target_parts
from lakeload.plans.landing import land_csv, workbook_bytes
from lakeload.session import remove_folders
from lakeload.sources.dispatch import read_raw, read_source, scan_parquet, source_manifest
from lakeload.sources.raw import InputError


def _df(spark, values, ddl):
    return spark.createDataFrame(values, ddl)


def test_creates_a_table(spark, schema, rows):
    result = save_table(_df(spark, [(1, "x"), (2, "y")], "A bigint, B string"), f"{schema}.t", "append")
    assert (result.ok, result.n_rows, result.n_columns) == (True, 2, 2)
    assert rows(spark.table(f"{schema}.t")) == [(1, "x"), (2, "y")]


def test_append_adds_columns_by_name(spark, schema, rows):
    table = f"{schema}.t"
    save_table(_df(spark, [(1, "x")], "A bigint, B string"), table)
    save_table(_df(spark, [(1.5, "y", 2)], "`C$ d` double, B string, a bigint"), table, "append")
    save_table(_df(spark, [(3,)], "A bigint"), table, "append")
    assert spark.table(table).columns == ["A", "B", "C$ d"]
    assert rows(spark.table(table)) == [(1, "x", None), (2, "y", 1.5), (3, None, None)]


def test_overwrite_keeps_columns(spark, schema, rows):
    table = f"{schema}.t"
    save_table(_df(spark, [(1, "x")], "A bigint, B string"), table)
    save_table(_df(spark, [("y", 1.5)], "B string, C double"), table, "overwrite")
    assert spark.table(table).columns == ["A", "B", "C"]
    assert rows(spark.table(table)) == [(None, "y", 1.5)]


def test_conflict_is_refused_and_told(spark, schema, rows):
    table = f"{schema}.t"
    save_table(_df(spark, [(1,)], "A int"), table)
    for mode in ("append", "overwrite"):
        result = save_table(_df(spark, [("x", 1)], "A string, N int"), table, mode)
        assert not result.ok and "A: string into int" in result.message
    assert spark.table(table).columns == ["A"] and rows(spark.table(table)) == [(1,)]


def test_conflicts(spark):
    def conflict(have, want):
        table, incoming = (_df(spark, [], f"a {kind}").schema for kind in (want, have))
        return type_conflicts(table, incoming)

    assert not conflict("int", "bigint") and not conflict("float", "double")
    assert conflict("bigint", "int") and conflict("bigint", "double") and conflict("double", "bigint")
    assert not conflict("array<int>", "array<int>")


def test_nested_column_can_be_added(spark, schema, rows):
    table = f"{schema}.t"
    save_table(_df(spark, [(1,)], "a int"), table)
    added = _df(spark, [(2, (3, ["x"]))], "a int, s struct<`x y`: int, l: array<string>>")
    assert save_table(added, table, "append").ok
    assert spark.table(table).select("s.`x y`").count() == 2


def test_mode_is_checked(spark, schema):
    with pytest.raises(ValueError, match="mode"):
        write_table(_df(spark, [(1,)], "a int"), f"{schema}.t", "replace")
    assert not save_table(_df(spark, [(1,)], "a int"), f"{schema}.t", "").ok


def test_control_table(spark, schema):
    table = f"{schema}.ctl"
    control.create_control_table(spark, table)
    control.create_control_table(spark, table)
    control.record_load(spark, table, db_table="o'neil", n_rows=3_000_000_000, n_columns=2)
    row = spark.table(table).first()
    assert spark.table(table).columns == control.CONTROL_SCHEMA.names
    assert (row.db_table, row.n_rows, row.transient) == ("o'neil", 3_000_000_000, None)
    assert row.inserted_by == catalog.current_user(spark).first()[0]
    with pytest.raises(ValueError, match="not control columns"):
        control.control_row(spark, nothing="x")


def test_load_status(spark):
    loads = control.control_row(spark, db_table="t", n_rows=1, dh_insertion="2024-01-01 10:00")
    for values in [("t", 2, "2024-01-02 09:00"), ("t", 9, "2023-12-31 23:59"), ("u", 5, "2020-01-01 00:00")]:
        row = dict(zip(["db_table", "n_rows", "dh_insertion"], values))
        loads = loads.unionAll(control.control_row(spark, **row))
    latest = control.load_status(loads)
    assert latest.columns == control.CONTROL_SCHEMA.names
    assert {(r.db_table, r.n_rows) for r in latest.collect()} == {("t", 2), ("u", 5)}


def test_catalog_names(spark, schema):
    write_table(_df(spark, [(1,)], "a int"), f"{schema}.one")
    assert [r[0] for r in catalog.list_catalogs(spark).collect()] == ["spark_catalog"]
    assert catalog.list_catalogs(spark, hidden=["spark_catalog"]).count() == 0
    schemas = {r[0] for r in catalog.list_schemas(spark, "spark_catalog").collect()}
    assert schema in schemas and "default" not in schemas
    assert [r[0] for r in catalog.list_tables(spark, "spark_catalog", schema).collect()] == ["one"]


@pytest.mark.parametrize(
    "name, expected",
    [
        ("c.s.t", ("c", "s", "t")),
        ("`c`.`s.x`.t", ("c", "s.x", "t")),
        ("s.t", ("spark_catalog", "s", "t")),
        ("t", ("spark_catalog", "default", "t")),
    ],
)
def test_target_parts(spark, name, expected):
    assert target_parts(spark, name) == expected


@pytest.mark.parametrize("name", ["", "None", "none", "a..b", "a.b.c.d"])
def test_target_is_checked(spark, name):
    with pytest.raises(ValueError):
        target_parts(spark, name)


def test_arguments_are_checked(spark, schema):
    for path in ("", "None", []):
        with pytest.raises(ValueError, match="source path"):
            ingest(spark, path, f"{schema}.t")
    with pytest.raises(ValueError, match="mode"):
        ingest(spark, "x.csv", f"{schema}.t", "replace")


def test_upload_and_link_rows(spark, schema, tmp_path):
    ctl = f"{schema}.ctl"
    upload = tmp_path / "Vendas.2024.XLSX"
    upload.write_bytes(workbook_bytes({"Dados": [["a"], [1]], "Outros": [["b"], [2], [3]]}))
    assert ingest(spark, str(upload), f"{schema}.t1", sheet="Outros", control_table=ctl).n_rows == 2
    landed = tmp_path / "big_data" / "Plan.csv"
    landed.parent.mkdir()
    landed.write_text("a,b\n1,-\n")
    result = ingest(
        spark, str(landed), f"spark_catalog.{schema}.t2", "append", landed=True,
        control_table=ctl, inserted_by="ana",
    )
    assert (result.ok, result.n_rows, result.n_columns) == (True, 1, 1)
    found = {row.db_table: row.asDict() for row in spark.table(ctl).collect()}
    assert (found["t1"]["file_name"], found["t1"]["file_format"]) == ("vendas", "xlsx")
    assert (found["t1"]["sheet"], found["t1"]["transient"]) == ("Outros", None)
    assert found["t2"]["file_name"] == str(landed).lower().removesuffix(".csv").split(".")[-1]
    assert (found["t2"]["transient"], found["t2"]["sheet"]) == (str(landed), None)
    assert (found["t2"]["inserted_by"], found["t2"]["insert_mode"]) == ("ana", "append")
    assert (found["t2"]["db_catalog"], found["t2"]["db_schema"]) == ("spark_catalog", schema)


def test_intermediate_rows_are_removed(spark, schema, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n' + '2,"x\ny"\n' * 20)
    small_splits(16)
    stored = read_raw(spark, str(tmp_path / "a.csv")).stored
    assert len(stored) == 1 and Path(stored[0]).exists()
    remove_folders(spark, stored)
    assert not Path(stored[0]).exists()
    assert ingest(spark, str(tmp_path / "a.csv"), f"{schema}.t").ok


def test_failed_load_leaves_no_control_row(spark, schema, tmp_path):
    (tmp_path / "a.csv").write_text("a\nx\n")
    save_table(_df(spark, [(1,)], "A int"), f"{schema}.t")
    result = ingest(spark, str(tmp_path / "a.csv"), f"{schema}.t", control_table=f"{schema}.ctl")
    assert not result.ok and "conflict" in result.message
    assert not spark.catalog.tableExists(f"{schema}.ctl")


def test_parquet_scan(spark, tmp_path, rows):
    """NaN is missing; files of other columns are merged; types stay."""
    _df(spark, [(1, float("nan"))], "a int, d double").write.parquet(f"{tmp_path}/p/one.parquet")
    _df(spark, [(2, "x")], "a int, s string").write.parquet(f"{tmp_path}/p/two.parquet")
    df = scan_parquet(spark, f"{tmp_path}/p").select("a", "d", "s")
    assert rows(df) == [(1, None, None), (2, None, "x")]
    assert prepare(spark, f"{tmp_path}/p").frame.columns == ["A", "S"]


def test_parquet_filter_reaches_the_scan(spark, tmp_path):
    _df(spark, [(1, "x", 2.0)], "a int, s string, d double").write.parquet(f"{tmp_path}/p.parquet")
    df = scan_parquet(spark, f"{tmp_path}/p.parquet").where("a > 5").select("s")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,5)" in plan and "ReadSchema: struct<a:int,s:string>" in plan


def test_mixed_folder(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("k,v\n1,2\n")
    (tmp_path / "b.xlsx").write_bytes(workbook_bytes({"S": [["k", "v"], [2, "x"]]}))
    _df(spark, [(3, 1.5)], "k int, d double").write.parquet(f"{tmp_path}/c")
    df = read_source(spark, str(tmp_path)).select("k", "v", "d")
    assert df.dtypes == [("k", "bigint"), ("v", "string"), ("d", "double")]
    assert rows(df) == [(1, "2", None), (2, "x", None), (3, None, 1.5)]


def test_unknown_formats(spark, tmp_path):
    (tmp_path / "a.xls").write_text("x")
    with pytest.raises(InputError, match="cannot read"):
        read_source(spark, str(tmp_path))
    with pytest.raises(InputError, match="cannot read"):
        read_source(spark, str(tmp_path / "a.xls"))


def test_manifest_reads_no_content(spark, tmp_path):
    (tmp_path / "A b.CSV").write_text("a\n1\n")
    manifest = source_manifest(spark, str(tmp_path))
    row = manifest.first()
    assert (row.file_name, row.file_format, row.length) == ("A b.CSV", "csv", 4)
    assert "content:binary" not in manifest._jdf.queryExecution().executedPlan().toString()


def test_target_types_keep_a_feed_going(spark, schema, tmp_path, rows):
    table = f"{schema}.t"
    for name, text in (("1", "a,b,c\n1.5,-,x\n"), ("2", "a,b,c\n2,3,007\n"), ("3", "a,b,c\n3,4,True\n")):
        (tmp_path / f"{name}.csv").write_text(text)
        assert ingest(spark, f"{tmp_path}/{name}.csv", table, "append", target_types=True).ok
    found = spark.table(table)
    assert [f.dataType.simpleString() for f in found.schema.fields] == ["double", "string", "bigint"]
    assert rows(found) == [(1.5, "x", None), (2.0, "007", 3), (3.0, "True", 4)]
    (tmp_path / "4.csv").write_text(f"a\n{2**53 + 1}\n")
    with pytest.raises(InputError, match="2.53"):
        ingest(spark, f"{tmp_path}/4.csv", table, "append", target_types=True)
    assert not ingest(spark, f"{tmp_path}/3.csv", table, "append").ok


def test_names_are_quoted_everywhere(spark, schema):
    table, ctl = f"{schema}.`order`", f"{schema}.`table`"
    path = land_csv(spark.createDataFrame([(1, "x")], "a int, b string"), "quoted")
    for _ in range(2):
        assert ingest(spark, path, table, "append", control_table=ctl).ok
    assert spark.table(table).count() == spark.table(ctl).count() == 2


def test_refused_load_leaves_no_rows_behind(spark, schema, tmp_path, monkeypatch):
    from pathlib import Path

    import lakeload.session as session

    monkeypatch.setattr(session, "_LOCAL_BASE", str(tmp_path))
    (tmp_path / "x.csv").write_text('a,b\n1,"x\ny"\n3,4,,5\n')
    with pytest.raises(InputError, match="more fields"):
        ingest(spark, f"{tmp_path}/x.csv", f"{schema}.t")
    assert not list(Path(tmp_path).glob("lakeload/*"))


def _folders(schema, tmp_path):
    return sorted(p.name.split(".v-")[0] for p in (tmp_path / "wh").iterdir())


def test_failed_overwrite_changes_nothing(spark, schema, tmp_path, rows):
    from pyspark.sql import functions as F

    table = f"{schema}.t"
    save_table(_df(spark, [(k, "old") for k in range(50)], "k int, v string"), table)
    before = rows(spark.table(table))
    bad = spark.range(100).repartition(4).select(
        F.col("id").cast("int").alias("k"), F.expr("if(id = 99, raise_error('broken'), 'new')").alias("v"), F.lit(1).alias("n")
    )
    for _ in range(2):
        result = save_table(bad, table, "overwrite")
        assert not result.ok and "broken" in result.message
        assert rows(spark.table(table)) == before and spark.table(table).columns == ["k", "v"]
        assert _folders(schema, tmp_path) == ["t"]
    for k in range(3):
        assert save_table(_df(spark, [(k,)], "K smallint"), table, "overwrite").n_rows == 1
        assert rows(spark.table(table)) == [(k, None)] and _folders(schema, tmp_path) == ["t"]
    spark.sql(f"DROP TABLE {table}")
    assert _folders(schema, tmp_path) == []
    assert save_table(_df(spark, [(7,)], "k int"), table).ok


def test_readers_see_old_or_new_rows(spark, schema):
    import threading

    table, seen, stop = f"{schema}.t", set(), threading.Event()
    save_table(spark.range(1000).repartition(8), table)

    def read():
        while not stop.is_set():
            try:
                seen.add(spark.table(table).count())
            except Exception as error:  # the files it planned to read are gone; it may read again
                assert "FILE_NOT_EXIST" in str(error) or "does not exist" in str(error), error

    reader = threading.Thread(target=read)
    reader.start()
    for size in (2000, 1000, 2000):
        assert save_table(spark.range(size).repartition(8), table, "overwrite").ok
    stop.set()
    reader.join()
    assert seen <= {1000, 2000} and seen


def test_a_table_can_be_overwritten_by_its_own_rows(spark, schema, rows):
    table = f"{schema}.t"
    save_table(_df(spark, [(1, "x"), (2, "y")], "a int, b string"), table)
    assert save_table(spark.table(table).where("a = 2"), table, "overwrite").n_rows == 1
    assert rows(spark.table(table)) == [(2, "y")]


def test_other_tables_are_overwritten_in_place(spark, schema, tmp_path, rows):
    df = _df(spark, [(1, "x")], "a int, p string")
    df.write.partitionBy("p").saveAsTable(f"{schema}.parts")
    df.write.option("path", f"{tmp_path}/own").saveAsTable(f"{schema}.own")
    for name in ("parts", "own"):
        assert save_table(_df(spark, [(2, "y")], "a int, p string"), f"{schema}.{name}", "overwrite").ok
        assert rows(spark.table(f"{schema}.{name}").select("a", "p")) == [(2, "y")]
    assert spark.read.parquet(f"{tmp_path}/own").count() == 1
