"""Recurring loads from a landing folder."""

import pytest

from lakeload.streaming.incremental import ingest_new_files


def _land(tmp_path, name, content):
    folder = tmp_path / "landing" / name.rsplit(".", 1)[0]
    folder.mkdir(parents=True)
    (folder / name).write_text(content)


def _run(spark, tmp_path, table, mode="append", **options):
    return ingest_new_files(
        spark, f"{tmp_path}/landing", table, mode, checkpoint=f"{tmp_path}/checkpoint", **options
    )


def test_append_takes_new_files_once(spark, schema, tmp_path, rows):
    table, ctl = f"{schema}.t", f"{schema}.ctl"
    _land(tmp_path, "1.csv", "a,b\n1,x\n2,y\n")
    _land(tmp_path, "note.txt", "not a source")
    first = _run(spark, tmp_path, table, control_table=ctl)
    assert [(r.ok, r.n_rows) for r in first] == [(False, None), (True, 2)]
    assert "note.txt" in first[0].message
    assert _run(spark, tmp_path, table, control_table=ctl) == []
    _land(tmp_path, "2.csv", "b,a,c\nz,3,-\n")
    _land(tmp_path, "[3].csv", "a,b\n4,w\n")
    assert [r.n_rows for r in _run(spark, tmp_path, table, control_table=ctl)] == [2]
    assert rows(spark.table(table)) == [(1, "x"), (2, "y"), (3, "z"), (4, "w")]
    assert spark.table(ctl).count() == 2


def test_overwrite_keeps_the_last_file(spark, schema, tmp_path, rows):
    table = f"{schema}.t"
    _land(tmp_path, "1.csv", "a\n1\n")
    _run(spark, tmp_path, table, "overwrite")
    _land(tmp_path, "2.csv", "a\n2\n")
    results = _run(spark, tmp_path, table, "overwrite")
    assert [r.n_rows for r in results] == [1]
    assert rows(spark.table(table)) == [(2,)]


def test_replayed_batch_is_skipped(spark, schema, tmp_path, rows):
    """A new checkpoint sees all files again, as after a crash before the commit."""
    table, ctl = f"{schema}.t", f"{schema}.ctl"
    _land(tmp_path, "[1].csv", "a\n1\n")
    _run(spark, tmp_path, table, control_table=ctl)
    assert spark.table(ctl).first().transient.endswith("/[1]/[1].csv")
    again = ingest_new_files(
        spark, f"{tmp_path}/landing", table, checkpoint=f"{tmp_path}/other", control_table=ctl
    )
    assert again == [] and rows(spark.table(table)) == [(1,)]


def test_batch_column_makes_a_replay_replace(spark, schema, tmp_path, rows):
    table = f"{schema}.t"
    _land(tmp_path, "1.csv", "a\n1\n")
    _run(spark, tmp_path, table, batch_column="load_batch")
    _land(tmp_path, "2.csv", "a,b\n2,x\n")
    _run(spark, tmp_path, table, batch_column="load_batch")
    # Take the last batch back from the checkpoint: it is run once more.
    (tmp_path / "checkpoint" / "commits" / "1").unlink()
    (tmp_path / "checkpoint" / "commits" / ".1.crc").unlink()
    assert len(_run(spark, tmp_path, table, batch_column="load_batch")) == 1
    assert rows(spark.table(table).select("a", "b")) == [(1, None), (2, "x")]
    with pytest.raises(ValueError, match="batch_column"):
        _run(spark, tmp_path, table, "overwrite", batch_column="load_batch")


def test_refused_batch_stops_the_run(spark, schema, tmp_path):
    table = f"{schema}.t"
    _land(tmp_path, "1.csv", "a\n1\n")
    _run(spark, tmp_path, table)
    _land(tmp_path, "2.csv", "a\nx\n")
    with pytest.raises(Exception, match="conflict"):
        _run(spark, tmp_path, table)
    assert spark.table(table).count() == 1


def test_one_batch_of_several_formats(spark, schema, tmp_path, rows):
    from lakeload.plans.landing import workbook_bytes

    _land(tmp_path, "1.csv", 'a,b\n1,"x\ny"\n')
    (tmp_path / "landing" / "2.XLSX").write_bytes(workbook_bytes({"S": [["a", "b"], [2, "z"]]}))
    spark.createDataFrame([(3, "w")], "a int, b string").write.parquet(f"{tmp_path}/landing/3")
    _run(spark, tmp_path, f"{schema}.t")
    assert rows(spark.table(f"{schema}.t")) == [(1, "x\ny"), (2, "z"), (3, "w")]


def _other(spark, tmp_path, table, ctl, name="other", **options):
    return ingest_new_files(
        spark, f"{tmp_path}/landing", table, checkpoint=f"{tmp_path}/{name}", control_table=ctl, **options
    )


def test_each_file_is_taken_once_whatever_its_name_or_age(spark, schema, tmp_path, rows):
    import os

    table, ctl = f"{schema}.t", f"{schema}.ctl"
    _land(tmp_path, "1.csv", "a\n1\n")
    _run(spark, tmp_path, table, control_table=ctl)
    _land(tmp_path, "0.csv", "a\n0\n")
    _land(tmp_path, "2.csv", "a\n2\n")
    os.utime(tmp_path / "landing" / "2" / "2.csv", (10**9, 10**9))
    assert [r.n_rows for r in _other(spark, tmp_path, table, ctl)] == [2]
    assert rows(spark.table(table)) == [(0,), (1,), (2,)]
    _land(tmp_path, "3.csv", "a\n3\n")
    os.utime(tmp_path / "landing" / "3" / "3.csv", (10**9, 10**9))
    _run(spark, tmp_path, table, control_table=ctl)
    assert rows(spark.table(table)) == [(0,), (1,), (2,), (3,)]


def test_batches_do_not_change_the_result(spark, schema, tmp_path, rows):
    _land(tmp_path, "1.csv", "Código,b\n1,x\n")
    _land(tmp_path, "2.csv", "CODIGO,B\n2,y\n")
    for size, table in ((1, f"{schema}.one"), (1000, f"{schema}.all")):
        _other(spark, tmp_path, table, None, f"c{size}", files_per_batch=size)
        assert spark.table(table).columns == ["CODIGO", "B"]
        assert rows(spark.table(table)) == [(1, "x"), (2, "y")]


def test_overwrite_reads_the_newest_file_only(spark, schema, tmp_path, rows):
    table, ctl = f"{schema}.t", f"{schema}.ctl"
    _land(tmp_path, "1.csv", "a\n1,2,3\n")
    _land(tmp_path, "2.csv", "a\n2\n")
    import os

    os.utime(tmp_path / "landing" / "1" / "1.csv", (10**9, 10**9))
    assert [r.n_rows for r in _run(spark, tmp_path, table, "overwrite", control_table=ctl)] == [1]
    assert rows(spark.table(table)) == [(2,)]
    again = _other(spark, tmp_path, table, ctl, mode="overwrite")
    assert again == [] and rows(spark.table(table)) == [(2,)]


def test_batch_column_keeps_its_control_row(spark, schema, tmp_path):
    table, ctl = f"{schema}.t", f"{schema}.ctl"
    _land(tmp_path, "1.csv", "a\n1\n")
    _run(spark, tmp_path, table, batch_column="load_batch", control_table=ctl)
    assert [r.n_rows for r in spark.table(ctl).collect()] == [1]
    assert _other(spark, tmp_path, table, ctl, batch_column="load_batch") == []


def _reland(tmp_path, name, content, time):
    import os

    path = tmp_path / "landing" / name
    path.parent.mkdir(exist_ok=True)
    path.write_text(content)
    os.utime(path, (time, time))


@pytest.mark.parametrize("control", [True, False])
def test_a_link_that_lands_again_is_loaded_again(spark, schema, tmp_path, rows, control):
    ctl = f"{schema}.ctl" if control else None
    kept, last = f"{schema}.kept", f"{schema}.last"
    for version in (1, 2, 3):
        _reland(tmp_path, "Plan.csv", f"a\n{version}\n", 10**9 + version)  # same length each time
        for _ in range(2):
            _run(spark, tmp_path, kept, control_table=ctl)
            _other(spark, tmp_path, last, ctl, mode="overwrite")
    assert rows(spark.table(kept)) == [(1,), (2,), (3,)] and rows(spark.table(last)) == [(3,)]
    if control:
        assert _other(spark, tmp_path, kept, ctl, "lost") == []
        assert spark.table(f"{ctl}_files").count() == 6


def test_a_version_of_the_same_time_and_another_length_is_another(spark, schema, tmp_path, rows):
    for text in ("a\n1\n", "a\n1\n2\n"):
        _reland(tmp_path, "Plan.csv", text, 10**9)
        _run(spark, tmp_path, f"{schema}.t")
    assert rows(spark.table(f"{schema}.t")) == [(1,), (1,), (2,)]


def test_a_replaced_version_is_told_not_read_twice(spark, schema, tmp_path, rows):
    """The run that listed the first version stopped before it was read."""
    from lakeload.streaming.incremental import listed_versions, log_versions

    _reland(tmp_path, "Plan.csv", "a\n1\n", 10**9)
    log_versions(spark, listed_versions(spark, f"{tmp_path}/landing"), f"{tmp_path}/checkpoint/versions", 10)
    _reland(tmp_path, "Plan.csv", "a\n2\n", 10**9 + 5)
    results = _run(spark, tmp_path, f"{schema}.t")
    assert sorted((r.ok, r.n_rows) for r in results) == [(False, None), (True, 1)]
    assert rows(spark.table(f"{schema}.t")) == [(2,)]


def test_rows_of_paths_only_stand_for_any_version(spark, schema, tmp_path):
    table, ctl = f"{schema}.t", f"{schema}.ctl"
    _reland(tmp_path, "Plan.csv", "a\n1\n", 10**9)
    catalog, path = spark.catalog.currentCatalog(), f"file:{tmp_path}/landing/Plan.csv"
    old = [(catalog, schema, "t", "b", path)]
    names = "db_catalog string, db_schema string, db_table string, batch string, path string"
    spark.createDataFrame(old, names).write.saveAsTable(f"{ctl}_files")
    assert _run(spark, tmp_path, table, control_table=ctl) == []
    _reland(tmp_path, "Other.csv", "a\n1\n", 10**9)
    assert [r.n_rows for r in _run(spark, tmp_path, table, control_table=ctl)] == [1]
    assert spark.table(f"{ctl}_files").where("modificationTime IS NOT NULL").count() == 1


def test_an_empty_folder_loads_nothing(spark, schema, tmp_path):
    (tmp_path / "landing").mkdir()
    assert _run(spark, tmp_path, f"{schema}.t") == []
