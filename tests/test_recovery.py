"""Loads that stop between their writes."""

import pytest

from lakeload.operators.tables import save_table
from lakeload.plans import ingest as ingest_module
from lakeload.plans.ingest import ingest
from lakeload.plans.recovery import open_loads, recover_loads


class Stop(BaseException):
    """As when the process ends."""


@pytest.fixture
def feed(spark, schema, tmp_path):
    def load(text, mode="append", name="f", **options):
        path = tmp_path / f"{name}.csv"
        path.write_text(text)
        return ingest(
            spark, str(path), f"{schema}.t", mode, control_table=f"{schema}.ctl", recoverable=True, **options
        )

    return load


def _stop_at(monkeypatch, name):
    def stop(*args, **kwargs):
        raise Stop

    monkeypatch.setattr(ingest_module, name, stop)


def _loads(spark, schema):
    return sorted((r.n_rows, r.insert_mode) for r in spark.table(f"{schema}.ctl").collect())


def _recover(spark, schema):
    return [r.state for r in recover_loads(spark, f"{schema}.ctl").collect()]


def test_loads_that_end_need_no_recovery(spark, schema, feed, rows):
    assert feed("a\n1\n").ok and feed("a\n2\n").ok and not feed("a\nx\n").ok
    assert _recover(spark, schema) == [] and rows(spark.table(f"{schema}.t")) == [(1,), (2,)]
    assert _loads(spark, schema) == [(1, "append"), (1, "append")]
    with pytest.raises(ValueError, match="control table"):
        ingest(spark, "x.csv", f"{schema}.t", recoverable=True)


@pytest.mark.parametrize("mode", ["append", "overwrite"])
@pytest.mark.parametrize("first", [True, False])
@pytest.mark.parametrize(("step", "state"), [("save_table", "undone"), ("record_load", "completed"), ("end_load", "completed")])
def test_a_stopped_load_is_completed_or_undone(spark, schema, feed, rows, monkeypatch, mode, first, step, state):
    if not first:
        assert feed("a\n1\n", mode).ok
    before = [] if first else [(1,)]
    with monkeypatch.context() as patch, pytest.raises(Stop):
        _stop_at(patch, step)
        feed("a\n2\n3\n", mode)
    assert len(open_loads(spark, f"{schema}.ctl")) == 1
    assert _recover(spark, schema) == [state] and _recover(spark, schema) == []
    if state == "undone":
        want = before
    else:
        want = [(2,), (3,)] if mode == "overwrite" else [*before, (2,), (3,)]
    assert (rows(spark.table(f"{schema}.t")) if want else []) == want
    assert len(_loads(spark, schema)) == len(before) + (state == "completed")
    # the load can be made again
    assert feed("a\n4\n", mode).ok
    assert (4,) in rows(spark.table(f"{schema}.t"))


def test_half_an_append_is_undone(spark, schema, tmp_path, feed, rows, monkeypatch):
    assert feed("a\n1\n").ok
    with monkeypatch.context() as patch, pytest.raises(Stop):
        _stop_at(patch, "record_load")
        feed("a\n2\n3\n4\n")
    extra = spark.createDataFrame([(5,), (6,)], "A bigint")
    # as if only some of the files of the load had been moved into the table
    table = f"{schema}.t"
    assert save_table(extra, table, "append").ok
    assert _recover(spark, schema) == ["undone"]
    assert rows(spark.table(table)) == [(1,)] and len(_loads(spark, schema)) == 1


def test_a_broken_overwrite_in_place_is_told(spark, schema, tmp_path, feed, monkeypatch):
    table = f"{schema}.t"
    spark.createDataFrame([(1, "p")], "A bigint, P string").write.partitionBy("P").saveAsTable(table)
    with monkeypatch.context() as patch, pytest.raises(Stop):
        _stop_at(patch, "record_load")
        feed("a,p\n1,x\n2,y\n", "overwrite")
    assert save_table(spark.createDataFrame([(9, "z")], "A bigint, P string"), table, "append").ok
    assert _recover(spark, schema) == ["repeat"]
