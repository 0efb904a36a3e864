"""Loads that can be completed or undone after a stop between their writes.

Data and control row are two writes. A recoverable load says beforehand, in a
journal beside the control table, what it is going to do and how the table and
the control table stand; afterwards it says that it is done. A pass over the
loads that began and were never done compares that with what there is now:

- the rows are in the table: the control row is written, unless it is there;
- they are not: what the load has left behind is removed;
- an append stopped halfway: its files, which are those newer than any before,
  are removed, and the table has its earlier rows again;
- an overwrite in place stopped halfway: it is told, as only loading again helps.

A table must have one load at a time, and none while the pass runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeload.functions.names import qualified_name
from lakeload.operators.control import CONTROL_SCHEMA, control_row, create_control_table, record_load
from lakeload.operators.tables import full_name, movable, target_parts, write_table
from lakeload.session import remove_folders
from lakeload.sources.listing import escape_glob

BEGUN, DONE, UNDONE, REPEAT = "begun", "completed", "undone", "repeat"

JOURNAL_SCHEMA = T.StructType(
    [
        T.StructField("load_id", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("target", T.StringType()),
        # How things stood: folder (none without a table), rows, newest file, equal control rows.
        T.StructField("folder", T.StringType()),
        T.StructField("moves", T.BooleanType()),
        T.StructField("rows_before", T.LongType()),
        T.StructField("newest", T.TimestampType()),
        T.StructField("recorded", T.LongType()),
        T.StructField("control", CONTROL_SCHEMA),
    ]
)


def journal_table(spark: SparkSession, control_table: str) -> str:
    catalog, schema, name = target_parts(spark, control_table)
    return qualified_name(catalog, schema, f"{name}_journal")


def _folder(spark: SparkSession, table: str) -> str:
    told = {row.col_name: row.data_type for row in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    return told["Location"]


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(escape_glob(folder))
    return files.select("path", "modificationTime")


def _recorded(spark: SparkSession, control_table: str, row: Row) -> int:
    """Control rows that equal ``row``."""
    rows = spark.table(full_name(spark, control_table))
    for name in CONTROL_SCHEMA.names:
        rows = rows.where(F.col(name).eqNullSafe(F.lit(row[name])))
    return rows.count()


def begin_load(spark: SparkSession, control_table: str, table: str, table_format: str = "parquet", **control) -> str:
    """Write down a load before its data; ``control`` are the values of its control row. Gives its id."""
    create_control_table(spark, control_table, table_format)
    row = control_row(spark, **control).first()
    name, load_id = full_name(spark, table), uuid.uuid4().hex
    folder = rows = newest = None
    moves = False
    if spark.catalog.tableExists(name):
        folder, rows = _folder(spark, name), spark.table(name).count()
        moves = row.insert_mode == "overwrite" and movable(spark, name) is not None
        newest = _files(spark, folder).agg(F.max("modificationTime")).first()[0]
    entry = (load_id, BEGUN, name, folder, moves, rows, newest, _recorded(spark, control_table, row), row)
    begun = spark.createDataFrame([entry], JOURNAL_SCHEMA)
    write_table(begun, journal_table(spark, control_table), "append", table_format)
    return load_id


def end_load(spark: SparkSession, control_table: str, load_id: str, state: str = DONE) -> None:
    entry = spark.createDataFrame([(load_id, state, *[None] * 7)], JOURNAL_SCHEMA)
    write_table(entry, journal_table(spark, control_table), "append")


def open_loads(spark: SparkSession, control_table: str) -> list[Row]:
    """Loads that began and did not end; a handful, as each is one that was stopped."""
    journal = journal_table(spark, control_table)
    if not spark.catalog.tableExists(journal):
        return []
    entries = spark.table(journal)
    ended = entries.where(F.col("state") != BEGUN).select("load_id")
    return entries.where(F.col("state") == BEGUN).join(ended, "load_id", "left_anti").orderBy("load_id").collect()


def _undo_append(spark: SparkSession, load: Row) -> None:
    """Remove the files that are newer than any before the load."""
    files = _files(spark, load.folder)
    new = files if load.newest is None else files.where(F.col("modificationTime") > F.lit(load.newest))
    remove_folders(spark, [row.path for row in new.select("path").collect()])
    spark.catalog.refreshTable(load.target)
    if spark.table(load.target).count() != load.rows_before:
        raise RuntimeError(f"{load.target} has not its rows of before load {load.load_id}")


def _state(spark: SparkSession, load: Row) -> str:
    """What became of the data of a load: in the table, not there, or unknown. Undoes half an append."""
    if not spark.catalog.tableExists(load.target):
        return UNDONE
    spark.catalog.refreshTable(load.target)
    if load.folder is None:
        # a new table is in the catalog when its rows are complete
        return DONE
    if load.moves:
        return DONE if _folder(spark, load.target) != load.folder else UNDONE
    if load.control.insert_mode == "overwrite":
        newest = _files(spark, load.folder).agg(F.max("modificationTime")).first()[0]
        complete = spark.table(load.target).count() == load.control.n_rows
        return DONE if complete and newest != load.newest else UNDONE if newest == load.newest else REPEAT
    rows = spark.table(load.target).count()
    if rows == load.rows_before + load.control.n_rows:
        return DONE
    if rows != load.rows_before:
        _undo_append(spark, load)
    return UNDONE


def recover_loads(spark: SparkSession, control_table: str) -> DataFrame:
    """Complete or undo the loads that were stopped: (load_id, target, state) of each.

    State ``completed``: table and control table have the load; ``undone``: neither
    has; ``repeat``: an overwrite in place is broken and has to be loaded again.
    """
    outcomes = []
    for load in open_loads(spark, control_table):
        state = _state(spark, load)
        if state == DONE and _recorded(spark, control_table, load.control) <= load.recorded:
            values = {k: v for k, v in load.control.asDict().items() if v is not None}
            record_load(spark, control_table, **values)
        end_load(spark, control_table, load.load_id, state)
        outcomes.append((load.load_id, load.target, state))
    return spark.createDataFrame(outcomes, "load_id string, target string, state string")
