"""The one-off load: read, clean, write, record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.functions.names import file_format, landed_file_name, table_names, uploaded_file_name
from lakeload.operators.cleaning import CleanTable, clean_raw
from lakeload.operators.control import create_control_table, record_load
from lakeload.functions.times import load_timestamp
from lakeload.operators.tables import LoadResult, check_mode, save_table, table_types, target_parts
from lakeload.plans.recovery import DONE, UNDONE, begin_load, end_load
from lakeload.session import remove_folders
from lakeload.sources.dispatch import read_raw
from lakeload.sources.listing import Paths, as_list, plain_path


def prepare(
    spark: SparkSession,
    paths: Paths,
    sheet: str | int | None = 0,
    missing_text: str | None = None,
    encoding: str = "UTF-8",
    target: dict[str, str] | None = None,
) -> CleanTable:
    """Read and clean an input; the frame is lazy, its counts are known.

    Columns are matched by their normalised names, file by file. Call
    ``remove_folders(spark, cleaned.stored)`` when the frame is done with.
    """
    raw = read_raw(spark, paths, sheet, naming=table_names, encoding=encoding)
    try:
        return clean_raw(raw, missing_text, target)
    except BaseException:
        remove_folders(spark, raw.stored)
        raise


def ingest(
    spark: SparkSession,
    paths: Paths,
    table: str,
    mode: str = "overwrite",
    sheet: str | int | None = 0,
    *,
    landed: bool = False,
    control_table: str | None = None,
    table_format: str = "parquet",
    missing_text: str | None = None,
    inserted_by: str | None = None,
    dh_insertion: str | None = None,
    encoding: str = "UTF-8",
    target_types: bool = False,
    recoverable: bool = False,
) -> LoadResult:
    """Load files into a table and record the load.

    Wrong arguments and unreadable inputs raise; a failed write is returned.
    ``landed`` says that the path is the landed copy of a link: its first
    sheet is read and the path is kept as ``transient``. The control row of
    several paths is named after the first; user and time are the current ones
    unless given. ``encoding`` is that of CSV files. With ``target_types`` cells
    take the types of the table where these can hold them (see ``clean_raw``).
    With ``recoverable`` the load is written down before its data, so that
    ``recover_loads`` can complete or undo it after a stop (see ``plans.recovery``).
    """
    check_mode(mode)
    listed = as_list(paths)
    if not listed or any(not path or path.strip().lower() == "none" for path in listed):
        raise ValueError("no source path given")
    target_parts(spark, table)
    sheet = 0 if landed else sheet
    target = table_types(spark, table) if target_types else None
    if recoverable and control_table is None:
        raise ValueError("a recoverable load needs a control table")
    cleaned = prepare(spark, paths, sheet, missing_text, encoding, target)
    load_id, values = None, {}
    try:
        if control_table is not None:
            planned = LoadResult(True, "", cleaned.n_rows, cleaned.n_columns)
            values = control_values(
                spark, table, listed[0], mode, planned, sheet=sheet, landed=landed,
                inserted_by=inserted_by, dh_insertion=dh_insertion,
            )
        if recoverable:
            values["dh_insertion"] = dh_insertion or spark.range(1).select(load_timestamp()).first()[0]
            load_id = begin_load(spark, control_table, table, table_format, **values)
        result = save_table(cleaned.frame, table, mode, table_format)
    finally:
        remove_folders(spark, cleaned.stored)
    if result.ok and control_table is not None:
        create_control_table(spark, control_table, table_format)
        record_load(spark, control_table, **{**values, "n_rows": result.n_rows, "n_columns": result.n_columns})
    if load_id is not None:
        end_load(spark, control_table, load_id, DONE if result.ok else UNDONE)
    return result


def control_values(
    spark: SparkSession,
    table: str,
    path: str,
    mode: str,
    result: LoadResult,
    *,
    sheet: str | int | None = 0,
    landed: bool = False,
    inserted_by: str | None = None,
    dh_insertion: str | None = None,
) -> dict[str, Column | str | int | None]:
    """The values of the control row of a load, named after ``path``."""
    catalog, schema, name = target_parts(spark, table)
    # A link's name is taken from the whole path, an upload's from its last part.
    source = plain_path(path)
    named = F.lit(source if landed else source.rstrip("/").rsplit("/", 1)[-1])
    return {
        "inserted_by": inserted_by,
        "db_catalog": catalog,
        "db_schema": schema,
        "db_table": name,
        "insert_mode": mode,
        "transient": source if landed else None,
        "file_name": landed_file_name(named) if landed else uploaded_file_name(named),
        "file_format": file_format(named),
        "sheet": sheet if isinstance(sheet, str) and sheet else None,
        "n_rows": result.n_rows,
        "n_columns": result.n_columns,
        "dh_insertion": dh_insertion,
    }


def record_ingest(
    spark: SparkSession,
    control_table: str,
    table: str,
    path: str,
    mode: str,
    result: LoadResult,
    *,
    landed: bool = False,
    table_format: str = "parquet",
) -> None:
    """Write the control row of a load that worked, named after ``path``."""
    create_control_table(spark, control_table, table_format)
    record_load(spark, control_table, **control_values(spark, table, path, mode, result, landed=landed))


def stored(spark: SparkSession, result: LoadResult, table: str) -> DataFrame:
    """The table after a load that has to have worked."""
    if not result.ok:
        raise RuntimeError(result.message)
    return spark.table(table)
