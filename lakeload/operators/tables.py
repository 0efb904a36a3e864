"""Write a frame to a catalog table: overwrite, append, schema merge.

Neither mode ever removes or retypes a column. The table format is a
parameter. A format with transactions overwrites as it does. A managed table of
plain Parquet or ORC files is overwritten beside its rows: the new rows are
written to a folder of their own, and when they are complete the catalog is told
that the table lies there, in one step, and the old folder goes. Readers see the
old rows or the new ones, also while an overwrite runs and after one that
failed; one that has not finished reading the old files when they go fails and
can read again. Partitioned, bucketed and external tables are overwritten in
place, as their files cannot move in one step. A load is not one change
together with its control row.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeload.functions.names import qualified_name, quoted
from lakeload.session import remove_folders

# The write modes.
WRITE_MODES = ("overwrite", "append")

_WIDENS = {
    "tinyint": {"smallint", "int", "bigint"},
    "smallint": {"int", "bigint"},
    "int": {"bigint"},
    "float": {"double"},
}


@dataclass(frozen=True)
class LoadResult:
    """Outcome of a load; a failed write is told, not raised."""

    ok: bool
    message: str
    n_rows: int | None = None
    n_columns: int | None = None


def target_parts(spark: SparkSession, table: str) -> tuple[str, str, str]:
    """Catalog, schema and table of a dotted or back-quoted name."""
    if not table or table.strip().lower() in ("", "none"):
        raise ValueError("no target table given")
    parts = _split_name(table)
    if len(parts) > 3 or not all(part.strip() for part in parts):
        raise ValueError(f"not a catalog.schema.table name: {table!r}")
    current = [spark.catalog.currentCatalog(), spark.catalog.currentDatabase()]
    return tuple(current[: 3 - len(parts)] + parts)


def _split_name(name: str) -> list[str]:
    """Split at the dots outside back quotes."""
    parts, quoted_part = [""], False
    for piece in name.split("`"):
        if quoted_part:
            parts[-1] += piece
        else:
            first, *others = piece.split(".")
            parts[-1] += first
            parts += others
        quoted_part = not quoted_part
    return parts


def full_name(spark: SparkSession, table: str) -> str:
    """The name with its catalog and schema, back-quoted for use in SQL."""
    return qualified_name(*target_parts(spark, table))


def check_mode(mode: str) -> None:
    if mode not in WRITE_MODES:
        raise ValueError(f"mode must be one of {', '.join(WRITE_MODES)}, not {mode!r}")


def table_types(spark: SparkSession, table: str) -> dict[str, str]:
    """Types of a table by lower-case column name; none if there is no table yet."""
    name = full_name(spark, table)
    if not spark.catalog.tableExists(name):
        return {}
    return {field.name.lower(): field.dataType.simpleString() for field in spark.table(name).schema.fields}


def new_columns(table: T.StructType, incoming: T.StructType) -> list[T.StructField]:
    """Incoming columns that the table lacks, by case-insensitive name."""
    known = {field.name.lower() for field in table.fields}
    return [field for field in incoming.fields if field.name.lower() not in known]


def type_conflicts(table: T.StructType, incoming: T.StructType) -> list[str]:
    """Columns whose incoming type the table's type cannot hold as it is."""
    known = {field.name.lower(): field.dataType.simpleString() for field in table.fields}
    conflicts = []
    for field in incoming.fields:
        have, want = field.dataType.simpleString(), known.get(field.name.lower())
        if want is not None and have != want and want not in _WIDENS.get(have, ()):
            conflicts.append(f"{field.name}: {have} into {want}")
    return conflicts


def _refuse_conflicts(table: T.StructType, incoming: T.StructType) -> None:
    conflicts = type_conflicts(table, incoming)
    if conflicts:
        raise ValueError("type conflict with the table: " + "; ".join(conflicts))


def merge_schema(spark: SparkSession, table: str, incoming: T.StructType) -> None:
    """Add the columns that the table lacks; refuse conflicting types first."""
    table = full_name(spark, table)
    current = spark.table(table).schema
    _refuse_conflicts(current, incoming)
    added = new_columns(current, incoming)
    if added:
        columns = ", ".join(f"{quoted(f.name)} {_ddl_type(f.dataType)}" for f in added)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({columns})")


def _ddl_type(data_type: T.DataType) -> str:
    """The type as DDL text, with quoted names inside structures."""
    if isinstance(data_type, T.StructType):
        return f"STRUCT<{', '.join(f'{quoted(f.name)}: {_ddl_type(f.dataType)}' for f in data_type)}>"
    if isinstance(data_type, T.ArrayType):
        return f"ARRAY<{_ddl_type(data_type.elementType)}>"
    if isinstance(data_type, T.MapType):
        return f"MAP<{_ddl_type(data_type.keyType)}, {_ddl_type(data_type.valueType)}>"
    return data_type.simpleString()


def write_table(
    df: DataFrame, table: str, mode: str = "overwrite", table_format: str = "parquet"
) -> None:
    """Overwrite or append by column name; columns not given become null."""
    check_mode(mode)
    spark = df.sparkSession
    table = full_name(spark, table)
    if not spark.catalog.tableExists(table):
        df.write.format(table_format).saveAsTable(table)
        return
    place = movable(spark, table) if mode == "overwrite" else None
    if place is not None:
        _overwrite_beside(df, table, *place)
        return
    merge_schema(spark, table, df.schema)
    verb = "OVERWRITE" if mode == "overwrite" else "INTO"
    spark.sql(f"INSERT {verb} {table} BY NAME SELECT * FROM {{rows}}", rows=df)


# Formats whose files tell their columns, so that a folder of them is all there is to a table.
_PLAIN_FORMATS = ("parquet", "orc")
_STAGED = re.compile(r"\.v-[0-9a-f]{12}$")


def movable(spark: SparkSession, table: str) -> tuple[str, str] | None:
    """Format and folder of a table whose rows may lie elsewhere after a write; None for others."""
    told = {row.col_name: row.data_type for row in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    plain = told.get("Type") == "MANAGED" and told.get("Provider", "").lower() in _PLAIN_FORMATS
    if not plain or "# Partition Information" in told or "Num Buckets" in told:
        return None
    return told["Provider"].lower(), told["Location"]


def _overwrite_beside(df: DataFrame, table: str, table_format: str, folder: str) -> None:
    """Write all rows to a new folder, then let the table lie there and remove the old one."""
    spark = df.sparkSession
    current = spark.table(table).schema
    _refuse_conflicts(current, df.schema)
    given = {field.name.lower(): quoted(field.name) for field in df.schema.fields}
    fields = [*current.fields, *new_columns(current, df.schema)]
    columns = [
        (F.col(given[f.name.lower()]) if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in fields
    ]
    staged = f"{_STAGED.sub('', folder)}.v-{uuid.uuid4().hex[:12]}"
    try:
        df.select(*columns).write.format(table_format).save(staged)
        merge_schema(spark, table, df.schema)
        place = staged.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{place}'")
    except BaseException:
        remove_folders(spark, [staged])
        raise
    spark.catalog.refreshTable(table)
    remove_folders(spark, [folder])


def save_table(
    df: DataFrame, table: str, mode: str = "overwrite", table_format: str = "parquet"
) -> LoadResult:
    """Write and count in the same pass; the outcome is returned, not raised."""
    seen = Observation()
    try:
        write_table(df.observe(seen, F.count(F.lit(1)).alias("n_rows")), table, mode, table_format)
    except Exception as error:
        return LoadResult(False, f"{table} was not saved: {error}")
    return LoadResult(True, f"{table} saved", seen.get["n_rows"], len(df.columns))


def replace_batch(
    df: DataFrame, table: str, batch_column: str, batch: str, table_format: str = "parquet"
) -> None:
    """Write one batch as its own partition, in place of an earlier try of it."""
    spark = df.sparkSession
    table = full_name(spark, table)
    if not spark.catalog.tableExists(table):
        marked = df.withColumn(batch_column, F.lit(batch))
        marked.write.format(table_format).partitionBy(batch_column).saveAsTable(table)
        return
    merge_schema(spark, table, df.schema)
    spark.sql(
        f"INSERT OVERWRITE {table} PARTITION ({quoted(batch_column)} = :batch) BY NAME"
        " SELECT * FROM {rows}",
        args={"batch": batch},
        rows=df,
    )
