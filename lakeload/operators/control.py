"""The control table: one row per load, and the latest load of each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeload.functions.times import load_timestamp
from lakeload.operators.tables import full_name, write_table

# Columns of the control table, in order.
CONTROL_SCHEMA = T.StructType(
    [
        T.StructField("inserted_by", T.StringType()),
        T.StructField("db_catalog", T.StringType()),
        T.StructField("db_schema", T.StringType()),
        T.StructField("db_table", T.StringType()),
        T.StructField("insert_mode", T.StringType()),
        T.StructField("transient", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("file_format", T.StringType()),
        T.StructField("sheet", T.StringType()),
        # A load may have more rows than an INT can count.
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_columns", T.IntegerType()),
        T.StructField("dh_insertion", T.StringType()),
    ]
)


def create_control_table(spark: SparkSession, table: str, table_format: str = "parquet") -> None:
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CONTROL_SCHEMA)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {full_name(spark, table)} ({columns}) USING {table_format}"
    )


def control_row(spark: SparkSession, **values: Column | str | int | None) -> DataFrame:
    """One typed row; user and time are filled in unless given."""
    unknown = set(values) - set(CONTROL_SCHEMA.names)
    if unknown:
        raise ValueError(f"not control columns: {sorted(unknown)}")
    filled = {"inserted_by": F.current_user(), "dh_insertion": load_timestamp()}
    given = {name: F.lit(value) for name, value in values.items() if value is not None}
    columns = {**filled, **given}
    return spark.range(1).select(
        *[
            columns.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
            for field in CONTROL_SCHEMA
        ]
    )


def record_load(spark: SparkSession, table: str, **values: Column | str | int | None) -> None:
    """Append one row about a successful load, in the types the table has."""
    schema = spark.table(full_name(spark, table)).schema
    types = {f.name.lower(): f.dataType for f in schema.fields}
    row = control_row(spark, **values)
    row = row.select(*[F.col(name).cast(types.get(name, kind)) for name, kind in _column_types()])
    write_table(row, table, "append")


def _column_types() -> list[tuple[str, T.DataType]]:
    return [(field.name, field.dataType) for field in CONTROL_SCHEMA]


def load_status(loads: DataFrame) -> DataFrame:
    """The latest recorded load of every table.

    The maximum of whole rows, ordered by time first, is merged before the
    shuffle: a table with very many loads is no larger a group than others.
    Times have no seconds; of loads in one minute the one with more rows counts.
    """
    key = ["db_catalog", "db_schema", "db_table"]
    rest = [name for name in CONTROL_SCHEMA.names if name not in (*key, "dh_insertion")]
    rest = ["n_rows", *(name for name in rest if name != "n_rows")]
    latest = F.max(F.struct("dh_insertion", *rest)).alias("latest")
    return (
        loads.groupBy(*key)
        .agg(latest)
        .select(*key, *[f"latest.{name}" for name in ("dh_insertion", *rest)])
        .select(*CONTROL_SCHEMA.names)
    )
