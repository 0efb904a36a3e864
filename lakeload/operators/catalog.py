"""Names in the catalog that a load can target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.functions.names import qualified_name

# Names that are not offered as targets.
HIDDEN_CATALOG_PREFIX = "__"
HIDDEN_SCHEMAS = ("default", "information_schema")


def list_catalogs(spark: SparkSession, hidden: Sequence[str] = ()) -> DataFrame:
    """Catalogs that can be targets; ``hidden`` are further names to leave out."""
    name = F.col("catalog")
    return spark.sql("SHOW CATALOGS").where(
        ~name.startswith(HIDDEN_CATALOG_PREFIX) & ~name.isin(*hidden)
    )


def list_schemas(
    spark: SparkSession, catalog: str, hidden: Sequence[str] = HIDDEN_SCHEMAS
) -> DataFrame:
    found = spark.sql(f"SHOW SCHEMAS IN {qualified_name(catalog)}")
    name = found.columns[0]
    return found.select(F.col(name).alias("schema")).where(~F.col("schema").isin(*hidden))


def list_tables(spark: SparkSession, catalog: str, schema: str) -> DataFrame:
    found = spark.sql(f"SHOW TABLES IN {qualified_name(catalog, schema)}")
    return found.where("NOT isTemporary").select(F.col("tableName").alias("table"))


def current_user(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.current_user().alias("user"))
