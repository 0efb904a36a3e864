"""Recurring loads: a stream over the versions of the files in a landing folder.

A link that is fetched again lands under the same name, so a name alone does not
tell whether a file was loaded. A version is a path with its modification time
and length. Every run lists the folder once and adds the versions that it does
not know to a log beside the checkpoint; the stream reads that log, so that each
version is one row of one batch, and the checkpoint keeps what was done.
"""

from __future__ import annotations

import hashlib
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.functions.names import qualified_name
from lakeload.operators.tables import (
    LoadResult,
    check_mode,
    replace_batch,
    table_types,
    target_parts,
    write_table,
)
from lakeload.plans.ingest import ingest, prepare, record_ingest
from lakeload.session import folder_exists, remove_folders
from lakeload.sources.dispatch import SUFFIXES
from lakeload.sources.listing import escape_glob, suffix_of

# What makes a version of a file, as Spark's file listing tells it.
VERSION = ["path", "modificationTime", "length"]
_VERSION_SCHEMA = "path string, modificationTime timestamp, length bigint"

# Files of one append batch, about; their names, not their contents, reach the driver.
FILES_PER_BATCH = 1000

# The stream would pass over log files that are older than this, so none may be.
NO_AGE_LIMIT = "100000d"

_TARGET = ["db_catalog", "db_schema", "db_table"]


def files_table(spark: SparkSession, control_table: str) -> str:
    """The table beside the control table that names every loaded version of a file."""
    catalog, schema, name = target_parts(spark, control_table)
    return qualified_name(catalog, schema, f"{name}_files")


def _not_recorded(
    spark: SparkSession, batch: DataFrame, control_table: str | None, table: str, own: str | None = None
) -> DataFrame:
    """The versions of a batch that no load of the table, other than batch ``own``, has taken.

    Only the partition of the table is read. Rows without a time are of a
    library that knew paths only; they stand for any version of their path.
    """
    if control_table is None or not spark.catalog.tableExists(files_table(spark, control_table)):
        return batch
    known = spark.table(files_table(spark, control_table))
    for column, value in zip(_TARGET, target_parts(spark, table)):
        known = known.where(F.col(column) == value)
    if own is not None:
        known = known.where(F.col("batch") != own)
    versioned = set(VERSION) <= set(known.columns)
    old = known.where("modificationTime IS NULL") if versioned else known
    left = batch.join(old.select("path"), "path", "left_anti")
    return left.join(known.select(*VERSION), VERSION, "left_anti") if versioned else left


def _record_files(
    spark: SparkSession, control_table: str, table: str, batch: str, taken: DataFrame, table_format: str
) -> None:
    name = files_table(spark, control_table)
    columns = f"batch string, {_VERSION_SCHEMA}, {', '.join(f'{c} string' for c in _TARGET)}"
    partitions = ", ".join(_TARGET)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {table_format} PARTITIONED BY ({partitions})")
    target = dict(zip(_TARGET, map(F.lit, target_parts(spark, table))))
    write_table(taken.withColumns({"batch": F.lit(batch), **target}), name, "append", table_format)


def listed_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The versions that are in the folder now; the listing is made here, once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(*VERSION)


def log_versions(spark: SparkSession, present: DataFrame, log: str, files_per_batch: int) -> bool:
    """Add the versions that the log lacks, about ``files_per_batch`` in a file; tell whether there is a log.

    A run that is stopped here leaves some of them out, which the next one adds.
    """
    known = folder_exists(spark, log)
    new = present
    if known:
        new = present.join(spark.read.schema(_VERSION_SCHEMA).parquet(log), VERSION, "left_anti")
    n = new.count()
    if n:
        ordered = new.repartitionByRange(ceil(n / files_per_batch), "modificationTime", "path")
        ordered.write.mode("append").parquet(log)
    return known or n > 0


def ingest_new_files(
    spark: SparkSession,
    folder: str,
    table: str,
    mode: str = "append",
    *,
    checkpoint: str,
    control_table: str | None = None,
    table_format: str = "parquet",
    missing_text: str | None = None,
    files_per_batch: int = FILES_PER_BATCH,
    batch_column: str | None = None,
    encoding: str = "UTF-8",
    target_types: bool = False,
) -> list[LoadResult]:
    """Load every version of a file that has landed since the last run, then stop.

    The stream carries versions (path, time and length); each batch is an
    ordinary load of its files. A file is taken whatever its age, once in each
    version: one that lands again under its name is loaded again, as a whole. In
    overwrite mode all pending versions are one batch, of which only the newest
    (by time, then name) is read. Files of an unknown suffix, and versions that
    were replaced before a run could read them, are told in a refused result and
    not loaded.

    With a control table every loaded version is kept beside it, so a batch that
    is replayed, or a new checkpoint, only takes those that no load has taken.
    These rows follow the data, so a crash between the two would append twice;
    with ``batch_column`` the table is partitioned by batch and a replay replaces
    its own partition instead. ``encoding`` and ``target_types`` are those of
    ``ingest``. The log of versions is the folder ``versions`` below ``checkpoint``.
    """
    check_mode(mode)
    target_parts(spark, table)
    if batch_column is not None and mode != "append":
        raise ValueError("batch_column is for append loads")
    present = listed_versions(spark, folder)
    log = f"{checkpoint.rstrip('/')}/versions"
    if not log_versions(spark, present, log, files_per_batch):
        return []
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:8]
    results: list[LoadResult] = []

    def load(batch: DataFrame, batch_id: int) -> None:
        known = suffix_of(F.col("path")).isin(*SUFFIXES)
        refused = batch.where(~known).agg(F.count("path").alias("n"), F.min("path").alias("path")).first()
        if refused.n:
            known_suffixes = ", ".join(SUFFIXES)
            message = f"{refused.n} file(s) not loaded, such as {refused.path}; known are {known_suffixes}"
            results.append(LoadResult(False, message))
        files = batch.where(known).join(present, VERSION, "left_semi")
        gone = batch.where(known).join(present, VERSION, "left_anti")
        gone = gone.agg(F.count("path").alias("n"), F.min("path").alias("path")).first()
        if gone.n and mode == "append":
            message = f"{gone.n} version(s) not loaded, as they were replaced before, such as of {gone.path}"
            results.append(LoadResult(False, message))
        mark = f"{run}-{batch_id}"
        if mode == "overwrite":
            newest = F.max(F.struct("modificationTime", "path", "length")).alias("newest")
            files = files.agg(newest).where("newest IS NOT NULL").select("newest.*").select(*VERSION)
        taken = _not_recorded(spark, files, control_table, table)
        if batch_column is not None and taken.head(1):
            # a replay that is not complete writes its partition in full
            taken = _not_recorded(spark, files, control_table, table, mark)
        versions = sorted(taken.select(*VERSION).collect())
        paths = [escape_glob(version.path) for version in versions]
        if not paths:
            return
        if batch_column is not None:
            target = table_types(spark, table) if target_types else None
            cleaned = prepare(spark, paths, missing_text=missing_text, encoding=encoding, target=target)
            try:
                replace_batch(cleaned.frame, table, batch_column, mark, table_format)
            finally:
                remove_folders(spark, cleaned.stored)
            result = LoadResult(True, f"{table} saved", cleaned.n_rows, cleaned.n_columns)
            if control_table is not None:
                record_ingest(
                    spark, control_table, table, paths[0], mode, result, landed=True, table_format=table_format
                )
        else:
            result = ingest(
                spark,
                paths,
                table,
                mode,
                landed=True,
                control_table=control_table,
                table_format=table_format,
                missing_text=missing_text,
                encoding=encoding,
                target_types=target_types,
            )
        if not result.ok:
            raise RuntimeError(result.message)
        if control_table is not None:
            done = spark.createDataFrame(versions, _VERSION_SCHEMA)
            _record_files(spark, control_table, table, mark, done, table_format)
        results.append(result)

    reader = spark.readStream.schema(_VERSION_SCHEMA).option("maxFileAge", NO_AGE_LIMIT)
    if mode == "append":
        reader = reader.option("maxFilesPerTrigger", 1)
    query = (
        reader.parquet(log)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return results
