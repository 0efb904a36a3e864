"""lakeload: bring CSV, Excel and Parquet files into lake tables with Spark."""

import sys

from pyspark import cloudpickle

from lakeload.operators.cleaning import clean
from lakeload.operators.tables import LoadResult, save_table
from lakeload.plans.ingest import ingest, prepare
from lakeload.plans.recovery import recover_loads
from lakeload.sources.dispatch import read_source, source_manifest
from lakeload.streaming.incremental import ingest_new_files

# Tasks receive our functions by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "LoadResult",
    "clean",
    "ingest",
    "ingest_new_files",
    "prepare",
    "read_source",
    "recover_loads",
    "save_table",
    "source_manifest",
]
