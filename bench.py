"""Seconds per load step at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Inputs are landed as files first and are not part of the time. Every case is
run twice, as the first run also compiles its code; the faster run counts and
the first one is given under ``first_run``.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.functions import names
from lakeload.operators import cleaning, tables
from lakeload.plans import queries as q
from lakeload.plans.ingest import ingest, prepare
from lakeload.plans.landing import land_csv, land_parquet, land_workbooks
from lakeload.session import build_session, shared_folder
from lakeload.sources.dispatch import scan_csv, scan_xlsx
from lakeload.streaming.incremental import ingest_new_files

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def cases(spark: SparkSession) -> dict[str, Callable[[], object]]:
    lineitem = q._messy_lineitem(spark, SF_DIR)
    csv_path = land_csv(lineitem, "bench-lineitem")
    parquet_path = land_parquet(
        q._table(spark, SF_DIR, "lineitem").withColumn("dashes", F.lit("-")), "bench-parquet"
    )
    documents = q._table(spark, SF_DIR, "documents")
    documents_path = land_csv(documents, "bench-documents")
    customer = q._customer(spark, SF_DIR)
    books = land_workbooks(customer, "c_custkey", "bench-books", rows_per_book=1000)
    orders = q._orders(spark, SF_DIR)
    landing = land_csv(orders, "bench-landing")
    schema = q._schema(spark)
    runs = iter(range(100))

    def load() -> None:
        result = ingest(
            spark, csv_path, f"{schema}.l{next(runs)}", control_table=f"{schema}.load_control"
        )
        assert result.ok, result.message

    def append() -> None:
        result = tables.save_table(orders, f"{schema}.appended", "append")
        assert result.ok, result.message

    def recurring() -> None:
        run = next(runs)
        ingest_new_files(
            spark, landing, f"{schema}.r{run}", checkpoint=shared_folder(spark, "bench-checkpoint")
        )

    return {
        "ingest_job": load,
        "clean_table": lambda: consume(prepare(spark, csv_path).frame),
        "clean_parquet": lambda: consume(prepare(spark, parquet_path).frame),
        "scan_csv": lambda: consume(scan_csv(spark, csv_path)),
        "scan_csv_quoted_lines": lambda: consume(scan_csv(spark, documents_path)),
        "scan_xlsx": lambda: consume(scan_xlsx(spark, books)),
        "null_markers": lambda: consume(cleaning.null_markers(cleaning.trim_strings(orders))),
        "normalize_name": lambda: consume(documents.select(names.normalize_name(F.col("text")))),
        "save_append": append,
        "incremental_ingest": recurring,
        "load_status": lambda: consume(q.q_load_status(spark, SF_DIR)),
    }


def main() -> None:
    spark = build_session("bench", CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    first_run, best = {}, {}
    for name, case in cases(spark).items():
        seconds = []
        for _ in range(2):
            started = time.perf_counter()
            case()
            seconds.append(round(time.perf_counter() - started, 3))
        first_run[name], best[name] = seconds[0], min(seconds)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "first_run": first_run,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
