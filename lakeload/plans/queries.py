"""The registered queries: each lands a given table as files or uses it as is."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.functions import names, text, times
from lakeload.operators import cleaning, control, tables
from lakeload.plans.ingest import control_values, ingest, prepare, stored
from lakeload.plans.landing import land_csv, land_parquet, land_workbooks
from lakeload.plans.recovery import begin_load, recover_loads
from lakeload.session import shared_folder
from lakeload.sources.dispatch import (
    read_source,
    scan_csv,
    scan_parquet,
    scan_xlsx,
    source_manifest,
)
from lakeload.sources.raw import InputError
from lakeload.streaming.incremental import ingest_new_files

# Rows that a sheet of a workbook can hold below its header.
WORKBOOK_ROWS = 2**20 - 1

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer")


def _schema(spark: SparkSession) -> str:
    """A new schema whose tables lie in the shared folder."""
    folder = shared_folder(spark, "schema")
    schema = "lakeload_" + folder.rsplit("-", 1)[-1]
    spark.sql(f"CREATE SCHEMA {schema} LOCATION '{folder}'")
    return schema


def _padded(column: str) -> F.Column:
    """A cell between blanks that a plain trim leaves alone."""
    return F.concat(F.lit("\t "), F.col(column), F.lit("  "))


# --- sources -------------------------------------------------------------------------------


def q_scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_csv(spark, land_csv(_customer(spark, sf_dir), "scan-csv"))


def q_scan_csv_quoted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line ends, quotes and commas inside their cells."""
    documents = _table(spark, sf_dir, "documents")
    return scan_csv(spark, land_csv(documents, "scan-csv-quoted-lines"))


def q_infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps, boolean words, dates and mixed columns."""
    orders = _table(spark, sf_dir, "orders")
    whole = F.col("o_orderkey") % 2 == 0
    messy = orders.select(
        F.col("o_orderkey"),
        F.when(whole, F.col("o_custkey")).alias("gaps"),
        F.when(whole, F.lit("TRUE")).otherwise(F.lit("false")).alias("flag"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(whole, F.col("o_custkey").cast("string")).otherwise(F.lit("-")).alias("mixed"),
        F.when(whole, F.lit("1e3")).otherwise(F.col("o_totalprice").cast("string")).alias("number"),
        F.format_string("%05d", "o_custkey").alias("zeros"),
        F.lit("n/a").alias("missing"),
    )
    return scan_csv(spark, land_csv(messy, "infer-types"))


def q_scan_xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _customer(spark, sf_dir)
    return scan_xlsx(spark, land_workbooks(customer, "c_custkey", "scan-xlsx"))


def q_scan_xlsx_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = _table(spark, sf_dir, "supplier")
    folder = land_workbooks(
        supplier, "s_suppkey", "scan-xlsx-sheet", sheet="Outros", first_sheet="Dados"
    )
    return scan_xlsx(spark, folder, sheet="Outros")


def q_scan_xlsx_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as workbooks keep them: numbers with a date format."""
    orders = _table(spark, sf_dir, "orders")
    found = scan_xlsx(spark, land_workbooks(orders, "o_orderkey", "scan-xlsx-dates"))
    return found.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


def q_scan_xlsx_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elapsed times of more than a day, as workbooks keep them: numbers under a format such as [h]:mm:ss."""
    parts = "o_custkey % 50, o_custkey % 24, o_orderkey % 60, o_orderkey % 7"
    orders = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"make_dt_interval({parts}) AS took")
    found = scan_xlsx(spark, land_workbooks(orders, "o_orderkey", "scan-xlsx-durations"))
    seconds = "((extract(DAY FROM took) * 24 + extract(HOUR FROM took)) * 60 + extract(MINUTE FROM took)) * 60"
    seconds = f"CAST({seconds} + extract(SECOND FROM took) AS bigint) AS seconds"
    return found.selectExpr("o_orderkey", seconds, "typeof(took) AS kind")


def q_scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN and null are the same missing value after the scan."""
    lineitem = _table(spark, sf_dir, "lineitem")
    tax = F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    return scan_parquet(spark, land_parquet(lineitem.withColumn("l_tax", tax), "scan-parquet"))


def q_scan_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder that holds one table in three formats."""
    part = _table(spark, sf_dir, "part")
    folder = shared_folder(spark, "scan-any")
    third = F.col("p_partkey") % 3
    land_csv(part.where(third == 0), "any", folder, "csv")
    land_parquet(part.where(third == 1), "any", folder, "parquet")
    land_workbooks(part.where(third == 2), "p_partkey", "any", f"{folder}/xlsx")
    return read_source(spark, folder)


def q_source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = land_workbooks(_customer(spark, sf_dir), "c_custkey", "manifest", rows_per_book=100)
    manifest = source_manifest(spark, folder)
    return manifest.select("file_name", "file_format", (F.col("length") > 0).alias("has_content"))


# --- cleaning ------------------------------------------------------------------------------


def q_normalize_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = ["Código do Cliente", "Razão Social / Nome", "Nº", "Preço (R$)", "data-início"]
    return cleaning.normalize_columns(_customer(spark, sf_dir).toDF(*headers))


def q_dedupe_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.normalize_columns(_customer(spark, sf_dir).toDF("a", "A", "á", "b", "B."))


def q_trim_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _customer(spark, sf_dir).withColumn("c_name", _padded("c_name"))
    return cleaning.trim_strings(customer)


def q_null_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    marked = (
        F.when(priority == "3-MEDIUM", " - ").when(priority == "5-LOW", "None").otherwise(priority)
    )
    orders = _table(spark, sf_dir, "orders").withColumn("o_orderpriority", marked)
    return cleaning.null_markers(cleaning.trim_strings(orders))


def q_drop_empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").withColumns(
        {"dashes": F.lit("-"), "gap": F.lit(None).cast("int"), "nan": F.lit(float("nan"))}
    )
    return cleaning.drop_empty_columns(cleaning.null_markers(part))


def _messy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("L Orderkey"),
        F.col("l_partkey").alias("l.partkey"),
        F.col("l_suppkey").alias("l/suppkey"),
        F.col("l_linenumber").alias("l-linenumber"),
        F.lit("-").alias("só traços"),
        F.col("l_quantity").alias("_l_quantity_"),
        F.col("l_extendedprice").alias("l  extendedprice"),
        F.col("l_discount").alias("l_discount"),
        F.col("l_tax").alias("l_táx"),
        F.when(flag == "N", " - ").otherwise(_padded("l_returnflag")).alias("l_returnflag%"),
        _padded("l_linestatus").alias("(l_linestatus)"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("l.shipdate"),
    )


def q_clean_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = land_csv(_messy_lineitem(spark, sf_dir), "clean-table")
    return prepare(spark, path).frame


# --- functions -----------------------------------------------------------------------------


def q_normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return documents.select("doc_id", names.normalize_name(F.col("text")).alias("name"))


def q_share_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", text.share_token(F.col("url")).alias("token"))


def q_decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit(' "'), F.col("c_name"), F.lit('"\n'))
    customer = _customer(spark, sf_dir).select("c_custkey", F.base64(quoted).alias("encoded"))
    return customer.select("c_custkey", text.decode_text(F.col("encoded")).alias("c_name"))


def q_landing_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    path = names.landing_path(F.col("url"), F.lit("Plan.xlsx"), "/landing")
    return pages.select("page_id", path.alias("path"))


def q_file_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    file_name = F.concat("p_name", F.lit(".v1.CSV"))
    landed = F.concat(F.lit("/landing/v1/"), file_name)
    return part.select(
        "p_partkey",
        names.uploaded_file_name(file_name).alias("upload_name"),
        names.landed_file_name(landed).alias("landed_name"),
        names.file_format(file_name).alias("file_format"),
    )


def q_load_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    moment = times.load_timestamp(F.col("ts"), source_zone="UTC")
    return events.select("event_id", moment.alias("dh_insertion"))


# --- tables --------------------------------------------------------------------------------


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders")


def _text_dates(orders: DataFrame) -> DataFrame:
    """Orders as they go into CSV files, with a written form of the date that stays text."""
    return orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


def _save(df: DataFrame, table: str, mode: str) -> None:
    result = tables.save_table(df, table, mode)
    if not result.ok:
        raise RuntimeError(result.message)


def q_save_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, table = _orders(spark, sf_dir), f"{_schema(spark)}.orders"
    _save(orders.withColumn("o_custkey", -F.col("o_custkey")), table, "overwrite")
    _save(orders, table, "overwrite")
    return spark.table(table)


def q_save_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, table = _orders(spark, sf_dir), f"{_schema(spark)}.orders"
    _save(orders, table, "append")
    # Columns are matched by name, whatever their order and letter case.
    _save(orders.select(*[F.col(c).alias(c.upper()) for c in reversed(orders.columns)]), table, "append")
    return spark.table(table)


def q_append_target_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with decimals first, then a file of whole numbers, into the types of the table."""
    orders, table = _table(spark, sf_dir, "orders"), f"{_schema(spark)}.orders"
    whole = F.col("o_orderkey") % 2 == 0
    first = orders.select("o_orderkey", "o_totalprice", F.lit("x").alias("note"))
    second = orders.select("o_orderkey", F.floor("o_totalprice").alias("o_totalprice"), "o_custkey")
    for part in (first.where(~whole), second.where(whole).withColumnRenamed("o_custkey", "note")):
        stored(spark, ingest(spark, land_csv(part, "types"), table, "append", target_types=True), table)
    return spark.table(table)


def q_save_merge_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, table = _customer(spark, sf_dir), f"{_schema(spark)}.customer"
    _save(customer.drop("c_acctbal"), table, "append")
    _save(customer.drop("c_name"), table, "append")
    return spark.table(table)


def q_overwrite_keeps_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, table = _customer(spark, sf_dir), f"{_schema(spark)}.customer"
    _save(customer.drop("c_mktsegment"), table, "overwrite")
    _save(customer.drop("c_acctbal"), table, "overwrite")
    return spark.table(table)


def q_overwrite_failed_keeps_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are overwritten, then badly overwritten: the last task fails when others are done."""
    orders, table = _orders(spark, sf_dir), f"{_schema(spark)}.orders"
    _save(orders.withColumn("o_custkey", -F.col("o_custkey")), table, "overwrite")
    _save(orders, table, "overwrite")
    last = orders.agg(F.max("o_orderkey").alias("last"))  # one row
    broken = F.when(F.col("o_orderkey") == F.col("last"), F.raise_error("broken")).otherwise(0.0)
    bad = orders.crossJoin(last).withColumn("o_totalprice", broken.cast("double")).withColumn("extra", F.lit(1))
    bad = bad.drop("last").repartitionByRange(8, "o_orderkey")
    failed = tables.save_table(bad, table, "overwrite")
    return spark.table(table).withColumn("failed", F.lit(not failed.ok))


def q_control_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema, folder = _schema(spark), shared_folder(spark, "control-rows")
    control_table = f"{schema}.load_control"
    customer = land_csv(_customer(spark, sf_dir), "c", folder, "Customer.2024.CSV")
    supplier = land_parquet(_table(spark, sf_dir, "supplier"), "s", folder, "Supplier.parquet")
    part = land_workbooks(_table(spark, sf_dir, "part"), "p_partkey", "p", f"{folder}/Part.xlsx")
    loads = [
        (customer, "customer", "overwrite", None),
        (supplier, "supplier", "append", None),
        (part, "part", "overwrite", "Dados"),
    ]
    for path, table, mode, sheet in loads:
        result = ingest(
            spark,
            path,
            f"{schema}.{table}",
            mode,
            sheet,
            control_table=control_table,
            dh_insertion="2024-01-31 12:00",
        )
        stored(spark, result, control_table)
    same = {
        "inserted_by": F.col("inserted_by") == F.current_user(),
        "db_catalog": F.col("db_catalog") == spark.catalog.currentCatalog(),
        "db_schema": F.col("db_schema") == schema,
    }
    return spark.table(control_table).withColumns(same)


def q_load_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of good and bad loads of one table: outcome, rows and columns of each."""
    part, schema = _table(spark, sf_dir, "part"), _schema(spark)
    table, good = f"{schema}.`order`", land_csv(part, "outcomes")
    text_keys = part.withColumn("p_partkey", F.lit("no key"))
    tries: list[tuple[str, Callable[[], tables.LoadResult]]] = [
        ("overwrite", lambda: ingest(spark, good, table, "overwrite")),
        ("append", lambda: ingest(spark, good, table, "append")),
        ("type conflict", lambda: ingest(spark, land_csv(text_keys, "conflict"), table, "append")),
        ("write mode", lambda: ingest(spark, good, table, "merge")),
        ("no target", lambda: ingest(spark, good, " None ", "append")),
        ("no source", lambda: ingest(spark, "", table, "append")),
        ("too many parts", lambda: ingest(spark, good, "a.b.c.d", "append")),
    ]
    rows = []
    for name, attempt in tries:
        try:
            result = attempt()
            rows.append((name, "saved" if result.ok else "refused", result.n_rows, result.n_columns))
        except ValueError:
            rows.append((name, "raised", None, None))
    outcomes = spark.createDataFrame(rows, "attempt string, outcome string, n_rows bigint, n_columns int")
    total = spark.table(table).agg(F.count(F.lit(1)).alias("in_table"))
    return outcomes.crossJoin(total)  # one row on the right


def q_scan_csv_overlong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers landed one file a nation; every third file has a field too many in its rows."""
    customer, folder = _customer(spark, sf_dir), shared_folder(spark, "overlong")
    fields = F.concat_ws(",", "c_custkey", "c_name", "c_nationkey")
    spare = F.when(F.col("c_nationkey") % 3 == 0, F.concat(fields, F.lit(",,LOST"))).otherwise(fields)
    lines = customer.select(spare.alias("value"), "c_nationkey")
    header = lines.select("c_nationkey").distinct().select(F.lit("key,name,nation").alias("value"), "c_nationkey")
    ordered = header.unionByName(lines).repartition("c_nationkey")
    ordered = ordered.sortWithinPartitions("c_nationkey", F.col("value") != "key,name,nation")
    ordered.write.partitionBy("c_nationkey").text(folder)
    nations = sorted(row.c_nationkey for row in header.select("c_nationkey").collect())
    rows = []
    for nation in nations:
        try:
            rows.append((nation, True, scan_csv(spark, f"{folder}/c_nationkey={nation}").count()))
        except InputError:
            rows.append((nation, False, None))
    return spark.createDataFrame(rows, "c_nationkey int, taken boolean, n_rows bigint")


def q_scan_csv_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that Latin-1 can hold, landed in that encoding."""
    documents = _table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"[^\x00-\xFF]"))
    folder = shared_folder(spark, "latin")
    options = {"header": "true", "escape": '"', "emptyValue": "", "encoding": "ISO-8859-1"}
    options |= {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    documents.write.options(**options).csv(folder)
    return scan_csv(spark, folder, encoding="ISO-8859-1")


def q_scan_csv_crlf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends of two characters, inside cells and between records; sixteen headed files."""
    documents = _table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "crlf")
    text = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    cell = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    record = F.concat_ws(",", "doc_id", cell, F.coalesce("lang", F.lit("")))
    lines = documents.select(record.alias("value"), F.pmod(F.hash("doc_id"), F.lit(16)).alias("file"), F.lit(1).alias("place"))
    heads = spark.range(16).select(F.lit("doc_id,text,lang").alias("value"), F.col("id").cast("int").alias("file"), F.lit(0).alias("place"))
    ordered = heads.union(lines).repartition("file").sortWithinPartitions("file", "place")
    ordered.drop("place").write.partitionBy("file").option("lineSep", "\r\n").text(folder)
    return scan_csv(spark, folder)


def q_folder_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table landed under three spellings of its header, a file each."""
    customer, folder = _customer(spark, sf_dir), shared_folder(spark, "spellings")
    for k, name in enumerate(("Código", "CODIGO", "código")):
        part = customer.where(F.col("c_custkey") % 3 == k)
        land_csv(part.select(F.col("c_custkey").alias(name), "c_name"), "h", folder, f"part{k}.csv")
    return prepare(spark, folder).frame


def q_folder_many_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers landed under up to 2,000 different headers: spellings, orders and a spare column."""
    customer, folder = _customer(spark, sf_dir), f"{shared_folder(spark, 'many-headers')}/customers.csv"
    number = F.pmod(F.col("c_custkey"), F.lit(2000))
    key, name = F.concat(F.lit("c"), F.repeat(F.lit("."), number.cast("int") + 1), F.lit("custkey")), F.lit('"c name, 0"')
    turned = number % 2 == 1
    header = F.when(turned, F.concat_ws(",", name, key)).otherwise(F.concat_ws(",", key, name, F.lit("spare")))
    cells = F.when(turned, F.concat_ws(",", "c_name", "c_custkey"))
    cells = cells.otherwise(F.concat_ws(",", "c_custkey", "c_name", F.lit("-")))
    lines = customer.select(cells.alias("value"), number.alias("number"), F.lit(1).alias("place"))
    heads = customer.select(header.alias("value"), number.alias("number"), F.lit(0).alias("place")).distinct()
    ordered = heads.unionByName(lines).repartition("number").sortWithinPartitions("number", "place")
    ordered.drop("place").write.partitionBy("number").text(folder)
    return prepare(spark, folder).frame


# --- counts, jobs --------------------------------------------------------------------------


def q_load_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").withColumn("dashes", F.lit("-"))
    return cleaning.load_metrics(prepare(spark, land_csv(part, "load-metrics")), spark)


def q_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = cleaning.preview(prepare(spark, land_csv(_text_dates(_orders(spark, sf_dir)), "preview")).frame)
    return shown.agg(F.count(F.lit(1)).alias("n_rows"), F.count("O_ORDERDATE").alias("n_dates"))


def q_ingest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land customers as messy CSV and load them, with a control row."""
    schema = _schema(spark)
    customer = _customer(spark, sf_dir).select(
        F.col("c_custkey").alias("Código"),
        _padded("c_name").alias("Razão Social / Nome"),
        F.col("c_nationkey").alias("c.nationkey"),
        F.lit("-").alias("vazio"),
        F.col("c_acctbal").alias("Preço (R$)"),
        F.when(F.col("c_mktsegment") == "BUILDING", "-")
        .otherwise(F.col("c_mktsegment"))
        .alias("segmento"),
    )
    table = f"{schema}.customer"
    result = ingest(
        spark, land_csv(customer, "ingest"), table, control_table=f"{schema}.load_control"
    )
    return stored(spark, result, table)


def q_ingest_link_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landed copy of a link: first sheet, landed path kept in the control row."""
    schema, base = _schema(spark), shared_folder(spark, "landed")
    table, control_table = f"{schema}.supplier", f"{schema}.load_control"
    folder = f"{base}/big_data/Plan.xlsx"
    land_workbooks(_table(spark, sf_dir, "supplier"), "s_suppkey", "link", folder)
    result = ingest(spark, folder, table, "append", landed=True, control_table=control_table)
    loads = spark.table(control_table).select(
        "db_table", (F.col("transient") == folder).alias("kept_path"), "file_format"
    )
    return stored(spark, result, table).join(loads, F.col("db_table") == "supplier").drop("db_table")


def q_incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three landings, the last one early in name; a lost checkpoint: every file is loaded once."""
    orders, schema = _text_dates(_orders(spark, sf_dir)), _schema(spark)
    base = shared_folder(spark, "incremental")
    table, landing = f"{schema}.orders", f"{base}/landing"

    def run(checkpoint: str = "checkpoint") -> None:
        ingest_new_files(
            spark,
            landing,
            table,
            checkpoint=f"{base}/{checkpoint}",
            control_table=f"{schema}.load_control",
        )

    third = F.col("o_orderkey") % 3
    land_csv(orders.where(third == 0), "i", landing, "first")
    run()
    land_csv(orders.where(third == 1), "i", landing, "second")
    run()
    run()
    land_csv(orders.where(third == 2), "i", landing, "a-third")
    run("other")
    return spark.table(table)


def q_incremental_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two landings with a batch column: rows by batch, next to what the control table says."""
    orders, schema = _text_dates(_orders(spark, sf_dir)), _schema(spark)
    base = shared_folder(spark, "batches")
    table, control_table = f"{schema}.orders", f"{schema}.load_control"
    even = F.col("o_orderkey") % 2 == 0
    for k, part in enumerate((orders.where(even), orders.where(~even))):
        land_csv(part, "b", f"{base}/landing", f"part{k}")
        ingest_new_files(
            spark,
            f"{base}/landing",
            table,
            checkpoint=f"{base}/checkpoint",
            control_table=control_table,
            batch_column="load_batch",
        )
    batch = F.substring_index("load_batch", "-", -1).cast("int").alias("batch")
    counts = spark.table(table).groupBy(batch).agg(F.count(F.lit(1)).alias("n_rows"))
    told = spark.table(control_table).groupBy("n_rows").agg(F.count(F.lit(1)).alias("n_loads"))
    return counts.join(told, "n_rows").select("batch", "n_rows", (F.col("n_loads") > 0).alias("told"))


def q_incremental_relanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that land three times under their names, run and replayed after each landing.

    Suppliers are one link that overwrites, customers are several that append.
    """
    schema, base = _schema(spark), shared_folder(spark, "relanded")
    feeds = {
        "overwrite": (_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", WORKBOOK_ROWS),
        "append": (_customer(spark, sf_dir).select("c_custkey", "c_name"), "c_custkey", 1000),
    }
    for version in (1, 2, 3):
        for mode, (rows, key, size) in feeds.items():
            landing = f"{base}/{mode}/link"
            land_workbooks(rows.withColumn("version", F.lit(version)), key, "relanded", landing, size)
            for checkpoint in ("checkpoint", "checkpoint", f"lost-{version}"):
                ingest_new_files(
                    spark,
                    landing,
                    f"{schema}.{mode}_feed",
                    mode,
                    checkpoint=f"{base}/{mode}/{checkpoint}",
                    control_table=f"{schema}.load_control",
                )
    tables = [spark.table(f"{schema}.{mode}_feed").select(F.lit(mode).alias("mode"), "*") for mode in feeds]
    return reduce(DataFrame.unionAll, tables).toDF("mode", "key", "name", "version")


def q_recovered_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads that stop after their data, or before it: after recovery rows and control rows agree."""
    orders, schema = _orders(spark, sf_dir).select("o_orderkey", "o_custkey"), _schema(spark)
    control_table, parts = f"{schema}.load_control", [orders.where(F.col("o_orderkey") % 3 == k) for k in range(3)]
    for mode in ("append", "overwrite"):
        table = f"{schema}.{mode}_feed"
        path = land_csv(parts[0], "recover")
        stored(spark, ingest(spark, path, table, mode, control_table=control_table, recoverable=True), table)
        for part, write in ((parts[1], True), (parts[2], False)):
            cleaned = prepare(spark, land_csv(part, "recover"))
            planned = tables.LoadResult(True, "", cleaned.n_rows, cleaned.n_columns)
            values = control_values(spark, table, path, mode, planned, inserted_by="stopped")
            begin_load(spark, control_table, table, **values)
            if write:
                _save(cleaned.frame, table, mode)
    recover_loads(spark, control_table)
    told = recover_loads(spark, control_table).count()
    loads = spark.table(control_table).groupBy("insert_mode").agg(
        F.count(F.lit(1)).alias("n_loads"), F.sum("n_rows").alias("n_told")
    )
    rows = [spark.table(f"{schema}.{mode}_feed").withColumn("insert_mode", F.lit(mode)) for mode in ("append", "overwrite")]
    return reduce(DataFrame.unionAll, rows).join(loads, "insert_mode").withColumn("told_again", F.lit(told))


def q_load_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of the loads that orders stand for, one target per customer."""
    filled = {
        "db_table": F.concat(F.lit("customer_"), F.col("o_custkey")),
        "insert_mode": F.lit("append"),
        "n_rows": F.col("o_orderkey"),
        "dh_insertion": F.date_format("o_orderdate", times.LOAD_FORMAT),
    }
    loads = _table(spark, sf_dir, "orders").select(
        *[
            filled.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in control.CONTROL_SCHEMA
        ]
    )
    return control.load_status(loads).select("db_table", "n_rows", "dh_insertion")


QUERIES: dict[str, Query] = {
    name.removeprefix("q_"): query for name, query in list(globals().items()) if name.startswith("q_")
}
