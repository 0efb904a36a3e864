"""The same results stated as SQL on the given tables."""

_CUSTOMER = """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
    c_acctbal, c_mktsegment FROM customer"""
_SUPPLIER = """SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey,
    s_acctbal FROM supplier"""
_ORDERS = "SELECT * FROM orders"
_NAME = "trim(regexp_replace(lower(regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '_')"

ORACLES: dict[str, str] = {
    "scan_csv": _CUSTOMER,
    "scan_csv_quoted_lines": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "infer_types": """SELECT o_orderkey,
        CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS gaps,
        o_orderkey % 2 = 0 AS flag,
        strftime(o_orderdate, '%Y-%m-%d') AS day,
        CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '-' END AS mixed,
        CASE WHEN o_orderkey % 2 = 0 THEN CAST(1000 AS DOUBLE) ELSE o_totalprice END AS number,
        o_custkey AS zeros,
        CAST(NULL AS DOUBLE) AS missing
        FROM orders""",
    "scan_xlsx": _CUSTOMER,
    "scan_xlsx_sheet": _SUPPLIER,
    "scan_xlsx_dates": "SELECT * FROM orders",
    "scan_parquet": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
        l_extendedprice, l_discount, nullif(l_tax, 0) AS l_tax, l_returnflag, l_linestatus,
        l_shipdate FROM lineitem""",
    "scan_any": """SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size,
        p_retailprice FROM part""",
    "source_manifest": """SELECT 'book-' || CAST(c_custkey // 100 AS VARCHAR) || '.xlsx' AS file_name,
        'xlsx' AS file_format, TRUE AS has_content FROM customer GROUP BY 1""",
    "normalize_columns": """SELECT c_custkey AS "CODIGO_DO_CLIENTE",
        c_name AS "RAZAO_SOCIAL_NOME", c_nationkey AS "NO", c_acctbal AS "PRECO_R$",
        c_mktsegment AS "DATA_INICIO" FROM customer""",
    "dedupe_columns": """SELECT c_custkey AS "A", c_name AS "A_2", c_nationkey AS "A_3",
        c_acctbal AS "B", c_mktsegment AS "B_2" FROM customer""",
    "trim_text": "SELECT * FROM customer",
    "null_markers": """SELECT * REPLACE (CASE WHEN o_orderpriority NOT IN ('3-MEDIUM', '5-LOW')
        THEN o_orderpriority END AS o_orderpriority) FROM orders""",
    "drop_empty_columns": "SELECT * FROM part",
    "clean_table": """SELECT l_orderkey AS "L_ORDERKEY", l_partkey AS "L_PARTKEY",
        l_suppkey AS "L_SUPPKEY", CAST(l_linenumber AS BIGINT) AS "L_LINENUMBER",
        l_quantity AS "L_QUANTITY", l_extendedprice AS "L_EXTENDEDPRICE",
        l_discount AS "L_DISCOUNT", l_tax AS "L_TAX",
        nullif(l_returnflag, 'N') AS "L_RETURNFLAG", l_linestatus AS "L_LINESTATUS",
        strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS "L_SHIPDATE" FROM lineitem""",
    "normalize_name": f"SELECT doc_id, {_NAME.format('text')} AS name FROM documents",
    "share_token": """SELECT page_id, 'u!' || replace(replace(replace(
        base64(encode(url)), '=', ''), '/', '_'), '+', '-') AS token FROM pages""",
    "decode_text": "SELECT c_custkey, c_name FROM customer",
    "landing_path": f"""SELECT page_id, '/landing/' || {_NAME.format("str_split(url, '/')[-2]")}
        || '/Plan.xlsx' AS path FROM pages""",
    "file_identity": """SELECT p_partkey, lower(split_part(p_name || '.v1.CSV', '.', 1)) AS upload_name,
        lower(str_split('/landing/v1/' || p_name || '.v1.CSV', '.')[-2]) AS landed_name,
        'csv' AS file_format FROM part""",
    "load_timestamp": """SELECT event_id, strftime(
        ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Sao_Paulo', '%Y-%m-%d %H:%M') AS dh_insertion
        FROM events""",
    "save_overwrite": _ORDERS,
    "overwrite_failed_keeps_rows": f"SELECT *, TRUE AS failed FROM ({_ORDERS})",
    "save_append": f"{_ORDERS} UNION ALL {_ORDERS}",
    "append_target_types": """SELECT o_orderkey AS "O_ORDERKEY",
        CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice) ELSE o_totalprice END AS "O_TOTALPRICE",
        CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'x' END AS "NOTE"
        FROM orders""",
    "save_merge_schema": """SELECT c_custkey, c_name, c_nationkey, c_mktsegment,
        CAST(NULL AS DOUBLE) AS c_acctbal FROM customer
        UNION ALL BY NAME
        SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name, c_nationkey, c_mktsegment, c_acctbal
        FROM customer""",
    "overwrite_keeps_columns": """SELECT c_custkey, c_name, c_nationkey,
        CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer""",
    "control_rows": """
        SELECT TRUE AS inserted_by, TRUE AS db_catalog, TRUE AS db_schema, db_table, insert_mode,
            CAST(NULL AS VARCHAR) AS transient, db_table AS file_name, file_format, sheet, n_rows,
            CAST(n_columns AS INTEGER) AS n_columns, '2024-01-31 12:00' AS dh_insertion
        FROM (SELECT 'customer' AS db_table, 'overwrite' AS insert_mode, 'csv' AS file_format,
                CAST(NULL AS VARCHAR) AS sheet, count(*) AS n_rows, 5 AS n_columns FROM customer
            UNION ALL SELECT 'supplier', 'append', 'parquet', NULL, count(*), 4 FROM supplier
            UNION ALL SELECT 'part', 'overwrite', 'xlsx', 'Dados', count(*), 6 FROM part)""",
    "load_metrics": "SELECT count(*) AS n_rows, CAST(6 AS INTEGER) AS n_columns FROM part",
    "preview": "SELECT least(count(*), 100) AS n_rows, least(count(*), 100) AS n_dates FROM orders",
    "ingest_job": """SELECT c_custkey AS "CODIGO", c_name AS "RAZAO_SOCIAL_NOME",
        CAST(c_nationkey AS BIGINT) AS "C_NATIONKEY", c_acctbal AS "PRECO_R$",
        nullif(c_mktsegment, 'BUILDING') AS "SEGMENTO" FROM customer""",
    "ingest_link_job": """SELECT s_suppkey AS "S_SUPPKEY", s_name AS "S_NAME",
        CAST(s_nationkey AS BIGINT) AS "S_NATIONKEY", s_acctbal AS "S_ACCTBAL",
        TRUE AS kept_path, 'xlsx' AS file_format FROM supplier""",
    "incremental_ingest": """SELECT o_orderkey AS "O_ORDERKEY", o_custkey AS "O_CUSTKEY",
        o_orderstatus AS "O_ORDERSTATUS", o_totalprice AS "O_TOTALPRICE",
        o_orderpriority AS "O_ORDERPRIORITY",
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS "O_ORDERDATE" FROM orders""",
    "incremental_batches": """SELECT CAST(o_orderkey % 2 AS INTEGER) AS batch, count(*) AS n_rows,
        TRUE AS told FROM orders GROUP BY 1""",
    "recovered_loads": """SELECT o_orderkey AS "O_ORDERKEY", o_custkey AS "O_CUSTKEY", insert_mode,
            2::BIGINT AS n_loads, t.n_told, 0 AS told_again
        FROM orders, (SELECT count(*) AS n_told FROM orders WHERE o_orderkey % 3 < 2) AS t,
            (SELECT unnest(['append', 'overwrite']) AS insert_mode)
        WHERE o_orderkey % 3 = 1 OR (o_orderkey % 3 = 0 AND insert_mode = 'append')""",
    "scan_xlsx_durations": """SELECT o_orderkey, (((o_custkey % 50) * 24 + o_custkey % 24) * 60
        + o_orderkey % 60) * 60 + o_orderkey % 7 AS seconds, 'interval day to second' AS kind FROM orders""",
    "incremental_relanded": """SELECT 'overwrite' AS mode, s_suppkey AS key, s_name AS name,
            CAST(3 AS BIGINT) AS version FROM supplier
        UNION ALL SELECT 'append', c_custkey, c_name, version
            FROM customer, (SELECT unnest([1, 2, 3]) AS version)""",
    "scan_csv_overlong": """SELECT c_nationkey, c_nationkey % 3 <> 0 AS taken,
        CASE WHEN c_nationkey % 3 <> 0 THEN count(*) END AS n_rows FROM customer GROUP BY c_nationkey""",
    "scan_csv_encoding": """SELECT * FROM documents
        WHERE NOT regexp_matches(text, '[^\\x{00}-\\x{FF}]')""",
    "scan_csv_crlf": """SELECT doc_id, replace(text, chr(10), chr(13) || chr(10)) AS text, lang
        FROM documents""",
    "folder_headers": 'SELECT c_custkey AS "CODIGO", c_name AS "C_NAME" FROM customer',
    "folder_many_headers": 'SELECT c_custkey AS "C_CUSTKEY", c_name AS "C_NAME_0" FROM customer',
    "load_outcomes": """SELECT attempt, outcome,
            CASE WHEN outcome = 'saved' THEN p.n END AS n_rows,
            CASE WHEN outcome = 'saved' THEN 6 END AS n_columns, 2 * p.n AS in_table
        FROM (VALUES ('overwrite', 'saved'), ('append', 'saved'), ('type conflict', 'refused'),
            ('write mode', 'raised'), ('no target', 'raised'), ('no source', 'raised'),
            ('too many parts', 'raised')) AS t(attempt, outcome),
            (SELECT count(*) AS n FROM part) AS p""",
    "load_status": """SELECT 'customer_' || CAST(o_custkey AS VARCHAR) AS db_table,
        o_orderkey AS n_rows, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS dh_insertion
        FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey
        ORDER BY strftime(o_orderdate, '%Y-%m-%d %H:%M') DESC, o_orderkey DESC) = 1""",
}
