"""Views of the test tables that carry the shapes of slides, hits, mappings, catalogues, events, logs and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAME = "p.p_name || CASE WHEN e.vec_id % 4 = 0 THEN '' ELSE ' v' || CAST(e.vec_id % 4 AS STRING) END || '.pptx'"
VIEWS: dict[str, str] = {
    "slides_fx": f"SELECT e.vec_id, 'd' || CAST(e.vec_id % 8 AS STRING) || '/' || {NAME} AS file_path, {NAME} AS file_name, "
    "CAST(FLOOR(e.vec_id / 80.0) AS INT) + 1 AS slide_number, e.embedding FROM embeddings e JOIN part p ON p.p_partkey = e.vec_id % 80",
    "queries_fx": "SELECT vec_id AS query_id, embedding AS query_vec FROM embeddings WHERE vec_id % 100 = 0",
    "hits_fx": "SELECT l_orderkey % 5 AS query_id, 'd' || CAST(l_orderkey % 20 AS STRING) || '/f' || CAST(l_orderkey AS STRING) || '.pptx' AS file_path, "
    "l_linenumber AS slide_number, l_extendedprice AS score, l_partkey AS ref FROM lineitem",
    "mapping_fx": "SELECT 'd' || CAST(o_custkey % 50 AS STRING) || '/f' || CAST(o_orderkey % 3000 AS STRING) || '.xlsx' AS path, "
    "o_orderdate AS mtime, o_orderstatus <> 'P' AS file_exists, o_orderkey AS input_order FROM orders",
    "catalog_fx": "SELECT source || '/' || lang || '/doc' || CAST(doc_id AS STRING) || CASE doc_id % 8 WHEN 0 THEN '.pptx' WHEN 1 THEN '.PPTX' WHEN 2 THEN '.xlsx' "
    "WHEN 3 THEN '.pdf' WHEN 4 THEN '.docx' WHEN 5 THEN '.png' WHEN 6 THEN '.tmp' ELSE '' END AS path, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE n_chars END AS length FROM documents",
    "file_events_fx": "SELECT event_id, ts, CASE event_type WHEN 'signup' THEN 'add' WHEN 'purchase' THEN 'unlink' WHEN 'error' THEN 'addDir' ELSE 'change' END AS type, "
    "'d' || CAST(user_id % 10 AS STRING) || CASE WHEN event_type = 'error' THEN '' ELSE '/f' || CAST(user_id AS STRING) || CASE user_id % 4 WHEN 0 THEN '.pptx' WHEN 1 THEN '.XLSX' "
    "WHEN 2 THEN '.txt' ELSE '.pdf' END END AS path FROM events",
    "query_log_fx": "SELECT event_id, ts, user_id AS tenant, CASE event_id % 3 WHEN 0 THEN UPPER(event_type) || '  report' WHEN 1 THEN ' ' || event_type || ' report ' "
    "ELSE event_type || ' report' END AS query FROM events",
    "cells_fx": "SELECT 'wb' || CAST(l_suppkey AS STRING) || '.xlsx' AS workbook, l_returnflag AS sheet, CAST(l_orderkey % 200 AS INT) + 1 AS row_no, "
    "l_linenumber AS col_no, CAST(l_quantity AS INT) AS v FROM lineitem",
}
_TABLES = {"slides_fx": ("embeddings", "part"), "queries_fx": ("embeddings",), "hits_fx": ("lineitem",), "mapping_fx": ("orders",), "catalog_fx": ("documents",), "file_events_fx": ("events",), "query_log_fx": ("events",), "cells_fx": ("lineitem",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of one view over the tables of ``sf_dir``."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES[name]}
    sql = VIEWS[name]
    for t in tables:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {t}", f"{word} {{{t}}}")
    return spark.sql(sql, **tables)


def with_views(sql: str) -> str:
    """SQL with the views it names as common table expressions."""
    used = [f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in sql]
    if not used:
        return sql
    body = sql.lstrip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{', '.join(used)}, {body[len(head) :]}"
    return f"WITH {', '.join(used)} {body}"
