"""Snapshots made from the driver's tables, by SQL that Spark and DuckDB read alike.

Which file changes how is decided by the first hexadecimal digit of a hash of the text, so every row of a table
takes part.  Names in braces are tables.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_DIGIT = "substr(md5(text || doc_id), 1, 1)"
_AT = "source || '/' || lang || '/doc_' || doc_id || '.txt'"

SNAPSHOTS = {
    # one file a document, empty files beside some, and files that become directories
    "docs_a": f"""
SELECT '/mnt/a/' || {_AT} AS path, n_chars AS size_bytes, sha1(text) AS sha1, md5(text) AS md5 FROM {{documents}}
UNION ALL SELECT '/mnt/a/' || source || '/' || lang || '/empty_' || doc_id, CAST(0 AS BIGINT), sha1(''), md5('') FROM {{documents}} WHERE substr(md5(text || doc_id), 1, 2) = '7f'
UNION ALL SELECT '/mnt/a/' || source || '/' || lang || '/both_' || doc_id, n_chars, sha1(text || 'x'), md5(text || 'x') FROM {{documents}} WHERE substr(md5(text || doc_id), 1, 2) = '8a'""",
    # 0: dropped, 1: archived, 2: changed, 3: copied as well, 4: without hashes; one source is renamed
    "docs_b": f"""
SELECT '/mnt/b/' || CASE WHEN {_DIGIT} = '1' THEN 'archive/' ELSE '' END || CASE WHEN source = 'src7' THEN 'src7_moved' ELSE source END || '/' || lang || '/doc_' || doc_id || '.txt' AS path,
 CASE WHEN {_DIGIT} = '2' THEN n_chars + 1 ELSE n_chars END AS size_bytes,
 CASE {_DIGIT} WHEN '4' THEN NULL WHEN '2' THEN sha1(text || '!') ELSE sha1(text) END AS sha1, CASE {_DIGIT} WHEN '4' THEN NULL WHEN '2' THEN md5(text || '!') ELSE md5(text) END AS md5
FROM {{documents}} WHERE {_DIGIT} <> '0' OR source = 'src7'
UNION ALL SELECT '/mnt/b/copies/' || lang || '/doc_' || doc_id || '.txt', n_chars, sha1(text), md5(text) FROM {{documents}} WHERE {_DIGIT} = '3'
UNION ALL SELECT '/mnt/b/' || source || '/' || lang || '/void_' || doc_id, CAST(0 AS BIGINT), sha1(''), md5('') FROM {{documents}} WHERE substr(md5(text || doc_id), 1, 2) = '7f'
UNION ALL SELECT '/mnt/b/' || source || '/' || lang || '/both_' || doc_id || '/part.txt', n_chars, sha1(text || 'y'), md5(text || 'y') FROM {{documents}} WHERE substr(md5(text || doc_id), 1, 2) = '8a'""",
    "orders_a": """
SELECT '/tank/orders/' || o_orderpriority || '/' || substr(CAST(o_orderdate AS STRING), 1, 4) || '/' || substr(CAST(o_orderdate AS STRING), 6, 2) || '/' || o_orderkey AS path,
 o_custkey AS size_bytes, sha1(o_orderkey || '|' || o_custkey || '|' || o_orderstatus) AS sha1, md5(o_orderkey || '|' || o_custkey) AS md5 FROM {orders}""",
    "orders_b": """
SELECT '/tank/copy/' || o_orderpriority || '/' || substr(CAST(o_orderdate AS STRING), 1, 4) || '/' || substr(CAST(o_orderdate AS STRING), 6, 2) || '/' || o_orderkey AS path,
 o_custkey AS size_bytes, CASE WHEN o_orderstatus = 'P' THEN sha1(o_orderkey || 'p') ELSE sha1(o_orderkey || '|' || o_custkey || '|' || o_orderstatus) END AS sha1, md5(o_orderkey || '|' || o_custkey) AS md5
FROM {orders} WHERE o_orderpriority <> '5-LOW'""",
    "pages_f": """
SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', '/web/'), '[?#].*$', '') || '/p' || page_id AS path, CAST(length(html) AS BIGINT) AS size_bytes, sha1(html) AS sha1, md5(html) AS md5 FROM {pages}""",
    # orders and line numbers are not unique here: later rows replace earlier ones
    "lines_f": """
SELECT '/lines/' || l_orderkey || '/' || l_linenumber AS path, l_suppkey AS size_bytes, sha1(l_partkey || '|' || l_suppkey) AS sha1, CAST(NULL AS STRING) AS md5,
 l_partkey * 100000 + l_suppkey AS seq FROM {lineitem}""",
}

#: Catalog of the snapshots above.
CATALOG = """
SELECT * FROM VALUES (1, 'docs-a', '/mnt/a', 'completed', '2024-01-02'), (2, 'docs-b', '/mnt/b', 'completed', '2024-02-03'), (3, 'orders-a', '/tank/orders', 'completed', '2024-02-03'),
 (4, 'orders-b', '/tank/copy', 'failed', '2024-02-01'), (5, 'scan', '/tank', 'in_progress', NULL) AS t(id, name, root_path, status, finished_at)"""


def sql(name: str) -> str:
    """The snapshot's SQL with plain table names, for DuckDB."""
    return re.sub(r"\{(\w+)\}", r"\1", SNAPSHOTS[name])


def snapshot(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SNAPSHOTS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **tables)
