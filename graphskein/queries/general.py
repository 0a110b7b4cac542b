"""Queries of the general operators: broken references, wide tables, skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphskein.operators.pivot import attributes_to_wide, wide_to_cells
from graphskein.operators.references import broken_by_month, broken_references
from graphskein.operators.skew import key_summary, last_by_key
from graphskein.queries.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_references(table(spark, d, "dgraph_edge"), table(spark, d, "graph_vertex"))


def p3_by_month(spark: SparkSession, d: str) -> DataFrame:
    return broken_by_month(p3_found(spark, d))


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return attributes_to_wide(table(spark, d, "dgraph_triple"), table(spark, d, "predicate_schema"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return wide_to_cells(_wide(spark, d))


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return last_by_key(table(spark, d, "dgraph_edge"), ["subject", "objectuid"])


def p5_key_summary(spark: SparkSession, d: str) -> DataFrame:
    return key_summary(table(spark, d, "dgraph_edge"), ["subject", "objectuid"])


_BROKEN = """
WITH v AS (SELECT id, min(coalesce(created_at, TIMESTAMP '0001-01-01')) AS born, max(coalesce(deleted_at, TIMESTAMP '9999-12-31')) AS died FROM graph_vertex GROUP BY id),
r AS (SELECT edge_id, 'subject' AS ref_field, subject AS uid, seen_at FROM dgraph_edge WHERE subject IS NOT NULL
      UNION ALL SELECT edge_id, 'objectuid', objectuid, seen_at FROM dgraph_edge WHERE objectuid IS NOT NULL),
j AS (SELECT r.*, v.id, v.born, v.died FROM r LEFT JOIN v ON v.id = r.uid),
b AS (SELECT edge_id, ref_field, 'missing' AS reason, seen_at FROM j WHERE id IS NULL
      UNION ALL SELECT edge_id, ref_field, 'deleted', seen_at FROM j WHERE died <= seen_at
      UNION ALL SELECT edge_id, ref_field, 'late', seen_at FROM j WHERE born > seen_at),
found AS (SELECT DISTINCT edge_id, ref_field, reason, strftime(seen_at, '%Y-%m') AS seen_month FROM b)
"""

_CELLS = r"""
WITH t AS (SELECT t.*, s.predicate AS p, s.objecttype AS kind, trim(objectstring) AS x, objectstring IS NOT NULL AND trim(objectstring) <> '' AS filled
  FROM dgraph_triple t JOIN predicate_schema s ON lower(trim(t.predicate)) = s.predicate WHERE s.objecttype <> 'uid'),
m AS (SELECT *, CASE WHEN regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}([T ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])?)?')
    THEN try_cast(replace(substr(x, 1, 19), 'T', ' ') AS TIMESTAMP) - to_minutes(CASE WHEN length(x) = 25 THEN (CASE substr(x, 20, 1) WHEN '-' THEN -1 ELSE 1 END) * (60 * try_cast(substr(x, 21, 2) AS INT) + try_cast(substr(x, 24, 2) AS INT)) ELSE 0 END) END AS moment FROM t),
c AS (SELECT subject, p, read_at, triple_id, CASE
    WHEN kind = 'long' THEN CASE WHEN NOT filled THEN cast(objectlong AS VARCHAR) WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN cast(try_cast(x AS BIGINT) AS VARCHAR) END
    WHEN kind = 'double' THEN CASE WHEN NOT filled THEN printf('%.3f', coalesce(objectdouble, cast(objectlong AS DOUBLE))) WHEN regexp_full_match(x, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN printf('%.3f', try_cast(x AS DOUBLE)) END
    WHEN kind = 'boolean' THEN CASE WHEN NOT filled THEN cast(objectboolean AS VARCHAR) WHEN lower(x) IN ('true', '1') THEN 'true' WHEN lower(x) IN ('false', '0') THEN 'false' END
    WHEN kind = 'timestamp' THEN CASE WHEN NOT filled THEN strftime(objecttimestamp, '%Y-%m-%d %H:%M:%S') ELSE strftime(moment, '%Y-%m-%d %H:%M:%S') END
    WHEN kind = 'geo' THEN CASE WHEN filled THEN objectstring ELSE objectgeo END
    WHEN kind = 'password' THEN CASE WHEN filled THEN objectstring ELSE objectpassword END
    WHEN filled THEN objectstring END AS cell_text FROM m),
cells AS (SELECT subject, p AS predicate, cell_text FROM c WHERE cell_text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subject, p ORDER BY read_at DESC, triple_id DESC) = 1)
"""

_REFS = "(SELECT 'subject' AS ref_field, subject AS uid, edge_id, seen_at FROM dgraph_edge WHERE subject IS NOT NULL UNION ALL SELECT 'objectuid', objectuid, edge_id, seen_at FROM dgraph_edge WHERE objectuid IS NOT NULL)"

QUERIES = {f.__name__: f for f in (p3_found, p3_by_month, p4_found, p4_wide, p5_found, p5_key_summary)}

SQL = {
    "p3_found": _BROKEN + "SELECT * FROM found",
    "p3_by_month": _BROKEN + "SELECT 'dgraph_edge' AS table_name, ref_field, reason, seen_month, count(*) AS n_refs FROM found GROUP BY ALL",
    "p4_found": _CELLS + "SELECT * FROM cells",
    "p5_found": f"SELECT ref_field, uid, edge_id FROM {_REFS} QUALIFY row_number() OVER (PARTITION BY ref_field, uid ORDER BY seen_at DESC, edge_id DESC) = 1",
    "p5_key_summary": f"SELECT ref_field, uid, count(*) AS n_rows, min(seen_at) AS first_at, max(seen_at) AS last_at FROM {_REFS} GROUP BY ALL",
}
