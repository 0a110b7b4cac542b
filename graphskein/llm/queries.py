"""Queries of this subpackage's operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphskein.llm.components import connected_groups
from graphskein.llm.encoding import token_ids
from graphskein.llm.packing import pack_documents
from graphskein.llm.spans import shared_part, shared_spans
from graphskein.llm.topn import top_vertices


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return top_vertices(_table(spark, d, "louvain_result"), _table(spark, d, "vertex_measure"), 10).select("community", "vertex")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return connected_groups(_table(spark, d, "vertex_match"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(_table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(_table(spark, d, "documents"), 4096)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(_table(spark, d, "documents"), 200)


def p8_shared_part(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return shared_part(docs, shared_spans(docs, 200))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p6_ids, p7_containers, p8_found, p8_shared_part)}

SQL = {
    "p1_found": """
WITH c AS (SELECT vertex, community FROM louvain_result WHERE vertex IS NOT NULL AND community IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vertex ORDER BY computed_at DESC, community DESC) = 1),
m AS (SELECT vertex, measure FROM vertex_measure WHERE vertex IS NOT NULL AND measure IS NOT NULL AND NOT isnan(measure) QUALIFY row_number() OVER (PARTITION BY vertex ORDER BY computed_at DESC, measure DESC) = 1)
SELECT community, vertex FROM c JOIN m USING (vertex) QUALIFY row_number() OVER (PARTITION BY community ORDER BY measure DESC, vertex) <= 10
""",
    "p2_found": """
WITH RECURSIVE e AS (SELECT s_vertex AS a, d_vertex AS b FROM vertex_match WHERE s_vertex IS NOT NULL AND d_vertex IS NOT NULL UNION SELECT d_vertex, s_vertex FROM vertex_match WHERE s_vertex IS NOT NULL AND d_vertex IS NOT NULL),
v AS (SELECT s_vertex AS vertex FROM vertex_match WHERE s_vertex IS NOT NULL UNION SELECT d_vertex FROM vertex_match WHERE d_vertex IS NOT NULL),
g(vertex, component) USING KEY (vertex) AS (SELECT vertex, vertex FROM v UNION
  SELECT e.b, min(g.component) FROM g JOIN e ON e.a = g.vertex JOIN recurring.g AS h ON h.vertex = e.b WHERE g.component < h.component GROUP BY e.b)
SELECT vertex, component FROM g
""",
}
