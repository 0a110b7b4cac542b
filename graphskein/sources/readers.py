"""Whole graphs from stores and files."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphskein.graph import Graph
from graphskein.sources import register

# fixed values: catalogs of a property graph kept in a wide-column store
VERTEX_COLUMNS = {"id": {"cf": "rowkey", "col": "key", "type": "string"}, "name": {"cf": "f", "col": "name", "type": "string"}, "age": {"cf": "f", "col": "age", "type": "int"}}
EDGE_COLUMNS = {"id": {"cf": "rowkey", "col": "key", "type": "string"}, "relationship": {"cf": "f", "col": "~l", "type": "string"}, "src": {"cf": "f", "col": "~f", "type": "string"}, "dst": {"cf": "f", "col": "~t", "type": "string"}}


def catalog(namespace: str, table: str, columns: Mapping, coder: str = "typed") -> str:
    """A JSON catalog with the key column 'key'."""
    return json.dumps({"table": {"namespace": namespace, "name": table, "tableCoder": coder, "version": "2.0"}, "rowkey": "key", "columns": columns})


class GraphStoreGraphs:
    """Vertices are the store's wide nodes, edges its links. ``properties`` has ``targets`` and any option of the formats."""

    def __init__(self, spark: SparkSession, properties: Mapping[str, str]):
        register(spark)
        self.spark, self.options = spark, {("dgraph.targets" if k == "targets" else k): v for k, v in properties.items()}

    def load_vertices(self) -> DataFrame:
        """Column ``subject`` becomes ``id``; in other names '_' becomes '__' and then '.' becomes '_'."""
        nodes = self.spark.read.format("graph-nodes").options(**self.options | {"dgraph.nodes.mode": "wide"}).load()
        return nodes.select(*(F.col(f"`{c}`").alias("id" if c == "subject" else c.replace("_", "__").replace(".", "_")) for c in nodes.columns))

    def load_edges(self) -> DataFrame:
        links = self.spark.read.format("graph-edges").options(**self.options).load()
        return links.select(F.col("subject").alias("src"), F.col("objectUid").alias("dst"), "predicate")

    def load_graph(self) -> Graph:
        return Graph(self.load_vertices(), self.load_edges())


class WideColumnGraphs:
    """Vertices and edges of the tables 'vertices' and 'edges' in ``hbase.namespace`` (or ``namespace``)."""

    def __init__(self, spark: SparkSession, properties: Mapping[str, str], vertex_columns: Mapping = VERTEX_COLUMNS, edge_columns: Mapping = EDGE_COLUMNS):
        register(spark)
        options = dict(properties)
        self.namespace = options.pop("hbase.namespace", None) or options.pop("namespace", "default")
        self.spark, self.options, self.columns = spark, options, {"vertices": vertex_columns, "edges": edge_columns}

    def _load(self, table: str) -> DataFrame:
        return self.spark.read.format("wide-column").options(**self.options).option("catalog", catalog(self.namespace, table, self.columns[table])).load()

    def load_vertices(self) -> DataFrame:
        return self._load("vertices")

    def load_edges(self) -> DataFrame:
        return self._load("edges")

    def load_graph(self) -> Graph:
        return Graph(self.load_vertices(), self.load_edges())


class FileGraphs:
    """``vertices`` and ``edges`` are paths of files in ``format`` (parquet, orc, csv, json, jdbc, ...)."""

    def __init__(self, spark: SparkSession, properties: Mapping[str, str]):
        self.spark, self.options = spark, dict(properties)

    def _load(self, what: str) -> DataFrame:
        extra = {k: v for k, v in self.options.items() if k not in ("vertices", "edges", "format")}
        return self.spark.read.format(self.options.get("format", "parquet")).options(**extra).load(self.options[what])

    def load_vertices(self) -> DataFrame:
        return self._load("vertices")

    def load_edges(self) -> DataFrame:
        return self._load("edges")

    def load_graph(self) -> Graph:
        return Graph(self.load_vertices(), self.load_edges())


class ReaderFactory:
    """The readers by kind of store."""

    @staticmethod
    def from_dgraph(spark: SparkSession, properties: Mapping[str, str]) -> Graph:
        return GraphStoreGraphs(spark, properties).load_graph()

    @staticmethod
    def from_hgraph(spark: SparkSession, properties: Mapping[str, str]) -> Graph:
        return WideColumnGraphs(spark, properties).load_graph()

    @staticmethod
    def from_files(spark: SparkSession, properties: Mapping[str, str]) -> Graph:
        return FileGraphs(spark, properties).load_graph()

    @staticmethod
    def from_igraph(spark: SparkSession, properties: Mapping[str, str]) -> Graph:
        raise NotImplementedError("no reader for this store")

    fromDgraph, fromHgraph, fromIgraph = from_dgraph, from_hgraph, from_igraph
