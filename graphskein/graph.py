"""A property graph: a vertices and an edges DataFrame."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Graph:
    """``vertices`` has a column ``id``, ``edges`` have ``src`` and ``dst`` of its type; both may have any others.

    Edges are a bag: parallel edges and self-loops are legal and count as often as they stand there. Edges with a null
    end are left out. An edge to an id without vertex is an edge like others, but only vertices get result rows.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame):
        for df, names in ((vertices, ("id",)), (edges, ("src", "dst"))):
            if missing := [n for n in names if n not in df.columns]:
                raise ValueError(f"missing columns: {missing}")
        self.vertices = vertices
        self.edges = edges.where("src is not null and dst is not null")

    @classmethod
    def from_columns(cls, vertices: DataFrame, edges: DataFrame, id: str = "id", src: str = "src", dst: str = "dst") -> Graph:
        """A graph of tables whose key columns have other names."""
        return cls(vertices.withColumnRenamed(id, "id"), edges.withColumnsRenamed({src: "src", dst: "dst"}))

    @property
    def ids(self) -> DataFrame:
        """The distinct vertex ids."""
        return self.vertices.select("id").where("id is not null").distinct()

    def without_dangling(self) -> Graph:
        """The same without edges whose ends are not both vertices."""
        ids = self.ids
        kept = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(self.vertices, kept.select(*self.edges.columns))

    def weighted(self, weight: str | None = None) -> DataFrame:
        """Edges as ``src, dst, w``; ``w`` is 1.0 without a weight column."""
        return self.edges.select("src", "dst", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))

    def directed(self, undirected: bool = False, weight: str | None = None) -> DataFrame:
        """:meth:`weighted`, with every edge in both directions if ``undirected``."""
        e = self.weighted(weight)
        return e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")) if undirected else e

    def filter_edges(self, condition: Column | str) -> Graph:
        return Graph(self.vertices, self.edges.where(condition))

    def with_measure(self, measure: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
        """The vertices with the columns of ``measure(id, ...)``; ``defaults`` where it has no row. A vertex column of the
        same name is replaced."""
        kept = self.vertices.drop(*[c for c in measure.columns if c != "id"])
        out = kept.join(measure, "id", "left")
        return out.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in defaults.items() if d is not None})
