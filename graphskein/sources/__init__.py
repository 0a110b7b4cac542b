"""Sources and sinks: graph stores, wide-column stores, files."""

from pyspark.sql import SparkSession

from graphskein.sources.graphstore import EdgeSource, NodeSource, TripleSource
from graphskein.sources.widecolumn import WideColumnSource


def register(spark: SparkSession) -> None:
    """Makes the formats known to ``spark`` and lets it push filters down to them."""
    for source in (TripleSource, NodeSource, EdgeSource, WideColumnSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
