"""A session with the settings this package is tested with."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession


def get_session(master: str | None = None, checkpoint_dir: str | None = None, conf: Mapping[str, str] | None = None) -> SparkSession:
    """Adaptive execution with skewed joins split, UTC, filters pushed down to Python sources. ``checkpoint_dir`` must be
    shared by all executors; a session in one process makes its own if it is None."""
    b = SparkSession.builder.appName("graphskein").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.python.filterPushdown.enabled", "true")
    if master:
        b = b.master(master)
    if checkpoint_dir:
        b = b.config("spark.checkpoint.dir", checkpoint_dir)
    return b.config(map=dict(conf or {})).getOrCreate()
