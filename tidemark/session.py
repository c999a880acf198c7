"""Session settings that results depend on: UTC, ANSI mode, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; master is left to spark-submit unless given."""
    builder = SparkSession.builder.appName("tidemark").config(map=SETTINGS | {k.replace("_", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()
