"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # call sites of column expressions are not needed and slow plans of many expressions down
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # compiled code of long plans is kept from one run to the next; the default holds less than one chain needs
    "spark.sql.codegen.cache.maxEntries": "2000",
    # keep window and aggregate operators from hiding a skewed join from AQE
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def session(app: str = "heatloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; keyword ``settings`` use ``__`` for dots and win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
