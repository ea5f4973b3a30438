"""Sessions with the settings that the results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """Session in UTC, adaptive, with Arrow batches; ``conf`` overrides (dots as two underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
