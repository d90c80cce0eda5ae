"""Session builder with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "lodestrata", **conf: str) -> SparkSession:
    """AQE, Arrow and UTC on; the caller's settings win. Master and memory come from the deployment."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
