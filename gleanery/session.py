"""The Spark session that the engine's results are defined under."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Times are UTC; plans adapt to the sizes that stages turn out to have.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "gleanery", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (CONF | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
