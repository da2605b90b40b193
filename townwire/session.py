"""A Spark session with the settings that the engine's results rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "townwire", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, AQE on. A cluster's own settings win: master and memory are only set where given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": os.environ.get("TOWNWIRE_UI", "false"),
    }
    return builder.config(map=defaults | conf).getOrCreate()
