"""The session settings that the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "ctxspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow; conf overrides. A cluster sets its own partition counts."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        settings |= {"spark.sql.shuffle.partitions": str(os.cpu_count() or 8), "spark.ui.enabled": "false"}
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
