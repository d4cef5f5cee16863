"""Session defaults. A session that already exists is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "terrasift", master: str | None = None, **conf: str) -> SparkSession:
    """The active session, or a new one with DEFAULTS and conf on top."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | conf).getOrCreate()
