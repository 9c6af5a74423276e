"""Session factory with the settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings for any deployment; partition counts are left to AQE and to the cluster's own defaults.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "rillstone", **conf: str) -> SparkSession:
    """Return a session; ``conf`` keys use ``__`` for dots (``spark__ui__enabled='false'``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (BASE_CONF | {k.replace("__", "."): str(v) for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of the test layout by Spark's own reader (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
