"""From files to flows: what the command line runs, for use from a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.analytics import summary
from .operators.sessions import session_flows
from .plans.filter_lang import compile_filter, flow_columns
from .sources.datasources import decode_snapshots, read_captures


def flows_of(spark: SparkSession, path: str, transport: str = "record") -> DataFrame:
    """Flows of the captures on a path. Every stream of a capture is a session of its own, to which no schema or
    template carries over; with ``transport="file"`` a file's streams are one session. Files number their streams
    alike, so the hash of the stream's full name is the session's number."""
    found = read_captures(spark, path, transport=transport)
    if transport == "record":
        found = found.withColumn("transport_id", F.xxhash64("stream_id"))
    return session_flows(found).withColumn("template_id", F.lit(0))


def run(spark: SparkSession, path: str, condition: str | None = None, transport: str = "record") -> DataFrame:
    flows = flows_of(spark, path, transport)
    return flows.where(compile_filter(condition, flows, flow_columns(flows))) if condition else flows


def snapshot_summary(spark: SparkSession, path: str, n: int = 16) -> dict[str, DataFrame]:
    """Histograms and top lists of snapshot files."""
    return summary(decode_snapshots(spark.read.format("binaryFile").load(path), "content"), n)
