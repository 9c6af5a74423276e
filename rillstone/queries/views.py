"""Views of the test tables as events, in Spark and in SQL. All arithmetic is on whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table

FLOW_EVENTS = """
SELECT l_suppkey AS src, l_partkey % 10 AS dst, CAST(l_linenumber AS BIGINT) AS flow_id,
  1024 + l_suppkey % 16 AS sport,
  CAST(CASE l_linenumber % 4 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 ELSE 22 END AS BIGINT) AS dport,
  CAST(CASE l_returnflag WHEN 'A' THEN 6 WHEN 'N' THEN 17 ELSE 1 END AS BIGINT) AS proto,
  CAST(floor(l_extendedprice) AS BIGINT) AS octets, CAST(l_quantity AS BIGINT) AS packets,
  CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 1000 AS ts_ms,
  (l_orderkey * 100 + l_linenumber) * 10000000 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 10000000 AS ord
FROM lineitem
"""

FLOWS = f"""
SELECT src, dst, flow_id, sport, dport, proto, CAST(sum(octets) AS BIGINT) AS octets, CAST(sum(packets) AS BIGINT) AS packets,
  count(*) AS records, arg_min(ts_ms, ord) AS first_ms, arg_max(ts_ms, ord) AS last_ms, min(ord) AS ord
FROM ({FLOW_EVENTS}) GROUP BY src, dst, flow_id, sport, dport, proto
"""

CONV_EVENTS = """
SELECT l_suppkey % 10 AS src, l_partkey % 10 AS dst, 1024 + l_suppkey % 10 AS sport, 1024 + l_partkey % 10 AS dport,
  CAST(6 AS BIGINT) AS proto, CAST(floor(l_extendedprice) AS BIGINT) AS octets, CAST(l_quantity AS BIGINT) AS packets
FROM lineitem
"""

METRIC_EVENTS = """
SELECT user_id AS key, event_type AS name, CAST(round(value * 100) AS BIGINT) AS v, epoch_us(ts) // 1000 AS ts_ms,
  (event_id + (event_id * 37) % 50) * 100000 + event_id AS ord, event_id
FROM events
"""


def flow_events(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "lineitem")
    k = F.col("l_linenumber") % 4
    port = F.when(k == 0, 80).when(k == 1, 443).when(k == 2, 53).otherwise(22)
    proto = F.when(F.col("l_returnflag") == "A", 6).when(F.col("l_returnflag") == "N", 17).otherwise(1)
    return t.select(
        F.col("l_suppkey").alias("src"),
        (F.col("l_partkey") % 10).alias("dst"),
        F.col("l_linenumber").cast("long").alias("flow_id"),
        (1024 + F.col("l_suppkey") % 16).alias("sport"),
        port.cast("long").alias("dport"),
        proto.cast("long").alias("proto"),
        F.floor("l_extendedprice").cast("long").alias("octets"),
        F.col("l_quantity").cast("long").alias("packets"),
        (F.datediff("l_shipdate", F.lit("1970-01-01").cast("date")).cast("long") * 1000).alias("ts_ms"),
        ((F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 10_000_000 + F.floor(F.col("l_extendedprice") * 100).cast("long") % 10_000_000).alias("ord"),
    )


def conv_events(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "lineitem")
    src, dst = F.col("l_suppkey") % 10, F.col("l_partkey") % 10
    return t.select(src.alias("src"), dst.alias("dst"), (1024 + src).alias("sport"), (1024 + dst).alias("dport"), F.lit(6).cast("long").alias("proto"), F.floor("l_extendedprice").cast("long").alias("octets"), F.col("l_quantity").cast("long").alias("packets"))


def metric_events(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "events")
    return t.select(
        F.col("user_id").alias("key"),
        F.col("event_type").alias("name"),
        F.round(F.col("value") * 100).cast("long").alias("v"),
        F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ts_ms"),
        ((F.col("event_id") + (F.col("event_id") * 37) % 50) * 100000 + F.col("event_id")).alias("ord"),
        "event_id",
    )
