"""Time series, rates and clocks over the events table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import timeseries as ts
from . import query
from .views import METRIC_EVENTS, metric_events

HOUR, DAY = 3_600_000, 86_400_000


@query(f"SELECT name, ts_ms - ts_ms % {HOUR} AS start, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, max(v) AS high FROM ({METRIC_EVENTS}) GROUP BY 1, 2")
def t_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return ts.tumbling(metric_events(spark, d), HOUR, keys=("name",))


@query(f"SELECT name, count(*) AS kept, CAST(sum(v) AS BIGINT) AS total FROM (SELECT *, b >= max(b) OVER (PARTITION BY name ORDER BY ord ROWS UNBOUNDED PRECEDING) AS ok FROM (SELECT *, ts_ms - ts_ms % {HOUR} AS b FROM ({METRIC_EVENTS}))) WHERE ok GROUP BY name")
def t_late_drop(spark: SparkSession, d: str) -> DataFrame:
    return ts.drop_late(metric_events(spark, d), HOUR, ("name",)).groupBy("name").agg(F.count("*").alias("kept"), F.sum("v").alias("total"))


RINGS = f"""WITH b AS (SELECT key, ts_ms - ts_ms % {HOUR} AS start, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, max(v) AS high FROM ({METRIC_EVENTS}) GROUP BY 1, 2),
  s AS (SELECT key, unnest(range(greatest(min(start), max(start) - 47 * {HOUR}), max(start) + 1, {HOUR})) AS start FROM b GROUP BY key)
  SELECT s.key, s.start, coalesce(n, 0) AS n, coalesce(total, 0) AS total, coalesce(high, 0) AS high FROM s LEFT JOIN b ON s.start = b.start AND s.key IS NOT DISTINCT FROM b.key"""


def _rings(spark: SparkSession, d: str) -> DataFrame:
    return ts.ring(ts.tumbling(metric_events(spark, d), HOUR, keys=("key",)), HOUR, 48, ("key",))


@query(RINGS)
def t_ring(spark: SparkSession, d: str) -> DataFrame:
    return _rings(spark, d)


@query(f"SELECT key, sum(n) / CAST(48 * 3600 AS DOUBLE) AS per_second FROM ({RINGS}) GROUP BY key")
def t_rate(spark: SparkSession, d: str) -> DataFrame:
    return ts.rate_per_second(_rings(spark, d), HOUR, 48, ("key",))


@query(f"SELECT name, sec, CAST(sum(s) OVER (PARTITION BY name ORDER BY sec RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_window FROM (SELECT name, ts_ms // 1000 AS sec, sum(v) AS s FROM ({METRIC_EVENTS}) GROUP BY 1, 2)")
def t_sliding(spark: SparkSession, d: str) -> DataFrame:
    return ts.sliding_sum(metric_events(spark, d), 3600, ("name",))


def ewma_model(samples: list[tuple[int, int]], half_life: float) -> float:
    """The sequential definition, for tests."""
    alpha, rate, pending, last = 1 - math.exp(-1000.0 * math.log(2) / half_life), 0.0, 0.0, None
    for t, x in samples:
        last = t if last is None else last
        pending += x
        if t - last >= 1000:
            rate += alpha * (pending / ((t - last) / 1000.0) - rate)
            pending, last = 0.0, t
    return rate


@query(f"""WITH RECURSIVE e AS (SELECT key, ts_ms AS t, CAST(v AS DOUBLE) AS x, row_number() OVER (PARTITION BY key ORDER BY event_id) AS n FROM ({METRIC_EVENTS})),
  f AS (SELECT key, CAST(0 AS BIGINT) AS n, t AS last, CAST(0 AS DOUBLE) AS pending, CAST(0 AS DOUBLE) AS rate FROM e WHERE n = 1
    UNION ALL SELECT f.key, e.n, CASE WHEN e.t - f.last >= 1000 THEN e.t ELSE f.last END, CASE WHEN e.t - f.last >= 1000 THEN CAST(0 AS DOUBLE) ELSE f.pending + e.x END,
      CASE WHEN e.t - f.last >= 1000 THEN f.rate + (1 - exp(-1000.0 * ln(CAST(2 AS DOUBLE)) / CAST(3600000 AS DOUBLE))) * ((f.pending + e.x) / (CAST(e.t - f.last AS DOUBLE) / 1000) - f.rate) ELSE f.rate END
      FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1)
  SELECT key, round(arg_max(rate, n), 9) AS rate FROM f GROUP BY key""")
def t_ewma(spark: SparkSession, d: str) -> DataFrame:
    return ts.ewma(metric_events(spark, d), 3_600_000.0, ("key",), ord="event_id").select("key", F.round("rate", 9).alias("rate"))


@query(f"SELECT name, event_id, row_number() OVER (PARTITION BY name ORDER BY event_id) + 1 AS clock FROM ({METRIC_EVENTS})")
def t_clock(spark: SparkSession, d: str) -> DataFrame:
    return ts.logical_clock(metric_events(spark, d), "name", "event_id").select("name", "event_id", "clock")


@query(f"SELECT name, event_id, max(ts_ms) OVER (PARTITION BY name ORDER BY ord ROWS UNBOUNDED PRECEDING) AS clock FROM ({METRIC_EVENTS})")
def t_observed_clock(spark: SparkSession, d: str) -> DataFrame:
    return ts.observe(metric_events(spark, d), "name", "ord", "ts_ms").select("name", "event_id", "clock")


@query(f"SELECT event_id, lower(lpad(hex(ts_ms), 12, '0')) AS image, ts_ms AS back, greatest(ts_ms - 1577836800000, 0) AS since FROM ({METRIC_EVENTS})")
def t_ts48(spark: SparkSession, d: str) -> DataFrame:
    t = metric_events(spark, d)
    image = C.ts48_bytes(F.col("ts_ms"))
    return t.select("event_id", C.hex_text(image).alias("image"), C.ts48_value(image).alias("back"), C.to_epoch(F.col("ts_ms")).alias("since"))


@query(f"SELECT key, CAST(sum(live) AS BIGINT) AS s, CAST(max(live) AS BIGINT) AS peak FROM (SELECT key, sum(c) OVER (PARTITION BY key ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS live FROM (SELECT *, CASE WHEN kind = 'open' THEN 1 WHEN kind = 'alloc' AND (prev IS NULL OR prev = 'teardown') THEN 1 WHEN kind = 'teardown' AND prev IN ('open', 'alloc') THEN -1 ELSE 0 END AS c FROM (SELECT *, lag(kind) OVER (PARTITION BY key, channel ORDER BY event_id) AS prev FROM (SELECT key, event_id, v % 5 AS channel, CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'alloc' ELSE 'teardown' END AS kind FROM ({METRIC_EVENTS}))))) GROUP BY key")
def r_channels(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.reassembly import channel_gauge

    k = F.col("event_id") % 3
    e = metric_events(spark, d).select("key", "event_id", (F.col("v") % 5).alias("channel"), F.when(k == 0, "open").when(k == 1, "alloc").otherwise("teardown").alias("kind"))
    return channel_gauge(e, "key", "event_id", "kind").groupBy("key").agg(F.sum("live").alias("s"), F.max("live").alias("peak"))
