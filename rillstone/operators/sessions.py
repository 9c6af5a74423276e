"""Session semantics over messages: the open gate, the clock, template resolution, flows.

The native plan holds while a session's templates fit its template cache, which
:func:`templates_fit` checks; :mod:`rillstone.operators.replay` is exact beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.messages import admit, data_records, template_definitions, unnest
from ..types import FLOW_KEY
from .flows import accumulate, idle_sessions
from .joins import as_of
from .ranges import least_after

TEMPLATE_CAPACITY, IDLE_TICKS = 256, 30_000


def clocked(messages: DataFrame) -> DataFrame:
    """Messages that could be read, with ``clock``: one tick each, in order of stream and message.

    The first message of a session reads 2. A stream's messages are numbered by their places in it, so
    only the streams' sizes are put in order.
    """
    good = messages.where("error is null")
    streams = ["transport_id", "capture_ts_ms", "stream_id"]
    sizes = good.groupBy(*streams).agg(F.count("*").alias("__n"), F.min("seq").alias("__first"))
    earlier = Window.partitionBy("transport_id").orderBy("capture_ts_ms", "stream_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(c).alias(f"__{c}") for c in streams], (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + 2).alias("__offset"))
    found = good.join(offsets, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in streams])
    return found.withColumn("clock", (F.col("__offset") + F.col("seq")).cast("long")).drop("__offset", *[f"__{c}" for c in streams])


def resolved_records(messages: DataFrame) -> DataFrame:
    """Data records of open sessions with their template's ``schema_id, field_count, generation``.

    A null generation means that the template was not known: an unresolved record.
    """
    admitted = admit(clocked(messages)).where("opened")
    definitions, records = template_definitions(admitted), data_records(unnest(admitted))
    return as_of(records, definitions, ["transport_id", "template_id"], "clock", ["schema_id", "field_count"])


def session_flows(messages: DataFrame, idle: int = IDLE_TICKS) -> DataFrame:
    """One row for each life of a flow in a session; times are clock ticks."""
    records = resolved_records(messages).where("generation is not null")
    events = records.select("transport_id", *FLOW_KEY, "octets", "packets", F.col("clock").alias("ts_ms"), F.col("clock").alias("ord"), "clock")
    lives = idle_sessions(events, idle, "transport_id", "clock")
    return accumulate(lives, ["transport_id", *FLOW_KEY, "incarnation"])


def templates_fit(messages: DataFrame, capacity: int = TEMPLATE_CAPACITY) -> DataFrame:
    """``transport_id, templates, fits``: whether the native plan is exact for a session."""
    found = template_definitions(messages.where("error is null")).groupBy("transport_id").agg(F.count_distinct("template_id").alias("templates"))
    return found.withColumn("fits", F.col("templates") <= capacity)


def served_requests(events: DataFrame, key: str, ord: str, kind: str = "kind", conn: str = "conn") -> DataFrame:
    """Requests with ``outcome``: served, dropped (reset before the queue ran), waiting or unresolved.

    A request is served if the session's next ``process`` comes before its connection's next ``reset``. Sessions
    may be few and long, so their queues go by ranges.
    """
    at = lambda k: F.when(F.col(kind) == k, F.col(ord))
    # Backwards, as a frame that ends at the last row would be read anew for every row.
    conn_after = Window.partitionBy(key, conn).orderBy(F.desc(ord)).rowsBetween(Window.unboundedPreceding, -1)
    conn_before = Window.partitionBy(key, conn).orderBy(ord).rowsBetween(Window.unboundedPreceding, -1)
    queued = least_after(events, [key], ord, at("process"), "__run")
    marked = queued.withColumn("__reset", F.min(at("reset")).over(conn_after)).withColumn("__open", F.max(F.when(F.col(kind) == "open", 1)).over(conn_before))
    outcome = F.when(F.col("__open").isNull(), "unresolved").when(F.col("__run").isNull(), "waiting").when(F.col("__reset") < F.col("__run"), "dropped").otherwise("served")
    return marked.where(F.col(kind) == "request").withColumn("outcome", outcome).drop("__run", "__reset", "__open")


def handles(events: DataFrame, key: str, ord: str, kind: str = "kind") -> DataFrame:
    """``generation`` of an id at each event: how often it has been opened so far."""
    seen = Window.partitionBy(key).orderBy(ord).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("generation", F.count(F.when(F.col(kind) == "open", 1)).over(seen))


def session_totals(messages: DataFrame) -> DataFrame:
    """``transport_id, streams, messages, records, errors, last_ms`` of every session; a stream that could not
    be read is an error and none of its messages count."""
    good, bad = F.col("error").isNull(), F.col("error").isNotNull()
    record = good & (F.col("type_name") == "DATA_RECORD")
    return messages.groupBy("transport_id").agg(F.count_distinct("stream_id").alias("streams"), F.count_if(good).alias("messages"), F.count_if(record).alias("records"), F.count_if(bad).alias("errors"), F.max("capture_ts_ms").alias("last_ms"))


def broker_totals(sessions: DataFrame) -> DataFrame:
    """One row over all sessions: their number, and the sums of their counters."""
    return sessions.agg(F.count("*").alias("sessions"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("messages", "records", "errors")])


def reapable(sessions: DataFrame, soft_cap: int, idle: int) -> DataFrame:
    """``sessions`` that a broker may let go: idle for ``idle`` ticks behind the latest session, and only
    while there are ``soft_cap`` sessions or more."""
    top = sessions.agg(F.max("last_ms").alias("__top"), F.count("*").alias("__n"))
    found = sessions.join(F.broadcast(top))  # one row
    return found.where((F.col("__n") >= soft_cap) & (F.col("__top") - F.col("last_ms") >= idle)).drop("__top", "__n")
