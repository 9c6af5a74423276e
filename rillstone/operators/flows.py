"""Flow records: accumulation, sessions by idle gaps, expiry, pairing, derived statistics.

An event has the six key columns, ``octets``, ``packets``, ``ts_ms`` and ``ord``, its place in arrival
order; nothing here relies on the order of a DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import div, wrapping_sum
from ..types import FLOW_KEY

# Defaults of the expiry policy, in milliseconds, and its cap on records.
IDLE_MS, ACTIVE_MS, RECORD_CAP = 15_000, 300_000, 1 << 20


def accumulate(events: DataFrame, keys: Sequence[str] = FLOW_KEY, wrap: bool = False) -> DataFrame:
    """One row for each key: sums, records, the first and the latest arrival's time, first ``ord``.

    The last time is that of the latest arrival, which need not be the greatest. Sums raise on
    overflow; with ``wrap`` they wrap at 64 bits. One partial and one final aggregation.
    """
    total = wrapping_sum if wrap else F.sum
    return events.groupBy(*keys).agg(
        total(F.col("octets")).alias("octets"),
        total(F.col("packets")).alias("packets"),
        F.count("*").alias("records"),
        F.min_by("ts_ms", "ord").alias("first_ms"),
        F.max_by("ts_ms", "ord").alias("last_ms"),
        F.min("ord").alias("ord"),
    )


def bindings(events: DataFrame, keys: Sequence[str] = FLOW_KEY) -> DataFrame:
    """Each flow's latest template and whether one template ever came with another generation.

    Two generations of one template next to each other, among the records of a flow and template, are
    told by the least and the greatest one, so no sort is needed.
    """
    per_template = events.groupBy(*keys, "template_id").agg(
        F.min("template_gen").alias("lo"), F.max("template_gen").alias("hi"), F.max(F.struct("ord", "template_gen")).alias("last")
    )
    return per_template.groupBy(*keys).agg(
        F.max_by("template_id", "last").alias("template_id"), F.max(F.col("last"))["template_gen"].alias("template_gen"), F.bool_or(F.col("lo") != F.col("hi")).alias("layout_changed")
    )


def idle_sessions(events: DataFrame, idle: int, session: str = "session", clock: str = "clock", keys: Sequence[str] = FLOW_KEY) -> DataFrame:
    """Events with ``incarnation``, counted from 0 for each flow: a sweep after each record expires
    flows that have been idle.

    A record is swept after it is stored, so a returning flow survives its gap unless another record
    of the session fell in it at or after ``last + idle``: that is, unless the record just before it
    did. An idle time of 0 keeps flows for ever.
    """
    in_session = Window.partitionBy(session).orderBy(clock)
    in_flow = Window.partitionBy(session, *keys).orderBy(clock)
    before = events.withColumn("__before", F.lag(clock).over(in_session)).withColumn("__last", F.lag(clock).over(in_flow))
    gone = F.coalesce(F.col("__before") >= F.col("__last") + idle, F.lit(False)) & F.lit(idle > 0)
    return before.withColumn("incarnation", F.sum(gone.cast("int")).over(in_flow).cast("long")).drop("__before", "__last")


def idle_flows(events: DataFrame, idle: int, session: str = "session", clock: str = "clock", keys: Sequence[str] = FLOW_KEY) -> DataFrame:
    """One row for each life of a flow."""
    return accumulate(idle_sessions(events, idle, session, clock, keys), [session, *keys, "incarnation"])


def expiry(now: Column, closing: Column | None = None, idle: int = IDLE_MS, active: int = ACTIVE_MS, cap: int = RECORD_CAP) -> Column:
    """Why a flow expires at ``now``: closing, record_cap, idle, active or none, in this order."""
    first, last = F.col("first_ms"), F.col("last_ms")
    out = F.when(F.col("records") >= cap, "record_cap").when(now - last >= idle, "idle").when(now - first >= active, "active").otherwise("none")
    return out if closing is None else F.when(closing, "closing").otherwise(out)


def idle_deadline(idle: int = IDLE_MS) -> Column:
    top = F.lit((1 << 63) - 1)
    return F.when(F.col("last_ms") > top - idle, top).otherwise(F.col("last_ms") + idle)


def stats(flows: DataFrame, elephant_bps: int = 1_000_000) -> DataFrame:
    """Duration, rates, mean packet, burstiness (0 to 100) and the elephant flag of each flow."""
    zero = F.lit(0).cast("long")
    d = F.greatest(F.col("last_ms") - F.col("first_ms"), zero)
    top = F.lit((1 << 63) - 1)
    bits = F.when(F.col("octets") > top / 8, top).otherwise(F.col("octets") * 8)
    seconds = F.greatest(d, F.lit(1).cast("long")) / F.lit(1000.0)
    with_rates = flows.withColumn("duration_ms", d).withColumn("bps", F.floor(bits / seconds).cast("long")).withColumn("pps", F.floor(F.col("packets") / seconds).cast("long"))
    mean = F.when(F.col("packets") == 0, zero).otherwise(div(F.col("octets"), F.nullif(F.col("packets"), zero)))
    bursts = F.least(F.lit(100).cast("long"), div(div(F.col("bps"), F.greatest(F.col("records"), F.lit(1).cast("long"))), F.lit(1024).cast("long")))
    return with_rates.withColumns({"mean_packet": mean, "burstiness": F.when(F.col("duration_ms") == 0, F.lit(100).cast("long")).otherwise(bursts), "elephant": F.col("bps") >= elephant_bps})


def is_forward() -> Column:
    """Whether the source is the smaller (address, port) end."""
    return F.struct("src", "sport") <= F.struct(F.col("dst").alias("src"), F.col("dport").alias("sport"))


def biflows(flows: DataFrame) -> DataFrame:
    """Both directions of a conversation in one row; the key leaves flow_id out. No self-join."""
    fwd = is_forward()
    pick = lambda a, b: F.when(fwd, F.col(a)).otherwise(F.col(b))
    keyed = flows.select(pick("src", "dst").alias("a"), pick("dst", "src").alias("b"), pick("sport", "dport").alias("aport"), pick("dport", "sport").alias("bport"), "proto", fwd.alias("fwd"), "octets", "packets")
    part = lambda c, d: F.coalesce(F.sum(F.when(F.col("fwd") == d, F.col(c))), F.lit(0).cast("long"))
    out = keyed.groupBy("a", "b", "aport", "bport", "proto").agg(
        part("octets", True).alias("fwd_octets"), part("octets", False).alias("rev_octets"), part("packets", True).alias("fwd_packets"), part("packets", False).alias("rev_packets")
    )
    ratio = F.when(F.col("rev_octets") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("fwd_octets").cast("double"), F.col("rev_octets").cast("double")))
    return out.withColumn("total_octets", F.col("fwd_octets") + F.col("rev_octets")).withColumn("ratio", ratio)


def direction(flows: DataFrame) -> DataFrame:
    return flows.withColumn("direction", F.when(is_forward(), "forward").otherwise("reverse")).withColumn("server_is_dst", F.col("dport") < F.col("sport"))


def same_conversation(a: str, b: str) -> Column:
    """Whether two structs of key columns are one conversation, either way round."""
    x, y = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    same = (x("src") == y("src")) & (x("dst") == y("dst")) & (x("sport") == y("sport")) & (x("dport") == y("dport"))
    swapped = (x("src") == y("dst")) & (x("dst") == y("src")) & (x("sport") == y("dport")) & (x("dport") == y("sport"))
    return (same | swapped) & (x("flow_id") == y("flow_id")) & (x("proto") == y("proto"))


def merge_snapshots(a: DataFrame, b: DataFrame, ord: str = "ord") -> DataFrame:
    """Flows of two snapshots by (src, dst, flow_id): sums, greatest last time, the rest from the first."""
    both = a.withColumn("__side", F.lit(0)).unionByName(b.withColumn("__side", F.lit(1)))
    place = F.struct("__side", ord)
    others = [c for c in a.columns if c not in ("src", "dst", "flow_id", "octets", "packets", "records", "last_ms", ord)]
    first = F.min(F.struct(place.alias("p"), *others)).alias("__first")
    out = both.groupBy("src", "dst", "flow_id").agg(F.sum("octets").alias("octets"), F.sum("packets").alias("packets"), F.sum("records").alias("records"), F.max("last_ms").alias("last_ms"), first)
    return out.select("src", "dst", "flow_id", "octets", "packets", "records", "last_ms", *[F.col("__first")[c].alias(c) for c in others])


def message_metrics(messages: DataFrame) -> DataFrame:
    """Counters of a session over its messages, one row for each transport."""
    return messages.groupBy("transport_id").agg(
        F.count_if(F.col("error").isNull()).alias("messages"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.coalesce(F.sum(F.length("payload")), F.lit(0)).cast("long").alias("bytes"),
        F.count_if(F.col("type_name") == "DATA_RECORD").alias("records"),
        F.count_if(F.col("type_name") == "FLOW_OPEN").alias("flows_opened"),
        F.count_if(F.col("type_name") == "TEMPLATE_DEF").alias("templates"),
        F.count_if(F.col("type_name") == "FRAGMENT").alias("fragments"),
    )


def quota_denials(events: DataFrame, limit: int, owner: str, amount: str, ord: str = "ord") -> DataFrame:
    """Acquisitions (positive) and releases (negative) with ``held`` so far and ``over`` the limit."""
    so_far = F.sum(amount).over(Window.partitionBy(owner).orderBy(ord).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return events.withColumn("held", so_far.cast("long")).withColumn("over", F.col("held") > limit)
