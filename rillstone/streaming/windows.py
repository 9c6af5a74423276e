"""Structured Streaming: watermarked windows, sessions, and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.replay import Flow, FlowTable
from ..types import FLOW_KEY


def tumbling(events: DataFrame, ts: str, width: str, lateness: str = "0 seconds", keys: tuple[str, ...] = (), value: str = "v") -> DataFrame:
    """Counts and sums of windows that the watermark has passed (in append mode)."""
    return events.withWatermark(ts, lateness).groupBy(*keys, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*keys, F.col("w.start").alias("start"), "n", "total")


def sliding(events: DataFrame, ts: str, width: str, slide: str, lateness: str = "0 seconds", keys: tuple[str, ...] = (), value: str = "v") -> DataFrame:
    return events.withWatermark(ts, lateness).groupBy(*keys, F.window(ts, width, slide).alias("w")).agg(F.sum(value).alias("in_window")).select(*keys, F.col("w.end").alias("end"), "in_window")


def idle_flows(events: DataFrame, ts: str, idle_ms: int, lateness: str = "0 seconds") -> DataFrame:
    """Flows ended by a gap of ``idle_ms``; a record at exactly that gap starts a new flow, hence less 1."""
    gap = F.session_window(ts, f"{idle_ms - 1} milliseconds")
    return events.withWatermark(ts, lateness).groupBy(*FLOW_KEY, gap.alias("w")).agg(F.sum("octets").alias("octets"), F.sum("packets").alias("packets"), F.count("*").alias("records"), F.min(ts).alias("first"), F.max(ts).alias("last")).drop("w")


FLOW_OUT = "session long, src long, dst long, flow_id long, sport int, dport int, proto int, octets long, packets long, records long, first_ms long, last_ms long, reason string"
STATE = "flows array<struct<key:array<long>,octets:long,packets:long,records:long,first_ms:long,last_ms:long>>"


def stateful_flows(events: DataFrame, capacity: int = 65_536, idle: int = 30_000) -> DataFrame:
    """The bounded flow table as a streaming operator: emits flows as they expire or are evicted.

    ``events`` has ``session``, the key columns, ``octets``, ``packets`` and ``clock``; a session's
    batch is applied in order of ``clock``. State is one table a session, of ``capacity`` flows.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        table = FlowTable(capacity, idle)
        if state.exists:
            for row in sorted(state.get[0], key=lambda r: r["first_ms"] if isinstance(r, dict) else r[4]):
                k, octets, packets, records, first, last = row.values() if isinstance(row, dict) else row
                table.live[tuple(k)] = Flow(octets, packets, records, first, last)
            for k in sorted(table.live, key=lambda k: table.live[k].last_ms):
                table.by_last[k] = None
        rows = pd.concat(list(frames)).sort_values("clock", kind="stable")
        for r in rows.itertuples(index=False):
            k = tuple(int(getattr(r, c)) for c in FLOW_KEY)
            table.update(k, int(r.octets), int(r.packets), int(r.clock))
            table.sweep(int(r.clock))
        state.update(([(list(k), f.octets, f.packets, f.records, f.first_ms, f.last_ms) for k, f in table.live.items()],))
        names = [p.split()[0] for p in FLOW_OUT.split(", ")]
        yield pd.DataFrame([(int(key[0]), *k, f.octets, f.packets, f.records, f.first_ms, f.last_ms, why) for k, f, why in table.emitted], columns=names)

    return events.groupBy("session").applyInPandasWithState(step, FLOW_OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def tee(df: DataFrame, *sinks):
    """A stream written to several sinks, each a function of (frame, batch id), from one cached batch."""

    def each(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for sink in sinks:
                sink(kept, number)
        finally:
            kept.unpersist()

    return df.writeStream.foreachBatch(each)
