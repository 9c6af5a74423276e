"""Fragments, windows and fixed-stride sections."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of one reassembly.
WINDOW_SIZE, MAX_FRAGMENTS = 4096, 256


def accepted(fragments: DataFrame, keys: Sequence[str], ord: str = "ord", max_fragments: int = MAX_FRAGMENTS, max_bytes: int = 4 * WINDOW_SIZE) -> DataFrame:
    """The fragments that the limits of count and bytes let in, in order of arrival.

    One that is refused takes no room, so a later, shorter one may still get in: a fold over the
    flow's sizes, which are few, carries the totals.
    """
    sizes = F.array_sort(F.collect_list(F.struct(F.col(ord).alias("o"), F.length("data").cast("long").alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("bytes"), F.array().cast("array<long>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        ok = (F.size(s["kept"]) < max_fragments) & (s["bytes"] + x["n"] <= max_bytes)
        return F.when(ok, F.struct((s["bytes"] + x["n"]).alias("bytes"), F.array_append(s["kept"], x["o"].cast("long")).alias("kept"))).otherwise(s)

    kept = fragments.groupBy(*keys).agg(F.aggregate(sizes, start, step)["kept"].alias("__kept")).select(*keys, F.explode("__kept").alias(ord))
    return fragments.join(kept, [*keys, ord], "left_semi")


def merge_bytes(base: int, parts: list[tuple[int, bytes]], limit: int) -> bytes:
    """Parts by offset, later ones of equal offset last, written over each other; holes are zero."""
    out = bytearray()
    for offset, data in sorted(parts, key=lambda p: p[0]):
        at = offset - base
        if at < 0:
            raise ValueError("fragment before the base")
        if at + len(data) > limit:
            raise ValueError("extent over limit")
        if len(out) < at + len(data):
            out.extend(bytes(at + len(data) - len(out)))
        out[at : at + len(data)] = data
    return bytes(out)


def reassemble(fragments: DataFrame, keys: Sequence[str], ord: str = "ord", base: str | None = None, limit: int = 4 * WINDOW_SIZE) -> DataFrame:
    """``keys, data, error``: each flow's bytes. A flow is bounded by its limits, so a group is small."""
    at = F.lit(0).cast("long") if base is None else F.col(base).cast("long")
    rows = fragments.select(*keys, at.alias("__base"), F.col("offset").cast("long").alias("__off"), F.col(ord).alias("__ord"), F.col("data").alias("__data"))
    names = list(keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fragments.select(*keys).schema) + ", data binary, error string"

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__ord", kind="stable")
        out = {k: [group[k].iloc[0]] for k in names}
        try:
            out |= {"data": [merge_bytes(int(group["__base"].iloc[-1]), list(zip(group["__off"].tolist(), group["__data"].tolist(), strict=True)), limit)], "error": [None]}
        except ValueError as e:
            out |= {"data": [None], "error": [str(e)]}
        return pd.DataFrame(out)

    return rows.groupBy(*keys).applyInPandas(one, schema)


class RingWindow:
    """A byte ring addressed by sequence number; its size is the next power of two from 64 on."""

    def __init__(self, size: int = WINDOW_SIZE):
        self.size = max(64, 1 << (max(size, 1) - 1).bit_length())
        self.buffer = bytearray(self.size)
        self.high = 0

    def place(self, seq: int, data: bytes) -> None:
        if len(data) > self.size:
            raise ValueError("data over the window")
        at = seq % self.size
        first = data[: self.size - at]
        self.buffer[at : at + len(first)] = first
        self.buffer[: len(data) - len(first)] = data[len(first) :]
        self.high = max(self.high, seq + len(data))

    def read(self, seq: int, n: int) -> bytes:
        if n > self.size:
            raise ValueError("read over the window")
        at = seq % self.size
        return bytes((self.buffer[at:] + self.buffer[:at])[:n])


def seek(df: DataFrame, keys: Sequence[str], delta: str, size: int, ord: str) -> DataFrame:
    """Cursor positions after relative seeks; one that would leave 0..size changes nothing."""
    moves = F.array_sort(F.collect_list(F.struct(F.col(ord).alias("o"), F.col(delta).cast("long").alias("d"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("refused"))

    def step(s: Column, m: Column) -> Column:
        to = s["at"] + m["d"]
        ok = to.between(0, size)
        return F.struct(F.when(ok, to).otherwise(s["at"]).alias("at"), F.when(ok, s["refused"]).otherwise(s["refused"] + 1).alias("refused"))

    return df.groupBy(*keys).agg(F.aggregate(moves, start, step).alias("s")).select(*keys, "s.at", "s.refused")


def section_rows(df: DataFrame, body: str, count: Column, stride: Column) -> DataFrame:
    """``df`` with ``row, bytes`` of each whole row of a grid of ``count`` rows of ``stride`` bytes."""
    whole = F.least(count, F.floor(F.length(body) / stride).cast("int"))
    rows = F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.substring(F.col(body), i * stride + 1, stride)))
    return df.select("*", F.posexplode(rows).alias("row", "bytes"))


def latest(df: DataFrame, keys: Sequence[str], ord: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key, as a ring buffer keeps them."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(ord).desc()))).where(F.col("__r") <= n).drop("__r")


def channel_gauge(events: DataFrame, key: str, ord: str, kind: str) -> DataFrame:
    """Live channels after each event: open counts every time, alloc if the channel is not there,
    teardown if it is."""
    before = F.lag(kind).over(Window.partitionBy(key, "channel").orderBy(ord))
    live_before = before.isNotNull() & (before != "teardown")
    change = F.when(F.col(kind) == "open", 1).when((F.col(kind) == "alloc") & ~live_before, 1).when((F.col(kind) == "teardown") & live_before, -1).otherwise(0)
    run = Window.partitionBy(key).orderBy(ord).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("__c", change).withColumn("live", F.sum("__c").over(run).cast("long")).drop("__c")
