"""Bucketed series, late samples, rates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import div
from .ranges import row_numbers, running_max


def bucket(ts: Column, resolution: int) -> Column:
    return ts - F.pmod(ts, F.lit(resolution).cast("long"))


def tumbling(df: DataFrame, resolution: int, ts: str = "ts_ms", value: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """``start, n, total, high`` of each bucket (and key) that has samples."""
    start = bucket(F.col(ts), resolution).alias("start")
    return df.groupBy(*keys, start).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("high"))


def drop_late(df: DataFrame, resolution: int, keys: tuple[str, ...], ts: str = "ts_ms", ord: str = "ord") -> DataFrame:
    """Samples that are not older, by bucket, than any sample of their series before them."""
    bucketed = df.withColumn("__b", bucket(F.col(ts), resolution))
    return running_max(bucketed, keys, ord, "__b", "__top").where(F.col("__b") >= F.col("__top")).drop("__b", "__top")


def ring(buckets: DataFrame, resolution: int, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The last ``n`` buckets of each series, gaps as zeros, oldest first, none before the first sample."""
    ends = buckets.groupBy(*keys).agg(F.min("start").alias("lo"), F.max("start").alias("hi")).where("hi is not null")
    first = F.greatest("lo", F.col("hi") - (n - 1) * resolution)
    slots = ends.select(*keys, F.explode(F.sequence(first, F.col("hi"), F.lit(resolution).cast("long"))).alias("start"))
    zero = F.lit(0).cast("long")
    if keys:  # null is a key like any other
        at = (*keys, "start")
        slots = slots.select(*[F.col(c).alias(f"__{c}") for c in at])
        joined = slots.join(buckets, [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in at], "left")
        return joined.select(*[F.col(f"__{c}").alias(c) for c in at], *[F.coalesce(c, zero).alias(c) for c in ("n", "total", "high")])
    return F.broadcast(slots).join(buckets, "start", "left").select("start", *[F.coalesce(c, zero).alias(c) for c in ("n", "total", "high")])


def rate_per_second(slots: DataFrame, resolution: int, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """All samples of each series' ring over its whole span, filled or not."""
    return slots.groupBy(*keys).agg((F.coalesce(F.sum("n"), F.lit(0)) / F.lit(n * resolution / 1000.0)).alias("per_second"))


def sliding_sum(df: DataFrame, seconds: int, keys: tuple[str, ...], ts: str = "ts_ms", value: str = "v") -> DataFrame:
    """``sec, in_window`` for every second with samples: the sum over the last ``seconds`` seconds.

    Seconds are summed first, so the window sorts seconds and not samples.
    """
    per = df.groupBy(*keys, div(F.col(ts), F.lit(1000).cast("long")).alias("sec")).agg(F.sum(value).alias("s"))
    over = Window.partitionBy(*keys).orderBy("sec").rangeBetween(-(seconds - 1), 0)
    return per.select(*keys, "sec", F.sum("s").over(over).alias("in_window"))


def ewma(df: DataFrame, half_life_ms: float, keys: tuple[str, ...], ts: str = "ts_ms", value: str = "v", ord: str = "ord") -> DataFrame:
    """``keys, rate``: an exponentially weighted rate, folded at most once a second in order of ``ord``.

    The fold needs a series in one place and in order, so choose ``keys`` with series that fit a task.
    """
    alpha = 1 - math.exp(-1000.0 * math.log(2) / half_life_ms)
    samples = F.array_sort(F.collect_list(F.struct(ord, F.col(ts).alias("t"), F.col(value).cast("double").alias("x"))))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0.0).alias("pending"), F.lit(0.0).alias("rate"))

    def step(s: Column, x: Column) -> Column:
        last = F.coalesce(s["last"], x["t"])
        pending, elapsed = s["pending"] + x["x"], x["t"] - last
        instant = F.try_divide(pending, elapsed / F.lit(1000.0))
        folded = F.struct(x["t"].alias("last"), F.lit(0.0).alias("pending"), (s["rate"] + F.lit(alpha) * (instant - s["rate"])).alias("rate"))
        return F.when(elapsed >= 1000, folded).otherwise(F.struct(last.alias("last"), pending.alias("pending"), s["rate"].alias("rate")))

    return df.groupBy(*keys).agg(F.aggregate(samples, start, step, lambda s: s["rate"]).alias("rate"))


def logical_clock(df: DataFrame, key: str, ord: str, start: int = 1) -> DataFrame:
    """One tick a message: the first message of a session reads ``start + 1``."""
    return row_numbers(df, [key], ord, "clock").withColumn("clock", F.col("clock") + start)


def observe(df: DataFrame, key: str, ord: str, ts: str) -> DataFrame:
    """A clock that takes the greatest time seen so far."""
    return running_max(df, [key], ord, ts, "clock")
