"""Running values over series of any length, without a task for a whole series.

Rows are dealt to ranges of (series, order) and written out, so that every consumer sees the same
ranges. A window runs within a range; what a range needs of those before it is one row for each series
and range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

PART = "__part"


def ranged(df: DataFrame, keys: Sequence[str], ord: str) -> DataFrame:
    """``df`` with the number of its row's range."""
    return materialize(df.repartitionByRange(*keys, ord).withColumn(PART, F.spark_partition_id()), "ranges")


def _earlier(keys: Sequence[str], order: Column):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _carry(rows: DataFrame, keys: Sequence[str], partial: Column, combine, backwards: bool = False) -> DataFrame:
    """``rows`` with ``__before``: ``combine`` of the ``partial`` values of its series' earlier ranges, or with
    ``backwards`` of the later ones."""
    order = F.desc(PART) if backwards else F.asc(PART)
    parts = rows.groupBy(*keys, PART).agg(partial.alias("__partial"))
    carried = parts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(PART).alias("__p"), combine("__partial").over(_earlier(keys, order)).alias("__before"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]  # a null key is a series
    joined = rows.join(carried, [F.col(PART) == F.col("__p"), *same])
    return joined.drop("__p", *[f"__k{i}" for i in range(len(keys))])


def _within(keys: Sequence[str], ord: str):
    return Window.partitionBy(PART, *keys).orderBy(ord).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def row_numbers(df: DataFrame, keys: Sequence[str], ord: str, out: str) -> DataFrame:
    """``df`` with its rows' numbers, from 1, in order of ``ord`` within each series."""
    rows = _carry(ranged(df, keys, ord), keys, F.count("*"), F.sum)
    number = F.coalesce("__before", F.lit(0)) + F.row_number().over(Window.partitionBy(PART, *keys).orderBy(ord))
    return rows.withColumn(out, number.cast("long")).drop("__before", PART)


def running_max(df: DataFrame, keys: Sequence[str], ord: str, value: str, out: str) -> DataFrame:
    """``df`` with the greatest ``value`` of its series up to each row."""
    rows = _carry(ranged(df, keys, ord), keys, F.max(value), F.max)
    return rows.withColumn(out, F.greatest("__before", F.max(value).over(_within(keys, ord)))).drop("__before", PART)


def running_sum(df: DataFrame, keys: Sequence[str], ord: str, value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over its series up to each row."""
    rows = _carry(ranged(df, keys, ord), keys, F.sum(value), F.sum)
    return rows.withColumn(out, F.coalesce("__before", F.lit(0)) + F.sum(value).over(_within(keys, ord))).drop("__before", PART)


def least_after(df: DataFrame, keys: Sequence[str], ord: str, value: Column, out: str) -> DataFrame:
    """``df`` with the least ``value`` of its series behind each row, null if there is none.

    From the end, as a window that runs from each row to the end would be read anew for each of them.
    """
    rows = _carry(ranged(df, keys, ord), keys, F.min(value), F.min, backwards=True)
    later = Window.partitionBy(PART, *keys).orderBy(F.desc(ord)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.least("__before", F.min(value).over(later))).drop("__before", PART)
