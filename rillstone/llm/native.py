"""Expressions for per-row array work that stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the contracts have it: blank, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression that a lambda refers to would be inlined into it and computed for every element;
    as the lambda variable of an outer one-element transform it is a value.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def computed(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with these columns last, each computed once a row whatever follows.

    A filter on a computed column would be moved before it, with the whole expression in it again; it
    can't be moved before a generator.
    """
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*columns))))
