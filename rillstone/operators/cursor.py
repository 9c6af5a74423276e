"""A lazy cursor over records: every call reads no more of them than it needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RecordCursor:
    """Records in order of ``ord``; without one, in any order, and then no call sorts."""

    records: DataFrame
    ord: str | None = None

    def _ordered(self, df: DataFrame) -> DataFrame:
        return df if self.ord is None else df.orderBy(self.ord)

    def limit(self, n: int) -> RecordCursor:
        return RecordCursor(self._ordered(self.records).limit(n), self.ord)

    def find_first(self, condition: Column) -> DataFrame:
        """The first record that meets the condition; no row if none does."""
        return self._ordered(self.records.where(condition)).limit(1)

    def count(self, condition: Column | None = None, most: int | None = None) -> DataFrame:
        """``n``: how many records meet the condition, counted up to ``most`` only."""
        found = self.records if condition is None else self.records.where(condition)
        return (found if most is None else found.limit(most)).agg(F.count("*").alias("n"))
