"""Filter, aggregate, sort and limit over a flow table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import wrapping_sum
from .filter_lang import compile_filter, flow_columns


def duration(df: DataFrame) -> Column:
    return F.greatest(df["last_ms"] - df["first_ms"], F.lit(0).cast("long"))


def sort_column(df: DataFrame, key: str) -> Column:
    if key == "duration":
        return duration(df)
    if key in ("octets", "packets", "records", "flow_id"):
        return df[key]
    if key == "flow":
        return df["flow_id"]
    raise ValueError(f"no sort key {key!r}")


def _when(matched: Column, c: str) -> Column:
    return F.when(matched, F.col(c))


#: Each is a conditional aggregate, so one pass gives them all beside the counts.
AGGREGATES = {
    "count": lambda m: F.count_if(m),
    "sum_octets": lambda m: F.coalesce(F.sum(_when(m, "octets")), F.lit(0).cast("long")),
    "sum_packets": lambda m: F.coalesce(F.sum(_when(m, "packets")), F.lit(0).cast("long")),
    "max_octets": lambda m: F.coalesce(F.max(_when(m, "octets")), F.lit(0).cast("long")),
    "min_octets": lambda m: F.coalesce(F.min(_when(m, "octets")), F.lit(0).cast("long")),
    "distinct_sources": lambda m: F.count_distinct(_when(m, "src")),
    "approx_distinct_sources": lambda m: F.approx_count_distinct(_when(m, "src")),
    "wrapping_sum_octets": lambda m: F.coalesce(wrapping_sum(_when(m, "octets")), F.lit(0).cast("long")),
    "wrapping_sum_packets": lambda m: F.coalesce(wrapping_sum(_when(m, "packets")), F.lit(0).cast("long")),
}


@dataclass(frozen=True)
class ResultSet:
    """Lazy frames: rows after sort and limit; one row of totals, of which ``aggregates`` over all matches
    and ``counts`` are parts. The parts together are one pass over the flows."""

    rows: DataFrame
    totals: DataFrame
    labels: tuple[str, ...]

    @property
    def aggregates(self) -> DataFrame:
        return self.totals.select(*self.labels)

    @property
    def counts(self) -> DataFrame:
        return self.totals.select("scanned", "total_matched")

    def value(self, label: str) -> Column:
        """The first aggregate of that label, as a column of ``totals``."""
        if label not in self.labels:
            raise ValueError(f"no aggregate labelled {label!r}")
        return self.totals[label]


@dataclass(frozen=True)
class FlowQuery:
    """A builder; without an order, flows come by octets, largest first.

    Flows with equal sort values keep the order of ``order_by_ties`` (a column that says where a row
    stood in the input) when ascending, and its reverse when descending.
    """

    condition: str | None = None
    key: str = "octets"
    descending: bool = True
    n: int | None = None
    kinds: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()

    def where(self, text: str) -> FlowQuery:
        return replace(self, condition=text)

    def order_by(self, key: str, descending: bool = False) -> FlowQuery:
        return replace(self, key=key, descending=descending)

    def limit(self, n: int) -> FlowQuery:
        return replace(self, n=n)

    def aggregate(self, *kinds: str) -> FlowQuery:
        if bad := set(kinds) - set(AGGREGATES):
            raise ValueError(f"no aggregate {sorted(bad)}")
        return replace(self, kinds=self.kinds + kinds)

    def select(self, *columns: str) -> FlowQuery:
        return replace(self, columns=columns)

    def matches(self, flows: DataFrame) -> DataFrame:
        if self.condition is None:
            return flows
        return flows.where(compile_filter(self.condition, flows, flow_columns(flows)))

    def run(self, flows: DataFrame, order_by_ties: str = "ord") -> ResultSet:
        """Rows, which need no full sort where there is a limit, and totals of one pass."""
        found = self.matches(flows)
        key, tie = sort_column(found, self.key), F.col(order_by_ties)
        rows = found.orderBy(key.desc(), tie.desc()) if self.descending else found.orderBy(key.asc(), tie.asc())
        if self.n is not None:
            rows = rows.limit(self.n)
        if self.columns:
            rows = rows.select(*self.columns)
        matched = F.lit(True) if self.condition is None else compile_filter(self.condition, flows, flow_columns(flows), value=True)
        labels = tuple(dict.fromkeys(self.kinds or ("count",)))
        totals = flows.agg(F.count("*").alias("scanned"), F.count_if(matched).alias("total_matched"), *[AGGREGATES[k](matched).alias(k) for k in labels])
        return ResultSet(rows, totals, labels)
