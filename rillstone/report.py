"""Plain-text reports of small results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .operators.analytics import histogram_stats, percentiles, summary
from .plans.query import ResultSet


def quad(address: int) -> str:
    return ".".join(str(address >> s & 255) for s in (24, 16, 8, 0))


def table(headers: Sequence[str], rows: Sequence[Sequence[object]], right: Sequence[int] = (), widths: Sequence[int] | None = None) -> str:
    """Columns as wide as their longest cell, or as told, which cuts; ``right`` names those set right."""
    cells = [[str(x) for x in row] + [""] * (len(headers) - len(row)) for row in rows]
    sizes = list(widths) if widths else [max(len(r[i]) for r in [list(headers), *cells]) for i in range(len(headers))]

    def line(row: Sequence[str]) -> str:
        return "  ".join((c[:w].rjust(w) if i in right else c[:w].ljust(w)) for i, (c, w) in enumerate(zip(row, sizes, strict=True)))

    return "".join(f"{x}\n" for x in [line(headers), "  ".join("-" * w for w in sizes), *map(line, cells)])


def flows(result: ResultSet) -> str:
    """The rows (which should have a limit), what they are of, and the aggregates."""
    rows = result.rows.select("flow_id", "src", "dst", "octets", "packets", "records").collect()
    found = result.totals.first()
    shown = table(["flow", "src", "dst", "octets", "packets", "records"], [(r[0], quad(r[1]), quad(r[2]), *r[3:]) for r in rows], right=(0, 3, 4, 5), widths=(10, 15, 15, 12, 10, 8))
    totals = "".join(f"  {k} = {v}\n" for k, v in ((k, found[k]) for k in result.labels))
    return f"{shown}\n{len(rows)} flow(s) shown of {found.total_matched} matched ({found.scanned} scanned)\n{totals}"


def flow_summary(df: DataFrame, n: int = 16) -> str:
    """Means, percentiles and top sources of a flow table, which is computed once for all of them."""
    df = df.persist()
    try:
        return _flow_summary(df, n)
    finally:
        df.unpersist()


def _flow_summary(df: DataFrame, n: int) -> str:
    found = summary(df, n)
    seen = found["seen"].first()[0]
    marks = {name: {r.p: r.value for r in percentiles(found[name], [0.5, 0.9, 0.99]).collect()} for name in ("octets", "packets")}
    mean = histogram_stats(df, "octets").first()["mean"]
    top = found["top_sources"].limit(5).collect()
    out = [f"flows observed : {seen}", f"mean octets : {mean:.1f}"]
    out += [f"{name:<8}p50/p90/p99 : {m[0.5]} / {m[0.9]} / {m[0.99]}" for name, m in marks.items()]
    return "\n".join([*out, "top sources:", *(f"  {quad(r.key):<15} {r.weight}" for r in top)]) + "\n"
