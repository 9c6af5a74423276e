"""Flows and records as JSON, CSV and text lines, and writers of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .types import ELEMENT_NAMES

#: The exported columns, and the name of each in the output.
FLOW_EXPORT = {"src": "src", "dst": "dst", "sport": "sport", "dport": "dport", "proto": "proto", "octets": "octets", "packets": "packets", "records": "records", "template_id": "template"}


def flow_json() -> Column:
    return F.to_json(F.struct(*[F.col(c).alias(n) for c, n in FLOW_EXPORT.items()]))


def flow_csv() -> Column:
    return F.concat_ws(",", *[F.col(c).cast("string") for c in FLOW_EXPORT])


def flow_text() -> Column:
    return F.format_string("%d:%d -> %d:%d proto=%d %do/%dp", *[F.col(c).cast("long") for c in ("src", "sport", "dst", "dport", "proto", "octets", "packets")])


def record_json(df: DataFrame, record: str = "record") -> Column:
    """A decoded record as JSON, bytes in hexadecimal."""
    inner = df.schema[record].dataType
    return F.to_json(F.struct(*[(F.lower(F.hex(F.col(f"{record}.{f.name}"))) if isinstance(f.dataType, BinaryType) else F.col(f"{record}.{f.name}")).alias(f.name) for f in inner]), {"ignoreNullFields": "false"})


def record_names(ids: list[int]) -> list[str]:
    """Keys of a record's fields: the information model's names, or ``f`` and the position."""
    return [ELEMENT_NAMES.get(i, f"f{n}") for n, i in enumerate(ids)]


def csv_field(x: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line end."""
    return F.when(x.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def lines(flows: DataFrame, fmt: str) -> DataFrame:
    forms = {"json": flow_json, "csv": flow_csv, "text": flow_text, "txt": flow_text}
    if fmt not in forms:
        raise ValueError(f"no format {fmt!r}")
    return flows.select(forms[fmt]().alias("line"))


def export(flows: DataFrame, path: str, fmt: str) -> None:
    """Write flows: JSON lines and text by line, CSV with one header a file."""
    if fmt == "csv":
        flows.select(*[F.col(c).alias(n) for c, n in FLOW_EXPORT.items()]).write.option("header", True).csv(path)
    else:
        lines(flows, fmt).withColumnRenamed("line", "value").write.text(path)
