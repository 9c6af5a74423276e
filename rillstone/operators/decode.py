"""Record decoding by field lists, structured lists, and checks of schemas."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.bytes import signed
from ..functions.columns import big_endian, wrap_i64
from ..sources.framing import Cursor, FramingError
from ..types import ELEMENT_NAMES, FIELD_TYPES, VARIABLE_TYPES, info_model

#: Spark types of field types; unsigned 64-bit values keep their bits in a long.
SPARK_TYPES = {"u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.LongType(), "i32": T.IntegerType(), "i64": T.LongType(), "fixed": T.BinaryType(), "bytes": T.BinaryType(), "utf8": T.StringType(), "timestamp": T.LongType()}
WIDTHS = {name: width for name, width in FIELD_TYPES.values()}
MAX_NESTING, MAX_ELEMENTS = 8, 65_536

Field = tuple[int, str, int, str]


def decode_field(kind: str, width: int, c: Cursor):
    """One value; variable ones have a length of one byte, or of two behind 0xFF."""
    if kind in VARIABLE_TYPES:
        n = c.number(1)
        raw = c.take(c.number(2) if n == 0xFF else n)
        if kind == "bytes":
            return raw
        try:
            return raw.decode()
        except UnicodeDecodeError as e:
            raise FramingError("invalid UTF-8") from e
    if kind == "fixed":
        return c.take(width)
    value = c.number(WIDTHS[kind], signed=kind in ("i32", "i64"))
    return signed(value) if kind in ("u64", "timestamp") else value


def decode_record(fields: Sequence[Field], data: bytes) -> list:
    c = Cursor(data)
    return [decode_field(kind, width, c) for _, kind, width, *_ in fields]


def decode_records(fields: Sequence[Field], data: bytes) -> list[list]:
    """Records one behind another to the end; none at all is an error."""
    c, out = Cursor(data), []
    while c.left():
        out.append([decode_field(kind, width, c) for _, kind, width, *_ in fields])
    if not out:
        raise FramingError("no records")
    return out


def encode_record(fields: Sequence[Field], values: Sequence) -> bytes:
    out = []
    for (_, kind, width, *_), v in zip(fields, values, strict=True):
        if kind in VARIABLE_TYPES:
            raw = v.encode() if isinstance(v, str) else bytes(v)
            out.append((bytes([len(raw)]) if len(raw) < 0xFF else b"\xff" + struct.pack(">H", len(raw))) + raw)
        elif kind == "fixed":
            out.append(bytes(v).ljust(width, b"\0")[:width])
        else:
            n = WIDTHS[kind]
            out.append((int(v) % (1 << 8 * n)).to_bytes(n, "big"))
    return b"".join(out)


def pack_row(fields: Sequence[Field], values: Sequence, stride: int) -> bytes:
    """A row image of fixed slots, eight zero bytes for a variable field, zero-filled to the stride."""
    out = b"".join(b"\0" * 8 if f[1] in VARIABLE_TYPES else encode_record([f], [v]) for f, v in zip(fields, values, strict=True))
    if len(out) > stride:
        raise FramingError("row wider than its stride")
    return out.ljust(stride, b"\0")


def struct_of(fields: Sequence[Field]) -> T.StructType:
    return T.StructType([T.StructField(f[3] if len(f) > 3 and f[3] else ELEMENT_NAMES.get(f[0], f"f{i}"), SPARK_TYPES[f[1]]) for i, f in enumerate(fields)])


def fixed_columns(fields: Sequence[Field], body: str = "body") -> dict[str, Column]:
    """Native columns for the fields before the first variable one, whose offsets are known."""
    out, at = {}, 0
    for f, name in zip(fields, struct_of(fields).names, strict=True):
        _, kind, width, *_ = f
        if kind in VARIABLE_TYPES:
            break
        n = width if kind == "fixed" else WIDTHS[kind]
        raw = F.substring(body, at + 1, n)
        if kind == "fixed":
            value = raw
        else:
            value = big_endian(F.col(body), at, n)
            if kind == "i32":
                value = F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value).cast("int")
            value = value.cast(SPARK_TYPES[kind])
        out[name] = F.when(F.length(body) >= at + n, value)
        at += n
    return out


def decode(df: DataFrame, fields: Sequence[Field], body: str = "body", batch: bool = False) -> DataFrame:
    """``df`` with ``record`` (a struct of the fields) and ``error``; with ``batch`` a row a record."""
    record = struct_of(fields)
    if not batch and all(f[1] not in VARIABLE_TYPES for f in fields):
        native = fixed_columns(fields, body)
        whole = F.length(body) >= sum(f[2] if f[1] == "fixed" else WIDTHS[f[1]] for f in fields)
        return df.withColumn("record", F.when(whole, F.struct(*[c.alias(n) for n, c in native.items()]))).withColumn("error", F.when(~F.coalesce(whole, F.lit(False)), "read past the end"))
    result = T.StructType([T.StructField("records", T.ArrayType(record)), T.StructField("error", T.StringType())])

    @pandas_udf(result)
    def run(data: pd.Series) -> pd.DataFrame:
        rows = []
        for x in data:
            try:
                found = decode_records(fields, bytes(x or b"")) if batch else [decode_record(fields, bytes(x or b""))]
                rows.append(([dict(zip(record.names, r, strict=True)) for r in found], None))
            except FramingError as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["records", "error"])

    found = df.withColumn("__d", run(body))
    if batch:
        return found.select(*df.columns, F.explode_outer("__d.records").alias("record"), F.col("__d.error").alias("error"))
    return found.select(*df.columns, F.col("__d.records")[0].alias("record"), F.col("__d.error").alias("error"))


def integral_sum(fields: Sequence[Field]) -> Column:
    """The wrapping sum of a record's integral fields."""
    names = [n for f, n in zip(fields, struct_of(fields).names, strict=True) if f[1] not in ("fixed", *VARIABLE_TYPES)]
    total = F.lit(0).cast("decimal(38,0)")
    for n in names:
        total = total + F.col(f"record.{n}").cast("decimal(20,0)")
    return wrap_i64(total)


# Coercions between decoded values.


def to_u64_bits(x: Column) -> Column:
    return x.cast("long")


def to_u32_saturating(x: Column) -> Column:
    """A long, seen as unsigned, capped at 2**32 - 1."""
    return F.when((x < 0) | (x > 0xFFFFFFFF), F.lit(0xFFFFFFFF)).otherwise(x).cast("long")


def display(x: Column, kind: str) -> Column:
    if kind in ("fixed", "bytes"):
        return F.lower(F.hex(x))
    return x.cast("string")


# Structured lists: kind 0 a blob; 1 a list of equal elements; 2 a list of rows of a template.


def decode_structured(data: bytes) -> dict:
    c = Cursor(data)
    if c.left() and data[0] == 0x0F:
        c.take(1)
    kind = c.number(1)
    if kind == 0:
        return {"kind": "blob", "element_len": None, "template_id": None, "elements": [c.take(c.left())]}
    if kind not in (1, 2):
        raise FramingError(f"list kind {kind}")
    template = c.number(2) if kind == 2 else None
    size, count = c.number(1), c.number(2)
    if size == 0 or count > MAX_ELEMENTS:
        raise FramingError("list out of bounds")
    return {"kind": "list" if kind == 1 else "rows", "element_len": size, "template_id": template, "elements": [c.take(size) for _ in range(count)]}


STRUCTURED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("element_len", T.IntegerType()), T.StructField("template_id", T.IntegerType()), T.StructField("elements", T.ArrayType(T.BinaryType())), T.StructField("error", T.StringType())])


def structured(df: DataFrame, data: str) -> DataFrame:
    """``df`` with ``list``: the decoded structure, or its error."""
    arrow = pa.struct([("kind", pa.string()), ("element_len", pa.int32()), ("template_id", pa.int32()), ("elements", pa.list_(pa.binary())), ("error", pa.string())])
    schema = T.StructType([*df.schema.fields, T.StructField("list", STRUCTURED)])
    at = df.columns.index(data)

    def one(x) -> dict:
        try:
            return decode_structured(bytes(x or b"")) | {"error": None}
        except FramingError as e:
            return {"kind": None, "element_len": None, "template_id": None, "elements": None, "error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([one(x) for x in b.column(at).to_pylist()], arrow)], schema.names)

    return df.mapInArrow(run, schema)


# Schemas as rows: schema_id, version, pos, id, type, width, name.


def intrinsic(kind: Column, width: Column) -> Column:
    """The slot of a field in a row: eight bytes if variable, the spec's width if fixed."""
    out = F.when(kind == "fixed", width)
    for name, n in WIDTHS.items():
        if name != "fixed":
            out = out.when(kind == name, 8 if name in VARIABLE_TYPES else n)
    return out.cast("long")


def layout(fields: DataFrame, keys: Sequence[str] = ("schema_id",)) -> DataFrame:
    """Byte offsets on the wire up to and with the first variable field; null (dynamic) behind it."""
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    variable = F.col("type").isin(*VARIABLE_TYPES)
    n = F.when(variable, 0).otherwise(intrinsic(F.col("type"), F.col("width")))
    dynamic = F.coalesce(F.max(variable).over(before), F.lit(False))
    return fields.withColumn("offset", F.when(~dynamic, F.coalesce(F.sum(n).over(before), F.lit(0).cast("long"))))


def layout_stats(fields: DataFrame, keys: Sequence[str] = ("schema_id",)) -> DataFrame:
    """Row width, least length on the wire, and how many fields stand before the first variable one."""
    variable = F.col("type").isin(*VARIABLE_TYPES)
    slot = intrinsic(F.col("type"), F.col("width"))
    first = F.coalesce(F.min(F.when(variable, F.col("pos"))), F.max("pos") + 1)
    return fields.groupBy(*keys).agg(F.sum(slot).alias("row_width"), F.sum(F.when(variable, 1).otherwise(slot)).alias("min_len"), first.cast("long").alias("fixed_prefix"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two field lists: added, removed, retyped, rewidth; only added ones are compatible.

    A retype hides a change of width.
    """
    a, b = (x.select("id", F.col("type").alias(f"{n}_type"), F.col("width").alias(f"{n}_width")) for x, n in ((old, "old"), (new, "new")))
    both = a.join(b, "id", "full")
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when(F.col("old_type") != F.col("new_type"), "retyped").when(F.col("old_width") != F.col("new_width"), "rewidth")
    return both.withColumn("change", change).where("change is not null").withColumn("compatible", F.col("change") == "added")


def problems(fields: DataFrame, keys: Sequence[str] = ("schema_id",)) -> DataFrame:
    """What is wrong with each field: duplicate, disagrees with the information model, zero width."""
    model = F.broadcast(info_model(fields.sparkSession).select("id", F.col("type").alias("m_type"), F.col("width").alias("m_width")))  # 58 rows
    seen = Window.partitionBy(*keys, "id")
    joined = fields.join(model, "id", "left").withColumn("__n", F.count("*").over(seen))
    wrong_width = (F.col("type") == "fixed") & (F.col("m_width") > 0) & (F.col("width") != F.col("m_width"))
    found = F.array_compact(
        F.array(
            F.when(F.col("__n") > 1, F.lit("duplicate id")),
            F.when(F.col("m_type").isNotNull() & (F.col("type") != F.col("m_type")), F.lit("type differs")),
            F.when(F.coalesce(wrong_width, F.lit(False)), F.lit("width differs")),
            F.when((F.col("type") == "fixed") & (F.col("width") == 0), F.lit("zero width")),
        )
    )
    return joined.withColumn("problem", F.explode(found)).drop("m_type", "m_width", "__n")


def trailing_bytes(length: Column, min_len: Column) -> Column:
    """Bytes behind the fixed part of a record; an error (null) if even that is cut."""
    return F.when(length >= min_len, length - min_len)
