"""Messages from binary columns, and what their payloads say."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import big_endian, hex_preview
from ..types import ELEMENT_NAMES, FIELD_TYPES, MESSAGE_NAMES, MESSAGES, message_types
from . import framing

ARROW = pa.schema(
    [
        ("stream_id", pa.string()),
        ("transport_id", pa.int64()),
        ("capture_ts_ms", pa.int64()),
        ("stream_flags", pa.int32()),
        ("seq", pa.int32()),
        ("type_code", pa.int32()),
        ("type_name", pa.string()),
        ("flags", pa.int32()),
        ("offset", pa.int32()),
        ("payload", pa.binary()),
        ("error", pa.string()),
    ]
)


def message_rows(stream_id: str | None, transport: int | None, ts: int | None, data: bytes | None, strict: bool = False) -> list[tuple]:
    """One row for each message, or one error row for a stream that can't be read."""
    try:
        found = framing.parse_stream(data or b"", strict)
        flags = framing.stream_flags(data or b"")
    except framing.FramingError as e:
        return [(stream_id, transport, ts, None, None, None, None, None, None, None, str(e))]
    return [(stream_id, transport, ts, flags, i, m.code, MESSAGE_NAMES[m.code], m.flags, m.offset, m.payload, None) for i, m in enumerate(found)]


def parse_streams(df: DataFrame, strict: bool = False) -> DataFrame:
    """``stream_id, transport_id, capture_ts_ms, data`` -> messages. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (r for i in range(batch.num_rows) for r in message_rows(*(c[i].as_py() for c in batch.columns), strict=strict))
            while some := list(islice(rows, 4096)):
                columns = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types, strict=True)], ARROW.names)

    return df.select(F.col("stream_id").cast("string"), F.col("transport_id").cast("long"), F.col("capture_ts_ms").cast("long"), "data").mapInArrow(run, MESSAGES)


def _of(name: str) -> Column:
    return F.col("type_name") == name


def hex8(at: int) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(F.substring("payload", at + 1, 4))))


def number(at: int, width: int) -> Column:
    return big_endian(F.col("payload"), at, width)


def _signed32(at: int) -> Column:
    n = number(at, 4)
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n)


def describe() -> Column:
    """One line about a message's payload, from fixed offsets."""
    n = F.length("payload")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    num = lambda at, width: number(at, width).cast("string")
    forms = [
        (_of("SESSION_OPEN"), 8, text("session=", hex8(0), " features=", hex8(4))),
        (_of("SCHEMA_DEF") | _of("SCHEMA_UPDATE"), 4, text("schema=", num(0, 2), " fields=", num(2, 2))),
        (_of("TEMPLATE_DEF"), 6, text("template=", num(0, 2), " schema=", num(2, 2), " fields=", num(4, 2))),
        (_of("DATA_RECORD"), 6, text("template=", num(0, 2), " flow=", hex8(2))),
        (_of("FRAGMENT"), 10, text("flow=", hex8(0), " offset=", _signed32(4).cast("string"), " len=", num(8, 2))),
        (_of("FLOW_OPEN") | _of("FLOW_TIMEOUT"), 4, text("flow=", hex8(0))),
        (_of("MODULE_LOAD") | _of("MODULE_RELOAD"), 4, text("module=", num(0, 4))),
    ]
    out = F.when(F.col("error").isNotNull(), F.col("error"))
    for is_type, least, form in forms:
        out = out.when(is_type & (n < least), "truncated").when(is_type, form)
    return out.otherwise(hex_preview(F.col("payload"), 12))


def inspect(messages: DataFrame) -> DataFrame:
    return messages.select("stream_id", "seq", "type_name", "flags", F.length("payload").alias("len"), describe().alias("detail"))


def admit(messages: DataFrame) -> DataFrame:
    """Messages with ``category``, ``opened`` before them and ``verdict``: admitted, not_open or too_short."""
    from pyspark.sql import Window

    dim = F.broadcast(message_types(messages.sparkSession).drop("type_name"))  # 36 rows
    before = Window.partitionBy("transport_id").orderBy("clock").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(_of("SESSION_OPEN") & (F.length("payload") >= 4), True).when(_of("SESSION_CLOSE"), False)
    joined = messages.where("error is null").join(dim, "type_code").withColumn("opened", F.coalesce(F.last(change, ignorenulls=True).over(before), F.lit(False)))
    verdict = F.when(F.length("payload") < F.col("min_len"), "too_short").when(F.col("requires_open") & ~F.col("opened"), "not_open").otherwise("admitted")
    return joined.withColumn("verdict", verdict)


def routed(admitted: DataFrame) -> DataFrame:
    """Messages, bytes and rejections by category."""
    ok = F.col("verdict") == "admitted"
    return admitted.groupBy("category").agg(F.count_if(ok).alias("messages"), F.coalesce(F.sum(F.when(ok, F.length("payload"))), F.lit(0)).cast("long").alias("bytes"), F.count_if(~ok).alias("rejected"))


def unnest(messages: DataFrame) -> DataFrame:
    """Data records inside of nested messages (up to eight levels) as data records of their own.

    A nested payload is an inner type and its body; one that starts with 0x0F is a structured list
    instead and stays as it is. Other inner types have no effect and stay as well.
    """
    levels = F.regexp_extract(F.hex("payload"), "^(?!0F)((?:22|0F){0,8})06", 0)
    inside = (_of("NESTED_RECORD") | _of("CONTINUATION")) & (F.length(levels) > 0)
    body = F.substring("payload", F.call_function("div", F.length(levels), F.lit(2)).cast("int") + 1, F.length("payload"))
    return messages.withColumns({"payload": F.when(inside, body).otherwise(F.col("payload")), "type_name": F.when(inside, "DATA_RECORD").otherwise(F.col("type_name"))})


def data_records(messages: DataFrame) -> DataFrame:
    """The 35-byte header of data records as columns, and the body behind it; short ones are left out.

    Offsets are fixed, so this is native.
    """
    found = messages.where(_of("DATA_RECORD") & (F.length("payload") >= framing.DATA_HEADER.size))
    layout = (("template_id", 0, 2), ("flow_id", 2, 4), ("src", 6, 4), ("dst", 10, 4), ("sport", 14, 2), ("dport", 16, 2), ("proto", 18, 1), ("octets", 19, 8), ("packets", 27, 8))
    kept = [c for c in ("stream_id", "transport_id", "capture_ts_ms", "seq", "clock") if c in messages.columns]
    return found.select(*kept, *[number(at, w).alias(c) for c, at, w in layout], F.substring("payload", 36, F.length("payload")).alias("body"))


def schema_definitions(messages: DataFrame) -> DataFrame:
    """``schema_id, field_count``, the packed field list, and ``is_update`` of each definition and update."""
    found = messages.where((_of("SCHEMA_DEF") | _of("SCHEMA_UPDATE")) & (F.length("payload") >= 4) & (F.length("payload") >= 4 + 5 * number(2, 2)) & number(2, 2).between(1, 4096))
    kept = [c for c in ("transport_id", "seq", "clock") if c in messages.columns]
    return found.select(*kept, number(0, 2).alias("schema_id"), number(2, 2).alias("field_count"), F.substring("payload", 5, F.length("payload")).alias("packed"), _of("SCHEMA_UPDATE").alias("is_update"))


def schema_versions(definitions: DataFrame) -> DataFrame:
    """Definitions with ``version``: 1 for a definition, one more for each update after it. Updates of
    schemas that no definition precedes are left out."""
    from pyspark.sql import Window

    seen = Window.partitionBy("transport_id", "schema_id").orderBy("clock").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    life = definitions.withColumn("__life", F.count_if(~F.col("is_update")).over(seen)).where("__life > 0")
    return life.withColumn("version", F.row_number().over(Window.partitionBy("transport_id", "schema_id", "__life").orderBy("clock"))).drop("__life")


def field_list(packed: str = "packed", count: str = "field_count") -> Column:
    """A packed field list as an array of ``id, type, width, name``."""
    kinds = F.create_map(*[F.lit(x) for code, (name, _) in FIELD_TYPES.items() for x in (code, name)])
    names = F.create_map(*[F.lit(x) for i, name in ELEMENT_NAMES.items() for x in (i, name)])

    def field(i: Column) -> Column:
        at = (i * 5).cast("int")
        number_at = lambda offset, width: big_endian(F.col(packed), at + offset, width)
        spec = number_at(0, 2).cast("int")
        name = F.coalesce(F.try_element_at(names, spec), F.concat(F.lit("f"), spec.cast("string")))
        return F.struct(spec.alias("id"), F.try_element_at(kinds, number_at(2, 1).cast("int")).alias("type"), number_at(3, 2).cast("int").alias("width"), name.alias("name"))

    return F.transform(F.sequence(F.lit(0).cast("long"), F.col(count) - 1), field)


def template_definitions(messages: DataFrame) -> DataFrame:
    """``template_id, schema_id, field_count`` and the packed field list of each definition."""
    found = messages.where(_of("TEMPLATE_DEF") & (F.length("payload") >= 6) & (F.length("payload") >= 6 + 5 * number(4, 2)) & number(4, 2).between(1, 4096))
    kept = [c for c in ("transport_id", "seq", "clock") if c in messages.columns]
    return found.select(*kept, number(0, 2).alias("template_id"), number(2, 2).alias("schema_id"), number(4, 2).alias("field_count"), F.substring("payload", 7, F.length("payload")).alias("packed"))
