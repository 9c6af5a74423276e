"""Binary containers in plain Python: streams, batches, captures, snapshots, schema catalogs.

Readers raise :class:`FramingError`; a stream is all or nothing, so one bad frame loses the stream
and not a part of it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from .. import types as K


class FramingError(ValueError):
    """Bytes that are no whole, well-formed container."""


class Message(NamedTuple):
    code: int
    flags: int
    offset: int
    payload: bytes


# Streams.


def stream(messages: Iterable[tuple[int, bytes] | tuple[int, bytes, int]], flags: int = 0, version: int = K.STREAM_VERSION) -> bytes:
    """A stream of ``(code, payload[, flags])``."""
    frames = [struct.pack(">BBI", m[0], m[2] if len(m) > 2 else 0, len(m[1])) + m[1] for m in messages]
    return K.STREAM_MAGIC + struct.pack(">BBH", version, flags, len(frames)) + b"".join(frames)


def stream_flags(data: bytes) -> int:
    if len(data) < 8:
        raise FramingError("stream shorter than its header")
    return data[5]


def parse_stream(data: bytes, strict: bool = False) -> list[Message]:
    """All messages; unknown types are skipped, or with ``strict`` refused. Bytes behind the last are ignored."""
    if len(data) < 8:
        raise FramingError("stream shorter than its header")
    if data[:4] != K.STREAM_MAGIC:
        raise FramingError("no stream magic")
    version, _, count = struct.unpack_from(">BBH", data, 4)
    if not 1 <= version <= K.STREAM_VERSION:
        raise FramingError(f"version {version}")
    out, at = [], 8
    for _ in range(count):
        if at + 6 > len(data):
            raise FramingError("frame header past the end")
        code, flags, size = struct.unpack_from(">BBI", data, at)
        if size > K.MAX_MESSAGE:
            raise FramingError("message too long")
        if at + 6 + size > len(data):
            raise FramingError("payload past the end")
        if code in K.MESSAGE_NAMES:
            out.append(Message(code, flags, at, bytes(data[at + 6 : at + 6 + size])))
        elif strict:
            raise FramingError(f"message type {code}")
        at += 6 + size
    return out


# Length-prefixed batches and captures.


def batch(streams: Iterable[bytes]) -> bytes:
    return b"".join(struct.pack(">I", len(s)) + s for s in streams)


def parse_batch(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise FramingError("batch length past the end")
        (size,) = struct.unpack_from(">I", data, at)
        if size > K.MAX_BATCHED or at + 4 + size > len(data):
            raise FramingError("batched stream past the end")
        yield bytes(data[at + 4 : at + 4 + size])
        at += 4 + size


def capture(records: Iterable[tuple[int, bytes]]) -> bytes:
    head = K.CAPTURE_MAGIC + bytes((K.CAPTURE_VERSION, 0, 0, 0))
    return head + b"".join(struct.pack(">QI", ts, len(s)) + s for ts, s in records)


def parse_capture(data: bytes) -> Iterator[tuple[int, bytes]]:
    if len(data) < 8 or data[:4] != K.CAPTURE_MAGIC:
        raise FramingError("no capture magic")
    if data[4] != K.CAPTURE_VERSION:
        raise FramingError(f"capture version {data[4]}")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise FramingError("record header past the end")
        ts, size = struct.unpack_from(">QI", data, at)
        if size > K.MAX_CAPTURED or at + 12 + size > len(data):
            raise FramingError("record past the end")
        yield ts, bytes(data[at + 12 : at + 12 + size])
        at += 12 + size


# Snapshots: 63 bytes a flow, a CRC-32 of everything before it at the end.

SNAPSHOT_ROW = struct.Struct(">IIIHHBQQQQQHI")
SNAPSHOT_COLUMNS = ("src", "dst", "flow_id", "sport", "dport", "proto", "octets", "packets", "records", "first_ms", "last_ms", "template_id", "template_gen")


def snapshot(rows: Iterable[tuple], flags: int = 0) -> bytes:
    packed = [SNAPSHOT_ROW.pack(*r) for r in rows]
    body = K.SNAPSHOT_MAGIC + struct.pack(">BBI", K.SNAPSHOT_VERSION, flags, len(packed)) + b"".join(packed)
    return body + struct.pack(">I", zlib.crc32(body))


def parse_snapshot(data: bytes) -> list[tuple]:
    if len(data) < 14:
        raise FramingError("snapshot too short")
    if data[:4] != K.SNAPSHOT_MAGIC or data[4] != K.SNAPSHOT_VERSION:
        raise FramingError("no snapshot of a known version")
    if zlib.crc32(data[:-4]) != struct.unpack(">I", data[-4:])[0]:
        raise FramingError("snapshot checksum differs")
    (count,) = struct.unpack_from(">I", data, 6)
    if count * SNAPSHOT_ROW.size > len(data) - 14:
        raise FramingError("more rows than bytes")
    return list(SNAPSHOT_ROW.iter_unpack(data[10 : 10 + count * SNAPSHOT_ROW.size]))


# Schema catalogs: rows of (schema id, version, fields), a field being (id, type name, width, name).


def catalog(schemas: Iterable[tuple[int, int, list[tuple[int, str, int, str]]]]) -> bytes:
    """Of schemas with one id the highest version is kept."""
    newest: dict[int, tuple] = {}
    for s in schemas:
        if s[0] not in newest or s[1] > newest[s[0]][1]:
            newest[s[0]] = s
    out = [K.CATALOG_MAGIC, struct.pack(">BH", K.CATALOG_VERSION, len(newest))]
    for number, version, fields in newest.values():
        out.append(struct.pack(">HHH", number, version, len(fields)))
        for field, kind, width, name in fields:
            raw = name.encode()[:255]
            out.append(struct.pack(">HBHB", field, K.FIELD_CODES[kind], width, len(raw)) + raw)
    return b"".join(out)


class Cursor:
    """Bounded reads from bytes; seeks to an absolute place clamp, relative ones must stay inside."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if n < 0 or n > self.left():
            raise FramingError("read past the end")
        self.at += n
        return bytes(self.data[self.at - n : self.at])

    def number(self, width: int, signed: bool = False) -> int:
        return int.from_bytes(self.take(width), "big", signed=signed)

    def seek(self, at: int) -> int:
        self.at = min(max(at, 0), len(self.data))
        return self.at

    def skip(self, delta: int) -> int:
        if not 0 <= self.at + delta <= len(self.data):
            raise FramingError("seek out of range")
        self.at += delta
        return self.at


def parse_fields(c: Cursor, named: bool = False) -> list[tuple[int, str, int, str]]:
    n = c.number(2)
    if not 1 <= n <= 4096:
        raise FramingError("field count out of range")
    out = []
    for _ in range(n):
        field, code, width = c.number(2), c.number(1), c.number(2)
        if code not in K.FIELD_TYPES:
            raise FramingError(f"field type {code}")
        name = c.take(c.number(1)).decode("utf-8", "replace") if named else K.ELEMENT_NAMES.get(field, f"f{field}")
        out.append((field, K.FIELD_TYPES[code][0], width, name))
    return out


def parse_catalog(data: bytes) -> list[tuple[int, int, list[tuple[int, str, int, str]]]]:
    c = Cursor(data)
    if c.take(4) != K.CATALOG_MAGIC or c.number(1) != K.CATALOG_VERSION:
        raise FramingError("no catalog of a known version")
    return [(c.number(2), c.number(2), parse_fields(c, named=True)) for _ in range(c.number(2))]


# Payloads, for writing streams.


def fields_payload(fields: Iterable[tuple[int, str, int]]) -> bytes:
    packed = [struct.pack(">HBH", i, K.FIELD_CODES[kind], width) for i, kind, width, *_ in fields]
    return struct.pack(">H", len(packed)) + b"".join(packed)


def session_open(number: int, features: int = 0) -> tuple[int, bytes]:
    return K.MESSAGE_CODES["SESSION_OPEN"], struct.pack(">II", number, features)


def session_close(number: int) -> tuple[int, bytes]:
    return K.MESSAGE_CODES["SESSION_CLOSE"], struct.pack(">I", number)


def schema_def(number: int, fields, update: bool = False) -> tuple[int, bytes]:
    return K.MESSAGE_CODES["SCHEMA_UPDATE" if update else "SCHEMA_DEF"], struct.pack(">H", number) + fields_payload(fields)


def template_def(number: int, schema: int, fields) -> tuple[int, bytes]:
    return K.MESSAGE_CODES["TEMPLATE_DEF"], struct.pack(">HH", number, schema) + fields_payload(fields)


DATA_HEADER = struct.Struct(">HIIIHHBQQ")
DATA_COLUMNS = ("template_id", "flow_id", "src", "dst", "sport", "dport", "proto", "octets", "packets")


def data_record(template: int, flow_id: int, src: int, dst: int, sport: int, dport: int, proto: int, octets: int, packets: int, body: bytes = b"") -> tuple[int, bytes]:
    return K.MESSAGE_CODES["DATA_RECORD"], DATA_HEADER.pack(template, flow_id, src, dst, sport, dport, proto, octets, packets) + body


def fragment(flow_id: int, offset: int, data: bytes) -> tuple[int, bytes]:
    return K.MESSAGE_CODES["FRAGMENT"], struct.pack(">IiH", flow_id, offset, len(data)) + data
