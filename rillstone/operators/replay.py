"""Exact replays of order-dependent state, one session at a time.

Each model is plain Python that takes events in order. ``in_order`` runs one for each key over sorted
partitions, holding a model's state and not the key's rows, and the streaming module runs the same
models in keyed state.
"""

from __future__ import annotations

import struct
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import Config
from ..functions.bytes import CODEC_DELTA, CODEC_DICT, CODEC_NONE, CODEC_PASS, CodecError, inflate
from ..sources.framing import DATA_HEADER, Cursor, FramingError, parse_fields, parse_snapshot, parse_stream
from ..transform import Modules, TransformError
from ..types import MESSAGE_CODES, MESSAGE_TYPES, SNAPSHOT_MAGIC
from .decode import decode_structured
from .reassembly import RingWindow, merge_bytes

MESSAGE_GATED = {code: gated for code, _, _, _, gated, _ in MESSAGE_TYPES}

NESTED = (MESSAGE_CODES["CONTINUATION"], MESSAGE_CODES["NESTED_RECORD"])
MAX_NESTED = 8


@dataclass
class Flow:
    octets: int = 0
    packets: int = 0
    records: int = 0
    first_ms: int = 0
    last_ms: int = 0
    template_id: int = 0
    template_gen: int = 0
    layout_changed: bool = False


class FlowTable:
    """Flows by key in order of creation: idle expiry, oldest-created eviction over capacity."""

    def __init__(self, capacity: int = 65_536, idle: int = 30_000):
        self.capacity, self.idle = capacity, idle
        self.live: OrderedDict[tuple, Flow] = OrderedDict()
        self.by_last: OrderedDict[tuple, None] = OrderedDict()  # least recently updated first
        self.emitted: list[tuple[tuple, Flow, str]] = []

    def update(self, key: tuple, octets: int, packets: int, now: int, template: int = 0, generation: int = 0) -> None:
        flow = self.live.get(key)
        if flow is None:
            flow = self.live[key] = Flow(first_ms=now)
        elif flow.template_id == template and flow.template_gen != generation:
            flow.layout_changed = True
        flow.template_id, flow.template_gen = template, generation
        flow.octets, flow.packets = (flow.octets + octets) % (1 << 64), (flow.packets + packets) % (1 << 64)
        flow.records, flow.last_ms = flow.records + 1, now
        self.by_last[key] = None
        self.by_last.move_to_end(key)
        while len(self.live) > self.capacity:
            self._emit(next(iter(self.live)), "capacity")

    def _emit(self, key: tuple, why: str) -> None:
        self.emitted.append((key, self.live.pop(key), why))
        del self.by_last[key]

    def sweep(self, now: int) -> None:
        """Expire what is idle; only flows at the front of the update order can be."""
        while self.idle and self.by_last:
            key = next(iter(self.by_last))
            if now < self.live[key].last_ms + self.idle:
                break
            self._emit(key, "idle")

    def purge(self, template: int) -> None:
        """Drop flows bound to a template, without emitting them."""
        for key in [k for k, f in self.live.items() if f.template_id == template]:
            del self.live[key], self.by_last[key]

    def flush(self) -> None:
        for key in list(self.live):
            self._emit(key, "flush")


class TemplateCache:
    """Least recently used definitions, bounded; a redefinition raises the generation."""

    def __init__(self, capacity: int = 256):
        self.capacity = capacity
        self.held: OrderedDict[int, tuple[int, tuple]] = OrderedDict()

    def define(self, number: int, definition: tuple) -> list[int]:
        """The ids that had to go."""
        generation = self.held[number][0] + 1 if number in self.held else 1
        self.held[number] = (generation, definition)
        self.held.move_to_end(number)
        gone = []
        while len(self.held) > self.capacity:
            gone.append(self.held.popitem(last=False)[0])
        return gone

    def get(self, number: int) -> tuple[int, tuple] | None:
        if number in self.held:
            self.held.move_to_end(number)
        return self.held.get(number)

    def peek(self, number: int) -> tuple[int, tuple] | None:
        return self.held.get(number)

    def withdraw(self, number: int) -> bool:
        return self.held.pop(number, None) is not None


class Connections:
    """Queued requests by connection; a reset drops what is queued for it."""

    LIMIT = 4096

    def __init__(self) -> None:
        self.generation: dict[int, int] = {}
        self.queue: list[tuple[int, int, int]] = []
        self.served = self.dropped = 0

    def open(self, conn: int) -> None:
        self.generation.setdefault(conn, 1)

    def reset(self, conn: int) -> None:
        if conn in self.generation:
            self.generation[conn] += 1

    def enqueue(self, conn: int, opcode: int) -> None:
        if conn not in self.generation:
            raise FramingError("no such connection")
        if len(self.queue) >= self.LIMIT:
            raise FramingError("queue full")
        self.queue.append((conn, self.generation[conn], opcode))

    def process(self) -> None:
        for conn, generation, _ in self.queue:
            if self.generation.get(conn) == generation:
                self.served += 1
            else:
                self.dropped += 1
        self.queue.clear()


class Scopes:
    """Nested scopes of plugins; the end of a scope drops what was registered in it."""

    MAX_DEPTH, MAX_PLUGINS = 64, 256

    def __init__(self) -> None:
        self.depth = 0
        self.plugins: dict[int, tuple[int, int]] = {}

    def begin(self) -> None:
        if self.depth >= self.MAX_DEPTH:
            raise FramingError("scopes too deep")
        self.depth += 1

    def end(self) -> None:
        if not self.depth:
            raise FramingError("no scope to end")
        self.plugins = {p: (h, d) for p, (h, d) in self.plugins.items() if d < self.depth}
        self.depth -= 1

    def register(self, plugin: int, handler: int) -> None:
        if plugin not in self.plugins and len(self.plugins) >= self.MAX_PLUGINS:
            raise FramingError("too many plugins")
        self.plugins[plugin] = (handler, self.depth)

    def invoke(self, plugin: int) -> int:
        if plugin not in self.plugins:
            raise FramingError("no such plugin")
        return self.plugins[plugin][0]


class RecordStore:
    """Values with a time to live from insertion, and the least recently used out over capacity."""

    def __init__(self, capacity: int, ttl: int):
        self.capacity, self.ttl = capacity, ttl
        self.held: OrderedDict = OrderedDict()
        self.hits = self.misses = self.evictions = 0

    def put(self, key, value, now: int) -> None:
        self.held[key] = (now, value)
        self.held.move_to_end(key)
        while len(self.held) > self.capacity:
            self.held.popitem(last=False)
            self.evictions += 1

    def get(self, key, now: int):
        found = self.held.get(key)
        if found is None or now - found[0] >= self.ttl:
            if found is not None:
                del self.held[key]
            self.misses += 1
            return None
        self.held.move_to_end(key)
        self.hits += 1
        return found[1]


class SchemaRegistry:
    """Field lists by id; a definition starts at version 1, an update adds one and needs a definition."""

    def __init__(self) -> None:
        self.held: dict[int, tuple[int, tuple]] = {}

    def define(self, number: int, fields: tuple) -> None:
        self.held[number] = (1, fields)

    def update(self, number: int, fields: tuple) -> None:
        if number not in self.held:
            raise FramingError("update of an unknown schema")
        self.held[number] = ((self.held[number][0] + 1) % (1 << 16), fields)

    def remove(self, number: int) -> bool:
        return self.held.pop(number, None) is not None


class Reassembly:
    """The fragments of one flow, within its limits."""

    def __init__(self, config: Config) -> None:
        self.limit, self.most = 4 * config.window_size, config.max_fragments
        self.base, self.parts = 0, []

    def add(self, offset: int, data: bytes) -> None:
        if len(self.parts) >= self.most or sum(len(p) for _, p in self.parts) + len(data) > self.limit:
            raise FramingError("too many fragments or bytes")
        self.parts.append((offset, data))

    def reorder(self, start: int, end: int) -> None:
        if end < start or end - start > self.limit:
            raise FramingError("bad reorder span")
        self.base = start

    def whole(self) -> bytes:
        return merge_bytes(self.base, self.parts, self.limit)


class Session:
    """Every message kind of a session, in order. Errors are counted and change nothing else.

    ``outputs`` collects what messages produce: (clock, kind, id, bytes or None, number or None).
    """

    def __init__(self, config: Config = Config(), table: FlowTable | None = None, templates: TemplateCache | None = None) -> None:  # noqa: B008  (frozen)
        self.config = config
        self.table = table or FlowTable(config.flow_capacity, config.flow_idle_ticks)
        self.templates = templates or TemplateCache(config.template_capacity)
        self.schemas, self.connections, self.scopes, self.modules = SchemaRegistry(), Connections(), Scopes(), Modules()
        self.clock, self.opened, self.errors, self.records = 1, False, 0, 0
        self.flows: dict[int, Reassembly] = {}
        self.windows: dict[int, list] = {}  # ring and cursor
        self.channels: dict[int, bytearray] = {}
        self.sections: list[tuple[int, int, bytes]] = []
        self.pending: int | None = None
        self.codec, self.codec_limit, self.stride, self.entries = CODEC_NONE, 16 * config.window_size, 1, ()
        self.live_channels = 0
        self.outputs: list[tuple[int, str, int, bytes | None, int | None]] = []
        self.handlers = {MESSAGE_CODES[name]: getattr(self, f"on_{name.lower()}") for name in MESSAGE_CODES}

    def message(self, code: int, payload: bytes) -> None:
        self.clock += 1
        try:
            self._dispatch(code, payload)
        except (FramingError, CodecError, TransformError, struct.error, ValueError):
            self.errors += 1

    def _dispatch(self, code: int, payload: bytes) -> None:
        if not self.opened and MESSAGE_GATED[code]:
            raise FramingError("message before the session was opened")
        self.handlers[code](Cursor(payload))

    def emit(self, kind: str, number: int, data: bytes | None = None, value: int | None = None) -> None:
        self.outputs.append((self.clock, kind, number, data, value))

    # Session, schemas, data.

    def on_session_open(self, c: Cursor) -> None:
        c.take(4)
        self.opened = True

    def on_session_close(self, c: Cursor) -> None:
        self.table.flush()
        self.opened = False

    def on_schema_def(self, c: Cursor) -> None:
        self.schemas.define(c.number(2), tuple(parse_fields(c)))

    def on_schema_update(self, c: Cursor) -> None:
        self.schemas.update(c.number(2), tuple(parse_fields(c)))

    def on_template_def(self, c: Cursor) -> None:
        number, schema = c.number(2), c.number(2)
        for gone in self.templates.define(number, (schema, tuple(parse_fields(c)))):
            self.table.purge(gone)

    def on_data_record(self, c: Cursor) -> None:
        template, flow, src, dst, sport, dport, proto, octets, packets = DATA_HEADER.unpack(c.take(DATA_HEADER.size))
        found = self.templates.get(template)
        if found is None:
            raise FramingError("no such template")
        self.records += 1
        if self.config.aggregate:
            self.table.update((src, dst, flow, sport, dport, proto), octets, packets, self.clock, template, found[0])
        self.table.sweep(self.clock)

    def on_nested_record(self, c: Cursor, depth: int = 0) -> None:
        if depth > MAX_NESTED:
            raise FramingError("nested too deep")
        if depth == 0 and c.left() and c.data[0] == 0x0F:
            self.emit("structured", len(decode_structured(c.data)["elements"]))
            return
        inner = c.number(1)
        if inner == MESSAGE_CODES["DATA_RECORD"]:
            self.on_data_record(c)
        elif inner in NESTED:
            self.on_nested_record(Cursor(c.take(c.left())), depth + 1)

    on_continuation = on_nested_record

    # Fragments, windows.

    def on_flow_open(self, c: Cursor) -> None:
        flow = c.number(4)
        self.flows.setdefault(flow, Reassembly(self.config))
        self._window(flow, c)

    def _window(self, number: int, c: Cursor) -> None:
        size = c.number(4) if c.left() >= 4 else self.config.window_size
        self.windows.setdefault(number, [RingWindow(min(max(size, 64), 4 * self.config.window_size)), 0])

    def _known(self, held: dict, number: int):
        if number not in held:
            raise FramingError("never opened")
        return held[number]

    def on_fragment(self, c: Cursor) -> None:
        flow, offset = c.number(4), c.number(4, signed=True)
        data = c.take(c.number(2))
        self._known(self.flows, flow).add(offset, data)

    def on_fragment_reorder(self, c: Cursor) -> None:
        flow = c.number(4)
        self._known(self.flows, flow).reorder(c.number(4, signed=True), c.number(4, signed=True))

    def on_flow_timeout(self, c: Cursor) -> None:
        flow = c.number(4)
        found = self.flows.pop(flow, None)
        if found is not None:
            self.emit("reassembled", flow, found.whole())
        self.windows.pop(flow, None)

    def on_stream_open(self, c: Cursor) -> None:
        self._window(c.number(4), c)

    def on_packet(self, c: Cursor) -> None:
        window = self._known(self.windows, c.number(4))[0]
        window.place(c.number(8), c.take(c.left()))

    def on_read_window(self, c: Cursor) -> None:
        number = c.number(4)
        context = self._known(self.windows, number)
        data = context[0].read(c.number(8), c.number(4))
        context[1] += len(data)
        self.emit("read", number, data)

    def on_seek_relative(self, c: Cursor) -> None:
        number = c.number(4)
        context = self._known(self.windows, number)
        to = context[1] + c.number(4, signed=True)
        if not 0 <= to <= context[0].size:
            raise FramingError("seek out of range")
        context[1] = to
        self.emit("cursor", number, value=to)

    # Codecs, sections, snapshots.

    def on_compressed_block(self, c: Cursor) -> None:
        codec, declared = c.number(1), c.number(8)
        limit = min(max(c.number(4), 1), 16 * self.config.window_size)
        data = inflate(codec, c.take(c.left()), limit, self.entries)
        self.emit("inflated", codec, data[:declared] if declared else data)

    def on_compress_config(self, c: Cursor) -> None:
        codec = c.number(1)
        if codec > CODEC_DICT and codec != CODEC_PASS:
            raise FramingError("no such codec")
        limit = c.number(4) if c.left() >= 4 else 0
        stride = c.number(4) if codec == CODEC_DELTA and c.left() >= 4 else 0
        if stride > 64:
            raise FramingError("stride too wide")
        self.codec = codec
        self.codec_limit = min(limit, 1 << 24) or self.codec_limit
        self.stride = stride or self.stride
        if codec == CODEC_DICT:
            entries = []
            while c.left() >= 2:
                size = c.number(2)
                if size > c.left():
                    break
                entries.append(c.take(size))
            self.entries = tuple(entries)

    def on_compress_data(self, c: Cursor) -> None:
        self.emit("inflated", self.codec, inflate(self.codec, c.take(c.left()), self.codec_limit, self.entries, self.stride))

    def on_section_header(self, c: Cursor) -> None:
        count, stride = c.number(4), c.number(4)
        if not count or not stride or count > 1 << 20 or stride > 1 << 16:
            raise FramingError("section out of bounds")
        body = c.take(c.left())
        whole = min(len(body) // stride, count) * stride
        self.sections = [*self.sections, (count, stride, body[:whole])][-8:]
        self.emit("section", count, value=whole // stride)

    def on_snapshot_begin(self, c: Cursor) -> None:
        at = c.number(4)
        if at >= len(self.sections):
            raise FramingError("no such section")
        self.pending = at

    def on_snapshot_commit(self, c: Cursor) -> None:
        size = c.number(4)
        body = c.take(min(size, c.left()))
        if self.pending is not None and self.pending < len(self.sections):
            count, stride, old = self.sections[self.pending]
            self.sections[self.pending] = (count, stride, (body + old[len(body) :])[: count * stride])
        self.pending = None
        if body[:4] == SNAPSHOT_MAGIC:
            self.emit("snapshot", len(parse_snapshot(body)))

    # Connections, scopes, programs, channels.

    def on_conn_open(self, c: Cursor) -> None:
        self.connections.open(c.number(4))

    def on_conn_reset(self, c: Cursor) -> None:
        self.connections.reset(c.number(4))

    def on_request(self, c: Cursor) -> None:
        self.connections.enqueue(c.number(4), c.number(2))

    def on_process_queue(self, c: Cursor) -> None:
        self.connections.process()
        self.emit("served", self.connections.served, value=self.connections.dropped)

    def on_scope_begin(self, c: Cursor) -> None:
        self.scopes.begin()

    def on_scope_end(self, c: Cursor) -> None:
        self.scopes.end()

    def on_plugin_register(self, c: Cursor) -> None:
        self.scopes.register(c.number(4), c.number(2))

    def on_plugin_invoke(self, c: Cursor) -> None:
        plugin = c.number(4)
        self.emit("plugin", plugin, value=self.scopes.invoke(plugin))

    def on_module_load(self, c: Cursor) -> None:
        self.modules.load(c.number(4), c.take(c.left()))

    def on_module_reload(self, c: Cursor) -> None:
        self.modules.reload(c.number(4), c.take(c.left()))

    def on_call_symbol(self, c: Cursor) -> None:
        symbol = c.number(4)
        self.emit("result", symbol, value=self.modules.call(symbol, c.number(8) if c.left() >= 8 else 0))

    def on_channel_open(self, c: Cursor) -> None:
        channel, size = c.number(4), min(max(c.number(4), 1), 1 << 20)
        self.channels.setdefault(channel, bytearray(size))
        self.live_channels += 1

    def on_channel_alloc(self, c: Cursor) -> None:
        channel, size = c.number(4), min(max(c.number(4), 1), 1 << 20)
        self.live_channels += channel not in self.channels
        self.channels[channel] = (self.channels.get(channel, bytearray()) + bytes(size))[:size]

    def on_channel_teardown(self, c: Cursor) -> None:
        self.live_channels -= self.channels.pop(c.number(4), None) is not None


class Broker:
    """Sessions by transport. At the soft cap, sessions idle for long enough go when another message comes."""

    def __init__(self, config: Config = Config(), soft_cap: int = 4096) -> None:  # noqa: B008  (frozen)
        self.config, self.soft_cap, self.clock = config, soft_cap, 0
        self.sessions: OrderedDict[int, Session] = OrderedDict()  # least recently used first
        self.seen: dict[int, int] = {}
        self.reaped: list[int] = []

    def route(self, transport: int, stream: bytes) -> None:
        """A stream that can't be read raises, and none of it is applied."""
        self.clock += 1
        messages = parse_stream(stream)
        session = self.sessions.setdefault(transport, Session(self.config))
        self.sessions.move_to_end(transport)
        self.seen[transport] = self.clock
        for m in messages:
            session.message(m.code, m.payload)
        while len(self.sessions) >= self.soft_cap:
            oldest = next(iter(self.sessions))
            if oldest == transport or self.clock - self.seen[oldest] < self.config.flow_idle_ticks:
                break
            self.sessions.pop(oldest)
            del self.seen[oldest]
            self.reaped.append(oldest)

    def totals(self) -> dict[str, int]:
        held = self.sessions.values()
        return {"sessions": len(held), "records": sum(s.records for s in held), "errors": sum(s.errors for s in held), "messages": sum(s.clock - 1 for s in held)}


FLOW_ROWS = "transport_id long, src long, dst long, flow_id long, sport int, dport int, proto int, octets long, packets long, records long, first_ms long, last_ms long, template_id int, template_gen long, layout_changed boolean, reason string"


#: Rows that a replay holds back before it hands them on.
ROWS_AT_ONCE = 10_000


def in_order(rows: DataFrame, order: list[str], start: Callable[[], object], step: Callable[[object, tuple], None], drain: Callable[[object, object, bool], list[tuple]], schema: str) -> DataFrame:
    """Sequential state over each key, the first column of ``rows``, in order of the columns ``order``.

    A task reads its sorted keys as a stream and holds the state of one key, never its rows.
    ``drain(key, state, ended)`` gives the rows that are ready.
    """
    key = rows.columns[0]
    kept = [c for c in rows.columns if c not in order]
    target = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], arrow.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, out = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or row[0] != name:
                    if state is not None:
                        out += drain(name, state, True)
                    name, state = row[0], start()
                step(state, row[1:])
            if state is not None:
                out += drain(name, state, False)
            if len(out) >= ROWS_AT_ONCE:
                yield batch_of(out)
                out = []
        if state is not None:
            out += drain(name, state, True)
        yield batch_of(out)

    return rows.repartition(key).sortWithinPartitions(key, *order).select(*kept).mapInArrow(run, target)


MESSAGE_ORDER = ["capture_ts_ms", "stream_id", "seq"]


def _readable(messages: DataFrame) -> DataFrame:
    return messages.where("error is null").select("transport_id", *MESSAGE_ORDER, "type_code", "payload")


def flow_rows(transport: int, flows: list[tuple[tuple, Flow, str]]) -> list[tuple]:
    wrap = lambda x: x - (1 << 64) if x >> 63 else x
    return [(transport, *k, wrap(f.octets), wrap(f.packets), f.records, f.first_ms, f.last_ms, f.template_id, f.template_gen, f.layout_changed, why) for k, f, why in flows]


def replay_sessions(messages: DataFrame, capacity: int = 65_536, idle: int = 30_000, templates: int = 256) -> DataFrame:
    """Flows of every session with the reason for which they left the table; ``live`` if they did not."""

    def drain(transport: int, session: Session, ended: bool) -> list[tuple]:
        out = flow_rows(transport, session.table.emitted)
        session.table.emitted.clear()
        return out + flow_rows(transport, [(k, f, "live") for k, f in session.table.live.items()]) if ended else out

    return in_order(_readable(messages), MESSAGE_ORDER, lambda: Session(table=FlowTable(capacity, idle), templates=TemplateCache(templates)), lambda s, m: s.message(m[0], bytes(m[1])), drain, FLOW_ROWS)


OUTPUT_ROWS = "transport_id long, clock long, kind string, id long, data binary, value long"


def session_outputs(messages: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008  (frozen)
    """What the messages of every session produce, kind by kind, and at last its counters."""

    def drain(transport: int, session: Session, ended: bool) -> list[tuple]:
        out = [(transport, *r) for r in session.outputs]
        session.outputs.clear()
        if ended:
            counters = {"messages": session.clock - 1, "errors": session.errors, "records": session.records, "flows": len(session.table.live), "channels": session.live_channels}
            out += [(transport, session.clock, name, 0, None, n) for name, n in counters.items()]
        return out

    return in_order(_readable(messages), MESSAGE_ORDER, lambda: Session(config), lambda s, m: s.message(m[0], bytes(m[1])), drain, OUTPUT_ROWS)


def store_outcomes(events: DataFrame, owner: str, capacity: int, ttl: int, key: str = "key", kind: str = "kind", now: str = "now") -> DataFrame:
    """``owner, hits, misses, evictions`` of a record store for each owner, events in order of ``now``.

    ``kind`` is put or get.
    """
    kept = events.select(F.col(owner).alias("owner"), F.col(key).alias("key"), F.col(kind).alias("kind"), F.col(now).cast("long").alias("now"), F.col(now).cast("long").alias("__at"))

    def step(store: RecordStore, row: tuple) -> None:
        key, kind, now = row
        if kind == "put":
            store.put(key, None, now)
        else:
            store.get(key, now)

    def drain(name: object, store: RecordStore, ended: bool) -> list[tuple]:
        return [(name, store.hits, store.misses, store.evictions)] if ended else []

    return in_order(kept, ["__at"], lambda: RecordStore(capacity, ttl), step, drain, f"owner {kept.schema['owner'].dataType.simpleString()}, hits long, misses long, evictions long")


def template_outcomes(events: DataFrame, owner: str, capacity: int, template: str = "template", ord: str = "ord") -> DataFrame:
    """``owner, hits, misses, evictions`` of a template cache for each owner; what is missing is defined."""
    kept = events.select(F.col(owner).alias("owner"), F.col(template).cast("long").alias("template"), F.col(ord).alias("__at"))

    def step(state: list, row: tuple) -> None:
        cache = state[0]
        if cache.get(row[0]) is None:
            state[2] += 1
            state[3] += len(cache.define(row[0], ()))
        else:
            state[1] += 1

    def drain(name: object, state: list, ended: bool) -> list[tuple]:
        return [(name, *state[1:])] if ended else []

    return in_order(kept, ["__at"], lambda: [TemplateCache(capacity), 0, 0, 0], step, drain, f"owner {kept.schema['owner'].dataType.simpleString()}, hits long, misses long, evictions long")


def window_reads(events: DataFrame, owner: str, size: int, ord: str = "ord") -> DataFrame:
    """``owner, seq, data, error`` of every read from an owner's ring window.

    An event with ``data`` places it at ``seq``; one with a null reads ``n`` bytes from there.
    """
    kept = events.select(F.col(owner).alias("owner"), F.col("seq").cast("long").alias("seq"), F.col("n").cast("int").alias("n"), "data", F.col(ord).alias("__at"))

    def step(state: tuple, row: tuple) -> None:
        window, out = state
        seq, n, data = row
        try:
            if data is None:
                out.append((seq, window.read(seq, n), None))
            else:
                window.place(seq, data)
        except ValueError as e:
            out.append((seq, None, str(e)))

    def drain(name: object, state: tuple, ended: bool) -> list[tuple]:
        rows = [(name, *r) for r in state[1]]
        state[1].clear()
        return rows

    return in_order(kept, ["__at"], lambda: (RingWindow(size), []), step, drain, f"owner {kept.schema['owner'].dataType.simpleString()}, seq long, data binary, error string")


def scope_states(events: DataFrame, owner: str, kind: str = "kind", plugin: str = "plugin", ord: str = "ord") -> DataFrame:
    """``owner, depth, plugins, errors`` after all events (begin, end, register) of each owner."""
    kept = events.select(F.col(owner).alias("owner"), F.col(kind).alias("kind"), F.col(plugin).cast("long").alias("plugin"), F.col(ord).alias("__at"))

    def step(state: list, row: tuple) -> None:
        scopes = state[0]
        try:
            {"begin": scopes.begin, "end": scopes.end, "register": lambda: scopes.register(row[1], 0)}[row[0]]()
        except FramingError:
            state[1] += 1

    def drain(name: object, state: list, ended: bool) -> list[tuple]:
        return [(name, state[0].depth, len(state[0].plugins), state[1])] if ended else []

    return in_order(kept, ["__at"], lambda: [Scopes(), 0], step, drain, f"owner {kept.schema['owner'].dataType.simpleString()}, depth long, plugins long, errors long")


def module_calls(events: DataFrame, owner: str, ord: str = "ord") -> DataFrame:
    """``owner, symbol, value`` of every call, in order of an owner's events ``kind, number, code``.

    Kinds are load, reload and unload of a module, and call of a symbol; a call that goes wrong gives null.
    """
    kept = events.select(F.col(owner).alias("owner"), "kind", F.col("number").cast("long").alias("number"), "code", F.col(ord).alias("__at"))

    def step(state: tuple, row: tuple) -> None:
        modules, out = state
        kind, number, code = row
        try:
            if kind == "call":
                out.append((number, modules.call(number)))
            elif kind == "unload":
                modules.unload(number)
            else:
                (modules.load if kind == "load" else modules.reload)(number, code)
        except TransformError:
            if kind == "call":
                out.append((number, None))

    def drain(name: object, state: tuple, ended: bool) -> list[tuple]:
        rows = [(name, *r) for r in state[1]]
        state[1].clear()
        return rows

    return in_order(kept, ["__at"], lambda: (Modules(), []), step, drain, f"owner {kept.schema['owner'].dataType.simpleString()}, symbol long, value long")
