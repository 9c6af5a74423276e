import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillstone import types as K
from rillstone.functions import bytes as B
from rillstone.operators import decode as D
from rillstone.operators import reassembly, replay, sessions
from rillstone.sources import datasources, framing, messages

FIELDS = [(1, "u32", 4)]
ROW = (1, 2, 3, 4, 5, 6, 2**63 + 5, 8, 9, 10, 11, 256, 1)


def happy():
    return framing.stream([framing.session_open(0x1000), framing.template_def(256, 1, FIELDS), framing.data_record(256, 1, 9, 8, 7, 6, 17, 100, 1), framing.data_record(256, 1, 9, 8, 7, 6, 17, 50, 1)])


def test_streams():
    found = framing.parse_stream(happy() + b"behind")
    assert [K.MESSAGE_NAMES[m.code] for m in found] == ["SESSION_OPEN", "TEMPLATE_DEF", "DATA_RECORD", "DATA_RECORD"]
    assert found[0].offset == 8 and found[1].offset == 22
    unknown = framing.stream([(0x70, b"xx"), framing.session_open(1)])
    assert len(framing.parse_stream(unknown)) == 1
    for bad in (b"", b"XXXX" + happy()[4:], happy()[:-1], framing.stream([], version=9)):
        with pytest.raises(framing.FramingError):
            framing.parse_stream(bad)
    with pytest.raises(framing.FramingError):
        framing.parse_stream(unknown, strict=True)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, 255), st.integers(0, 120))
def test_mutations_give_errors_only(at, byte, cut):
    data = bytearray(happy())
    data[at % len(data)] = byte
    data = bytes(data[: len(data) - cut])
    rows = messages.message_rows("s", 1, 0, data)
    assert len(rows) == 1 or all(r[-1] is None for r in rows)
    for parse in (framing.parse_snapshot, framing.parse_catalog, lambda d: list(framing.parse_capture(d)), lambda d: list(framing.parse_batch(d))):
        try:
            parse(data)
        except framing.FramingError:
            pass


def test_containers():
    assert list(framing.parse_capture(framing.capture([(5, b"ab"), (6, b"")]))) == [(5, b"ab"), (6, b"")]
    assert list(framing.parse_batch(framing.batch([b"ab", b""]))) == [b"ab", b""]
    assert framing.parse_snapshot(framing.snapshot([ROW, ROW])) == [ROW, ROW]
    broken = bytearray(framing.snapshot([ROW]))
    broken[20] ^= 1
    for bad in (bytes(broken), framing.snapshot([ROW])[:-1]):
        with pytest.raises(framing.FramingError):
            framing.parse_snapshot(bad)
    sample = (7, 2, [(1, "u32", 0, "src"), (2, "bytes", 64, "payload")])
    assert framing.parse_catalog(framing.catalog([(7, 1, sample[2]), sample, (7, 1, sample[2])])) == [sample]
    c = framing.Cursor(b"abc")
    assert c.seek(99) == 3 and c.skip(-2) == 1 and c.take(1) == b"b"
    with pytest.raises(framing.FramingError):
        c.skip(5)


def test_data_sources(spark, tmp_path):
    datasources.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.cap").write_bytes(framing.capture([(5, happy()), (6, happy()[:-1])]))
    (tmp_path / "in/b.bin").write_bytes(happy())
    (tmp_path / "c.batch").write_bytes(framing.batch([happy(), happy()]))
    df = spark.read.format("flow_capture").load(str(tmp_path / "in"))
    assert df.where("error is null").count() == 8 and df.where("error is not null").count() == 1
    assert df.where("type_name = 'DATA_RECORD'").count() == 4
    assert datasources.read_captures(spark, str(tmp_path / "in")).where("error is null").count() == 8
    assert spark.read.format("flow_capture").option("framing", "batch").load(str(tmp_path / "c.batch")).count() == 8
    spark.createDataFrame([(5, bytearray(happy()))], "ts long, data binary").write.format("flow_capture").mode("append").save(str(tmp_path / "out"))
    assert spark.read.format("flow_capture").load(str(tmp_path / "out")).count() == 4
    flows = spark.createDataFrame([(1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 256, 1)], K.FLOWS)
    flows.coalesce(1).write.format("flow_snapshot").mode("append").save(str(tmp_path / "snap"))
    assert spark.read.format("flow_snapshot").load(str(tmp_path / "snap")).collect() == flows.collect()
    assert datasources.decode_snapshots(datasources.encode_snapshot(flows.coalesce(1))).collect() == flows.collect()
    (tmp_path / "cat").write_bytes(framing.catalog([(7, 2, [(1, "u32", 0, "src")])]))
    assert spark.read.format("schema_catalog").load(str(tmp_path / "cat")).first().fields[0].name == "src"
    (tmp_path / "in/.hidden").write_bytes(b"no capture")
    query = datasources.stream_captures(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("captured").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("captured").count() == 9


def test_session_gate_and_flows(spark):
    early = framing.stream([framing.data_record(256, 1, 9, 8, 7, 6, 17, 100, 1), framing.session_open(1)])
    df = spark.createDataFrame([("a", 1, 0, bytearray(happy())), ("b", 2, 0, bytearray(early))], "stream_id string, transport_id long, capture_ts_ms long, data binary")
    found = messages.parse_streams(df)
    flows = sessions.session_flows(found).collect()
    assert [(r.transport_id, r.octets, r.records) for r in flows] == [(1, 150, 2)]
    replayed = replay.replay_sessions(found).collect()
    assert [(r.octets, r.records, r.first_ms, r.last_ms) for r in replayed] == [(150, 2, flows[0].first_ms, flows[0].last_ms)]
    verdicts = {(r.transport_id, r.type_name): r.verdict for r in messages.admit(sessions.clocked(found)).collect()}
    assert verdicts[2, "DATA_RECORD"] == "not_open" and verdicts[1, "DATA_RECORD"] == "admitted"
    assert sessions.templates_fit(found).first().fits


def test_random_sessions_match_replay(spark):
    rng = random.Random(5)
    streams = []
    for t in range(4):
        out = [framing.session_open(t)]
        for _ in range(120):
            template = rng.choice([256, 257, 258])
            if rng.random() < 0.1:
                out.append(framing.template_def(template, 1, FIELDS))
            else:
                out.append(framing.data_record(template, rng.randrange(4), rng.randrange(2), 1, 1, 1, 6, rng.randrange(100), 1))
        streams.append((f"s{t}", t, 0, bytearray(framing.stream(out))))
    found = messages.parse_streams(spark.createDataFrame(streams, "stream_id string, transport_id long, capture_ts_ms long, data binary"))
    columns = ["transport_id", *K.FLOW_KEY, "octets", "records", "first_ms", "last_ms"]
    as_rows = lambda df: sorted(tuple(map(int, r)) for r in df.select(*columns).collect())
    assert as_rows(sessions.session_flows(found, idle=9)) == as_rows(replay.replay_sessions(found, idle=9))


def test_flow_table_limits():
    table = replay.FlowTable(capacity=2, idle=0)
    for i in range(4):
        table.update((i,), 1, 1, i)
    assert [k for k, _, why in table.emitted] == [(0,), (1,)] and len(table.live) == 2
    table = replay.FlowTable(idle=1000)
    table.update(("a",), 50, 1, 100, 5, 1)
    table.update(("a",), 50, 1, 200, 5, 2)
    assert table.live[("a",)].octets == 100 and table.live[("a",)].layout_changed
    table.sweep(1199)
    assert table.live
    table.sweep(1200)
    assert not table.live and table.emitted[0][2] == "idle"
    table.update(("x",), 1, 1, 1, 7)
    table.update(("y",), 1, 1, 1, 9)
    table.purge(7)
    assert list(table.live) == [("y",)]
    cache = replay.TemplateCache(2)
    assert not cache.define(1, ()) and not cache.define(2, ()) and cache.get(1)
    assert cache.define(3, ()) == [2] and not cache.define(1, ()) and cache.peek(1)[0] == 2
    store = replay.RecordStore(2, 100)
    store.put("a", 1, 0)
    assert store.get("a", 200) is None and store.misses == 1
    for k in "abc":
        store.put(k, k, 300)
    assert store.get("a", 301) is None and store.get("c", 301) == "c" and store.evictions == 1


def test_connections_and_scopes():
    c = replay.Connections()
    c.open(1)
    c.enqueue(1, 5)
    c.reset(1)
    c.enqueue(1, 6)
    c.process()
    assert (c.served, c.dropped) == (1, 1)
    with pytest.raises(framing.FramingError):
        c.enqueue(9, 1)
    s = replay.Scopes()
    s.register(1, 10)
    s.begin()
    s.register(2, 20)
    assert s.invoke(2) == 20
    s.end()
    assert s.invoke(1) == 10
    for bad in (lambda: s.invoke(2), s.end):
        with pytest.raises(framing.FramingError):
            bad()


def test_records(spark):
    fields = [(8, "u32", 4, "src"), (82, "utf8", 0, "name"), (900, "fixed", 3, "tag"), (901, "i64", 8, "delta")]
    values = [[1, "é" * 300, b"abc", -5], [2**32 - 1, "", b"xyz", 2**62]]
    raw = [D.encode_record(fields, v) for v in values]
    assert [D.decode_record(fields, r) for r in raw] == values
    assert D.decode_records(fields, b"".join(raw)) == values
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate([*raw, raw[0][:-1], b"\0\0\0\1\1\xff"])], "i int, body binary")
    found = D.decode(df, fields).orderBy("i").collect()
    assert [r.record and list(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r.record)) for r in found[:2]] == values
    assert found[2].error and found[3].error == "invalid UTF-8"
    assert D.decode(spark.createDataFrame([(bytearray(b"".join(raw)),)], "body binary"), fields, batch=True).count() == 2
    for bad in (b"", b"\1\0\0\1", b"\1\2\0\3ab", b"\7"):
        with pytest.raises(framing.FramingError):
            D.decode_structured(bad)
    assert D.decode_structured(b"\1\2\0\3" b"112233")["elements"] == [b"11", b"22", b"33"]
    assert D.decode_structured(b"\2\1\0\2\0\1xy") == {"kind": "rows", "element_len": 2, "template_id": 256, "elements": [b"xy"]}
    assert D.pack_row(fields[:1], [5], 8) == b"\0\0\0\5\0\0\0\0"
    with pytest.raises(framing.FramingError):
        D.pack_row(fields, values[0], 8)


def test_reassembly(spark):
    assert reassembly.merge_bytes(0, [(4, b"world"), (0, b"helo")], 99) == b"heloworld"
    assert reassembly.merge_bytes(0, [(2, b"x")], 99) == b"\0\0x"
    for bad in ([(-1, b"x")], [(98, b"xx")]):
        with pytest.raises(ValueError):
            reassembly.merge_bytes(0, bad, 99)
    w = reassembly.RingWindow(50)
    w.place(60, b"abcdef")
    assert w.size == 64 and w.read(60, 6) == b"abcdef" and w.high == 66
    with pytest.raises(ValueError):
        w.place(0, bytes(65))
    df = spark.createDataFrame([(1, i, bytearray(n)) for i, n in enumerate([10, 9000, 9000, 6000])], "f int, ord long, data binary")
    assert sorted(r.ord for r in reassembly.accepted(df, ["f"]).collect()) == [0, 1, 3]
    moves = spark.createDataFrame([(1, 1, 10), (1, 2, -20), (1, 3, 5)], "k int, o int, d int")
    assert tuple(reassembly.seek(moves, ["k"], "d", 12, "o").first()) == (1, 10, 2)


def test_admitted_over_the_limits(spark, sf):
    """The sequential definition over documents of every length, of which some are refused pieces."""
    from rillstone.queries.wire_queries import fragments, r_admitted

    arrived = {}
    for r in fragments(spark, sf).select("doc_id", "ord", F.length("data").alias("n")).collect():
        arrived.setdefault(r.doc_id, []).append((r.ord, r.n))
    expected = {}
    for i, parts in arrived.items():
        size = count = 0
        for _, n in sorted(parts):
            if count < reassembly.MAX_FRAGMENTS and size + n <= 4 * reassembly.WINDOW_SIZE:
                size, count = size + n, count + 1
        expected[i] = count
    assert {r.doc_id: r.pieces for r in r_admitted(spark, sf).collect()} == expected
    assert any(n < len(arrived[i]) for i, n in expected.items())


def test_info_model_and_types(spark):
    assert K.message_types(spark).count() == 36 and K.info_model(spark).count() == len(K.ELEMENTS) == 58
    assert struct.calcsize(framing.SNAPSHOT_ROW.format) == 63 and framing.DATA_HEADER.size == 35
    assert K.message_types(spark).where(F.col("is_control")).count() == 12


def test_every_message_kind(spark):
    """One session that uses all 36 kinds."""
    m = lambda name, *parts: (K.MESSAGE_CODES[name], b"".join(p if isinstance(p, bytes) else struct.pack(">I", p) for p in parts))
    record = framing.data_record(256, 1, 9, 8, 7, 6, 17, 100, 1)[1]
    u16, u64 = (lambda x: struct.pack(">H", x)), (lambda x: struct.pack(">Q", x))
    packed = B.rle_encode(b"aaaaaaaabbbb")
    snap = framing.snapshot([ROW])
    out = [
        m("REQUEST", 1, u16(5)),  # before the session is open: an error
        framing.session_open(1),
        framing.schema_def(1, FIELDS),
        framing.schema_def(1, FIELDS, update=True),
        framing.schema_def(9, FIELDS, update=True),  # an error
        framing.template_def(256, 1, FIELDS),
        (K.MESSAGE_CODES["DATA_RECORD"], record),
        m("NESTED_RECORD", b"\x22\x0f\x06" + record),
        m("NESTED_RECORD", b"\x22" * 9 + b"\x06" + record),  # too deep: an error
        m("CONTINUATION", b"\x0f\1\2\0\x02aabb"),
        m("FLOW_OPEN", 5, 4096),
        framing.fragment(5, 6, b"world"),
        framing.fragment(5, 0, b"hello "),
        m("FRAGMENT_REORDER", 5, 0, 100),
        m("FLOW_TIMEOUT", 5),
        m("STREAM_OPEN", 6, 64),
        m("PACKET", 6, u64(60), b"abcdef"),
        m("READ_WINDOW", 6, u64(60), 6),
        m("SEEK_RELATIVE", 6, struct.pack(">i", -2)),
        m("SEEK_RELATIVE", 6, struct.pack(">i", -20)),  # an error
        m("COMPRESSED_BLOCK", b"\1", u64(0), 100, packed),
        m("COMPRESS_CONFIG", b"\5", 1000, u16(2), b"xy"),
        m("COMPRESS_DATA", b"\x80\0\0z"),
        m("SECTION_HEADER", 3, 2, b"aabb"),
        m("SNAPSHOT_BEGIN", 0),
        m("SNAPSHOT_COMMIT", len(snap), snap),
        m("CONN_OPEN", 1),
        m("REQUEST", 1, u16(5)),
        m("CONN_RESET", 1),
        m("REQUEST", 1, u16(6)),
        m("PROCESS_QUEUE"),
        m("SCOPE_BEGIN"),
        m("PLUGIN_REGISTER", 3, u16(30)),
        m("PLUGIN_INVOKE", 3),
        m("SCOPE_END"),
        m("PLUGIN_INVOKE", 3),  # an error
        m("MODULE_LOAD", 1, b"\x08\0\x01\5\3\x0b"),
        m("CALL_SYMBOL", 1 << 16, u64(37)),
        m("MODULE_RELOAD", 1, b"\x08\0\x01\6\3\x0b"),
        m("CALL_SYMBOL", 1 << 16, u64(37)),
        m("CHANNEL_OPEN", 1, 10),
        m("CHANNEL_ALLOC", 2, 10),
        m("CHANNEL_TEARDOWN", 1),
        framing.session_close(1),
    ]
    assert {code for code, *_ in out} == set(K.MESSAGE_NAMES)
    data = framing.stream(out)
    found = messages.parse_streams(spark.createDataFrame([("a", 1, 0, bytearray(data))], "stream_id string, transport_id long, capture_ts_ms long, data binary"))
    rows = [(r.kind, r.id, r.data and bytes(r.data), r.value) for r in replay.session_outputs(found).orderBy("clock").collect()]
    expected = [
        ("structured", 2, None, None),
        ("reassembled", 5, b"hello world", None),
        ("read", 6, b"abcdef", None),
        ("cursor", 6, None, 4),
        ("inflated", 1, b"aaaaaaaabbbb", None),
        ("inflated", 5, b"xyz", None),
        ("section", 3, None, 2),
        ("snapshot", 1, None, None),
        ("served", 1, None, 1),
        ("plugin", 3, None, 30),
        ("result", 1 << 16, None, 42),
        ("result", 1 << 16, None, 43),
    ]
    assert rows[: len(expected)] == expected
    assert dict((k, v) for k, _, _, v in rows[len(expected) :]) == {"messages": len(out), "errors": 5, "records": 2, "flows": 0, "channels": 1}
    assert [(r.octets, r.records) for r in sessions.session_flows(found).collect()] == [(200, 2)]
    broker = replay.Broker(soft_cap=2, config=replay.Config(flow_idle_ticks=2))
    for t in (1, 2, 2, 3):
        broker.route(t, data)
    assert broker.reaped == [1] and broker.totals()["sessions"] == 2 and broker.totals()["errors"] == 15
