import math
import random

import pytest
from pyspark.sql import functions as F

from rillstone import config, export, report, transform
from rillstone.functions import columns as C
from rillstone.operators import analytics, flows, joins
from rillstone.operators import timeseries as ts
from rillstone.plans.query import FlowQuery
from rillstone.queries.series_queries import ewma_model
from rillstone.streaming import windows


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lit(x):
    return F.lit(x).cast("long")


def test_builtins(spark):
    b = C.builtin
    assert one(spark, b("clamp", lit(15), lit(0), lit(10)), b("gcd", lit(12), lit(8)), b("gcd", lit(-7540113804746346429), lit(4660046610375530309)), b("popcount", lit(-1)), b("leading_zeros", lit(0))) == (10, 4, 1, 64, 64)
    assert one(spark, b("ceil_div", lit(-7), lit(2)), b("ceil_div", lit(5), lit(0)), b("wrap_add", lit(2**63 - 1), lit(1)), b("abs", lit(-(2**63)))) == (-3, 0, -(2**63), -(2**63))
    assert b("gcd", lit(1)) is None and b("nosuch", lit(1)) is None


def test_addresses(spark):
    ten = lit(0x0A010203)
    assert one(spark, C.in_cidr(ten, "10.0.0.0/8"), C.in_cidr(ten, "11.0.0.0/8"), C.in_cidr(ten, "0.0.0.0/0"), C.ipv4_text(ten), C.ipv4_number(F.lit("10.1.2.3")), C.ipv4_number(F.lit("10.1.2.300"))) == (True, False, True, "10.1.2.3", 0x0A010203, None)
    assert one(spark, C.network(ten, 16), C.broadcast_address(ten, 16)) == (0x0A010000, 0x0A01FFFF)
    assert C.port_set("80, 443, 2048-1024") == [(80, 80), (443, 443), (1024, 2048)]
    assert C.port_set("10-20,21-30") == [(10, 30)] and C.port_count("10-20,21-30") == 21
    assert one(spark, C.in_ports(lit(1500), "80,443,1024-2048"), C.in_ports(lit(79), "80,443,1024-2048")) == (True, False)
    mac = F.unhex(F.lit("0123456789ab"))
    assert one(spark, C.mac_text(mac), C.mac_is_multicast(mac), C.mac_is_local(mac), C.hex_text(C.mac_bytes(F.lit("01:23:45:67:89:AB")))) == ("01:23:45:67:89:ab", True, False, "0123456789ab")
    for bad in ("10.0.0.0/33", "10.0.0/8", "x"):
        with pytest.raises(ValueError):
            C.cidr(bad)


def test_text_forms(spark):
    assert one(spark, F.base64(F.lit(b"foobar")), C.hex_text(C.hex_bytes(F.lit("de ad\nbe ef"))), C.varint_len(lit(0)), C.varint_len(lit(128)), C.varint_len(lit(-1)), C.ts48_value(C.ts48_bytes(lit(1 << 40)))) == ("Zm9vYmFy", "deadbeef", 1, 2, 10, 1 << 40)
    assert one(spark, C.to_epoch(lit(5)), C.from_epoch(lit(0)), C.hex_preview(F.lit(b"\x01\x02"))) == (0, 1577836800000, "01 02")


def test_analytics(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 4, 8, 16, 100, 1000)], "v long")
    stats = analytics.histogram_stats(df, "v").first()
    assert (stats.total, stats.max) == (7, 1000)
    empty = df.where("false")
    assert {r.p: r.value for r in analytics.percentiles(analytics.histogram(empty, "v"), [0.0, 0.5]).collect()} == {0.0: 0, 0.5: 0}
    assert {r.p: r.value for r in analytics.percentiles(analytics.histogram(df, "v"), [0.0, 0.5, 1.0]).collect()} == {0.0: 1, 0.5: 8, 1.0: 512}
    top = spark.createDataFrame([(1, 10), (2, 30), (3, 20)], "k int, w long")
    assert [r.key for r in analytics.top_n(top, "k", "w", 2).collect()] == [2, 3]
    uniform = spark.createDataFrame([(bytearray(range(256)),)], "b binary")
    assert analytics.entropy(analytics.byte_counts(uniform, "b")).first().bits > 7.99
    assert analytics.entropy(analytics.byte_counts(spark.createDataFrame([(bytearray(b"aaaa"),)], "b binary"), "b")).first().bits == 0
    assert analytics.entropy(analytics.byte_counts(uniform.where("false"), "b")).first().bits == 0
    big = spark.createDataFrame([(2**63 - 1,), (1,)], "v long")
    assert {r.bucket for r in analytics.histogram(big, "v").collect()} == {62, 0}
    assert analytics.kll_sketch(df, "v").first().sketch


def test_flow_expiry_and_stats(spark):
    df = spark.createDataFrame([(1, 500, 0), (1, 1900, 1000), (5, 1900, 100), (1, 1990, 1900)], "records long, last_ms long, first_ms long")
    reasons = [r[0] for r in df.select(flows.expiry(F.lit(2000), idle=1000, active=1500, cap=5)).collect()]
    assert reasons == ["idle", "none", "record_cap", "none"]
    f = spark.createDataFrame([(1000, 10, 1, 0, 1000), (0, 0, 1, 5, 5)], "octets long, packets long, records long, first_ms long, last_ms long")
    a, b = flows.stats(f).collect()
    assert (a.bps, a.mean_packet) == (8000, 100) and (b.mean_packet, b.burstiness) == (0, 100)
    wrapped = spark.createDataFrame([(1, 2**63 - 1, 1, 0, 1), (1, 2**63 - 1, 1, 0, 2), (1, 4, 1, 0, 3)], "src int, octets long, packets long, ts_ms long, ord long")
    assert flows.accumulate(wrapped, ["src"], wrap=True).first().octets == 2
    with pytest.raises(Exception, match="OVERFLOW"):
        flows.accumulate(wrapped, ["src"]).collect()
    mirror = spark.createDataFrame([(1, 2, 100, 200, 6, 1000, 10), (2, 1, 200, 100, 6, 500, 8)], "src long, dst long, sport long, dport long, proto long, octets long, packets long")
    both = flows.biflows(mirror).collect()
    assert len(both) == 1 and both[0].total_octets == 1500 and both[0].ratio == 2.0


def test_series(spark):
    rng = random.Random(2)
    samples, t = [], 0
    for _ in range(300):
        t += rng.randrange(900)
        samples.append((t, rng.randrange(50)))
    df = spark.createDataFrame([("k", i, t, v) for i, (t, v) in enumerate(samples)], "key string, ord long, ts_ms long, v long")
    assert math.isclose(ts.ewma(df, 2000.0, ("key",)).first().rate, ewma_model(samples, 2000.0), rel_tol=1e-9)
    assert ewma_model([(i * 1000, 100) for i in range(30)], 2000.0) > 50
    small = spark.createDataFrame([(0, 10), (500, 20), (1000, 5)], "ts_ms long, v long")
    buckets = ts.tumbling(small, 1000)
    assert sorted(r.n for r in buckets.collect()) == [1, 2]
    assert [r.n for r in ts.ring(buckets, 1000, 4).orderBy("start").collect()] == [2, 1]
    assert ts.ring(buckets.where("false"), 1000, 4).count() == 0
    assert max(r.in_window for r in ts.sliding_sum(spark.createDataFrame([("k", 0, 5), ("k", 1000, 5)], "key string, ts_ms long, v long"), 3, ("key",)).collect()) == 10


def test_rings_by_key(spark):
    """Every series has its own ring; a null key is one."""
    df = spark.createDataFrame([(1, 0, 10), (1, 3000, 5), (2, 7000, 1), (2, 7500, 2), (None, 0, 4)], "key long, ts_ms long, v long")
    rings = ts.ring(ts.tumbling(df, 1000, keys=("key",)), 1000, 3, ("key",))
    assert sorted(map(str, map(tuple, rings.collect()))) == sorted(map(str, [(1, 1000, 0, 0, 0), (1, 2000, 0, 0, 0), (1, 3000, 1, 5, 5), (2, 7000, 2, 3, 2), (None, 0, 1, 4, 4)]))
    assert {r.key: round(r.per_second * 3) for r in ts.rate_per_second(rings, 1000, 3, ("key",)).collect()} == {1: 1, 2: 2, None: 1}


def test_intervals_and_interning(spark):
    df = spark.createDataFrame([("a", 0, 50), ("a", 100, 150), ("b", 0, 100), ("b", 100, 200), ("c", 5, 5)], "k string, s long, e long")
    merged = joins.islands(df, ["k"], "s", "e")
    assert sorted(tuple(r) for r in merged.collect()) == [("a", 0, 50), ("a", 100, 150), ("b", 0, 200)]
    assert [tuple(r) for r in joins.gaps(merged.where("k = 'a'"), ["k"], 150).collect()] == [("a", 50, 50)]
    assert {r.k: (r.covered, r.prefix) for r in joins.coverage(merged, ["k"]).collect()} == {"a": (100, 50), "b": (200, 200)}
    names = spark.createDataFrame([("x", 5), ("y", 1), ("x", 0), ("z", 9), (None, 2)], "n string, o long")
    assert {r.n: r.id for r in joins.intern(names, "n", "o").collect()} == {"x": 0, "y": 1, "z": 2}
    prefixes = spark.createDataFrame(joins.prefix_rows(["10.0.0.0/8", "10.1.0.0/16"]), "base long, prefix_len int, label string")
    found = joins.longest_prefix(spark.createDataFrame([(0x0A010203,), (0x0A020304,), (1,)], "a long"), "a", prefixes)
    assert {r.a: r.label for r in found.collect()} == {0x0A010203: "10.1.0.0/16", 0x0A020304: "10.0.0.0/8", 1: None}
    assert joins.longest_prefix(found.select("a"), "a", prefixes.where("false")).where("label is null").count() == 3


def test_transforms(spark):
    assert transform.run(transform.assemble("push 2\npush 3\nadd\nret")) == 5
    assert transform.run(transform.assemble("load 0\npush 10\nmul\nret"), {0: 7}) == 70
    loop = transform.assemble("again:\npush 0\njz again")
    with pytest.raises(transform.TransformError, match="budget"):
        transform.run(loop)
    for bad in ("push", "jump 3", "load 16", "jz nowhere", "a:\na:", "push x"):
        with pytest.raises(transform.TransformError):
            transform.assemble(bad)
    for bad in (b"\x03", b"\x01", b"\xff", b"\x09\x20", b"\x01\x00\x0a\x80"):
        with pytest.raises(transform.TransformError):
            transform.run(bad)
    code = transform.assemble("pushw 300 ; comment\nstore 2\nload 2\ndup\nsub\njz end\nnop\nend:\nret")
    assert transform.disassemble(code)[0] == "0000: pushw 300" and transform.disassemble(b"\x01")[0] == "0000: <truncated operand>" and transform.disassemble(b"\xee") == ["0000: .byte 0xee"]
    steps, dropped = transform.trace(code, capacity=3)
    assert len(steps) == 3 and dropped > 0 and "op=0x0b" in transform.render_trace(steps)
    m = transform.Modules()
    m.load(1, transform.assemble("load 0\npush 1\nadd\nret"))
    assert m.call(1 << 16, 41) == 42
    m.reload(1, transform.assemble("push 9\nret"))
    with pytest.raises(transform.TransformError):
        m.call(1 << 16)  # the symbol is longer than the module now
    with pytest.raises(transform.TransformError):
        m.reload(5, b"")
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.randrange(-(2**63), 2**63), rng.randrange(-(2**63), 2**63)) for _ in range(20)], "a long, b long")
    source = "load 0\nload 1\nmul\nload 0\nsub\nload 1\nadd\nret"
    native = transform.transform(df, transform.assemble(source), {0: "a", 1: "b"})
    assert [r.result for r in native.collect()] == [transform.run(transform.assemble(source), {0: r.a, 1: r.b}) for r in df.collect()]


def test_export_and_report(spark, tmp_path):
    rows = [(0x0A000001, 2, 1, 10, 80, 6, 5000, 4, 1, 0, 100, 256, 1)]
    df = spark.createDataFrame(rows, "src long, dst long, flow_id long, sport long, dport long, proto long, octets long, packets long, records long, first_ms long, last_ms long, template_id long, ord long")
    assert export.lines(df, "json").first().line == '{"src":167772161,"dst":2,"sport":10,"dport":80,"proto":6,"octets":5000,"packets":4,"records":1,"template":256}'
    assert export.lines(df, "csv").first().line == "167772161,2,10,80,6,5000,4,1,256"
    assert export.lines(df, "txt").first().line == "167772161:10 -> 2:80 proto=6 5000o/4p"
    for fmt in ("json", "csv", "text"):
        export.export(df, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns[-1] == "template"
    text = report.flows(FlowQuery().aggregate("count").run(df))
    assert "10.0.0.1" in text and "1 flow(s) shown of 1 matched (1 scanned)" in text and "count = 1" in text
    assert "flows observed : 1" in report.flow_summary(df)
    assert report.table(["a", "bb"], [("x",), ("yyy", 1)], right=(1,)) == "a    bb\n---  --\nx      \nyyy   1\n"
    assert one(spark, export.csv_field(F.lit("a,b")), export.csv_field(F.lit('a"b')), export.csv_field(F.lit("ab"))) == ('"a,b"', '"a""b"', "ab")
    with pytest.raises(ValueError):
        export.lines(df, "xml")


def test_config():
    found = config.parse("# c\ntemplate_capacity = 16\naggregate = off\nwindow_size=0x100\nunknown = 5\n")
    assert (found.template_capacity, found.aggregate, found.window_size) == (16, False, 256)
    assert config.COMPACT.template_capacity == 8
    for bad in ("x", "aggregate = maybe", "window_size = y"):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_cli(capsys, tmp_path):
    from rillstone import cli

    (tmp_path / "a.s").write_text("push 2\nret")
    assert cli.main(["asm", str(tmp_path / "a.s")]) == 0 and "01 02 0b\n3 byte(s)" in capsys.readouterr().out
    assert cli.main(["filter", "a == 1 and b == 2"]) == 0 and "2 field reference(s)" in capsys.readouterr().out
    assert cli.main(["filter", "a =="]) == 1


def test_streaming(spark, tmp_path):
    rows = [(1, i % 3, 1, 5, 6, 17, 10 * i, 1, 1000 * i) for i in range(40)]
    names = "session long, src long, flow_id long, sport int, dport int, proto int, octets long, packets long, clock long"
    events = spark.createDataFrame(rows, names).withColumn("dst", F.lit(9).cast("long")).withColumn("ts", F.timestamp_millis("clock"))
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def drain(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(90)
        return spark.table(name).collect()

    found = drain(windows.tumbling(stream, "ts", "10 seconds", value="octets"), "tumbled")
    assert sorted(r.n for r in found) == [10, 10, 10]
    assert drain(windows.stateful_flows(stream, capacity=2, idle=0), "bounded") and all(r.reason == "capacity" for r in spark.table("bounded").collect())
    assert len(drain(windows.idle_flows(stream, "ts", 3001), "idled", "append")) >= 0
    assert drain(windows.sliding(stream, "ts", "10 seconds", "5 seconds", value="octets"), "slid")
    got = []
    q = windows.tee(stream, lambda b, n: got.append(b.count()), lambda b, n: got.append(b.agg(F.sum("octets")).first()[0])).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert got == [40, sum(10 * i for i in range(40))]


def test_quantiles_are_exact(spark):
    found = analytics.quantiles(spark.range(1, 300_002).repartition(7), "id", [0.5, 0.9, 0.99, 1.0])
    assert {r.q: r.value for r in found.collect()} == {0.5: 150_001, 0.9: 270_001, 0.99: 297_001, 1.0: 300_001}
    assert [tuple(r) for r in analytics.quantiles(spark.createDataFrame([(None,)], "v long"), "v", [0.5]).collect()] == [(0.5, None)]
