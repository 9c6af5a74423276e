"""Binary streams: written from the tables, read back, decoded, resolved, reassembled."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decode, reassembly, replay, sessions
from ..session import read_table
from ..sources import framing, messages
from ..sources.datasources import decode_snapshots, encode_snapshot
from ..types import FLOW_KEY
from . import query
from .flow_queries import flow_table
from .views import FLOW_EVENTS, FLOWS, flow_events

TEMPLATE_FIELDS = [(8, "u32", 4), (12, "u32", 4), (1, "u64", 8)]


def streams(spark: SparkSession, d: str) -> DataFrame:
    """Flow events as streams: a session for each source, a stream for each of its groups of 20,000
    orders, the session opened and its template defined in the first."""
    e = flow_events(spark, d).withColumn("part", F.expr("ord div 20000000000000"))
    first = e.groupBy("src").agg(F.min("part").alias("first"))
    kept = ["src", "part", "ord", "dst", "sport", "dport", "proto", "flow_id", "octets", "packets"]
    rows = e.join(first, "src").select("first", *kept).repartition("src", "part").sortWithinPartitions("src", "part", "ord")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def whole() -> pa.RecordBatch:
            src, part = name
            columns = ([f"{src}/{part:08d}"], [src], [part], [framing.stream(held)])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["stream_id", "transport_id", "capture_ts_ms", "data"])

        for batch in batches:
            for first, src, part, _, dst, sport, dport, proto, flow_id, octets, packets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (src, part) != name:
                    if name is not None:
                        yield whole()
                    name, held = (src, part), [framing.session_open(7), framing.template_def(256, 1, TEMPLATE_FIELDS)] if part == first else []
                held.append(framing.data_record(256, flow_id, src, dst, sport, dport, proto, octets, packets, struct.pack(">I", packets)))
        if name is not None:
            yield whole()

    return rows.mapInArrow(pack, "stream_id string, transport_id long, capture_ts_ms long, data binary")


TICKS = f"SELECT *, 3 + row_number() OVER (PARTITION BY src ORDER BY ord) AS clock FROM ({FLOW_EVENTS})"


@query(f"SELECT type_name, count(*) AS n, CAST(sum(len) AS BIGINT) AS bytes FROM (SELECT 'DATA_RECORD' AS type_name, 39 AS len FROM ({FLOW_EVENTS}) UNION ALL SELECT 'SESSION_OPEN', 8 FROM (SELECT DISTINCT src FROM ({FLOW_EVENTS})) UNION ALL SELECT 'TEMPLATE_DEF', 21 FROM (SELECT DISTINCT src FROM ({FLOW_EVENTS}))) GROUP BY 1")
def s_parse_streams(spark: SparkSession, d: str) -> DataFrame:
    return messages.parse_streams(streams(spark, d)).groupBy("type_name").agg(F.count("*").alias("n"), F.sum(F.length("payload")).cast("long").alias("bytes"))


@query("SELECT count(*) AS streams, count(*) FILTER (o_custkey % 3 <> 0) AS good, count(*) FILTER (o_custkey % 3 = 0) AS errors FROM orders")
def s_damaged_streams(spark: SparkSession, d: str) -> DataFrame:
    """A stream for each order, of which those of every third customer lost their last byte: a damaged
    stream gives one error row and none of its messages."""
    good = framing.stream([framing.session_open(1), framing.session_close(1)])
    cut = F.when(F.col("o_custkey") % 3 == 0, F.substring(F.lit(good), 1, len(good) - 1)).otherwise(F.lit(good))
    rows = read_table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("stream_id"), F.col("o_custkey").alias("transport_id"), F.lit(0).alias("capture_ts_ms"), cut.alias("data"))
    found = messages.parse_streams(rows)
    return found.agg(F.count_distinct("stream_id").alias("streams"), F.count_distinct(F.when(F.col("type_name") == "SESSION_OPEN", F.col("stream_id"))).alias("good"), F.count_if(F.col("error").isNotNull()).alias("errors"))


@query(f"SELECT 'data' AS category, count(*) AS messages, CAST(count(*) * 39 AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS rejected FROM ({FLOW_EVENTS}) UNION ALL SELECT 'session', count(DISTINCT src), count(DISTINCT src) * 8, 0 FROM ({FLOW_EVENTS}) UNION ALL SELECT 'schema', count(DISTINCT src), count(DISTINCT src) * 21, 0 FROM ({FLOW_EVENTS})")
def s_router(spark: SparkSession, d: str) -> DataFrame:
    return messages.routed(messages.admit(sessions.clocked(messages.parse_streams(streams(spark, d)))))


@query(f"SELECT src AS transport_id, CAST(clock AS BIGINT) AS clock, CAST(256 AS BIGINT) AS template_id, src, flow_id, octets, packets, CAST(1 AS BIGINT) AS schema_id, CAST(3 AS BIGINT) AS field_count, CAST(1 AS BIGINT) AS generation, packets AS body FROM ({TICKS})")
def j_resolved_records(spark: SparkSession, d: str) -> DataFrame:
    """Data records by the session's gate, clock and templates, with the body's first column."""
    found = sessions.resolved_records(messages.parse_streams(streams(spark, d)))
    return found.select("transport_id", "clock", "template_id", "src", "flow_id", "octets", "packets", "schema_id", "field_count", "generation", messages.big_endian(F.col("body"), 0, 4).alias("body"))


LIVES = f"""SELECT src AS transport_id, {', '.join(FLOW_KEY)}, CAST(sum(octets) AS BIGINT) AS octets, CAST(sum(packets) AS BIGINT) AS packets, count(*) AS records, min(clock) AS first_ms, max(clock) AS last_ms FROM (
  SELECT *, sum(gone) OVER (PARTITION BY {', '.join(FLOW_KEY)} ORDER BY clock ROWS UNBOUNDED PRECEDING) AS life FROM (
    SELECT *, CASE WHEN lag(clock) OVER (PARTITION BY src ORDER BY clock) >= lag(clock) OVER (PARTITION BY {', '.join(FLOW_KEY)} ORDER BY clock) + 700 THEN 1 ELSE 0 END AS gone FROM ({TICKS}))) GROUP BY {', '.join(FLOW_KEY)}, life"""


@query(LIVES)
def s_session_flows(spark: SparkSession, d: str) -> DataFrame:
    """Flows of whole sessions from bytes, natively."""
    found = sessions.session_flows(messages.parse_streams(streams(spark, d)), idle=700)
    return found.select("transport_id", *FLOW_KEY, "octets", "packets", "records", "first_ms", "last_ms")


@query(LIVES)
def l_replayed_flows(spark: SparkSession, d: str) -> DataFrame:
    """The same by the sequential table."""
    found = replay.replay_sessions(messages.parse_streams(streams(spark, d)), capacity=10_000_000, idle=700)
    return found.select("transport_id", *[F.col(c).cast("long").alias(c) for c in FLOW_KEY], "octets", "packets", "records", "first_ms", "last_ms")


@query(None)
def l_bounded_table(spark: SparkSession, d: str) -> DataFrame:
    """A table of 64 flows a session: what is evicted, what idles out, what stays."""
    found = replay.replay_sessions(messages.parse_streams(streams(spark, d)), capacity=64, idle=700)
    return found.groupBy("transport_id", "reason").agg(F.count("*").alias("flows"), F.sum("octets").alias("octets"))


@query(f"SELECT type_name, detail, count(*) AS n FROM (SELECT 'DATA_RECORD' AS type_name, 'template=256 flow=0x' || lower(lpad(hex(flow_id), 8, '0')) AS detail FROM ({FLOW_EVENTS}) UNION ALL SELECT 'SESSION_OPEN', 'session=0x00000007 features=0x00000000' FROM (SELECT DISTINCT src FROM ({FLOW_EVENTS})) UNION ALL SELECT 'TEMPLATE_DEF', 'template=256 schema=1 fields=3' FROM (SELECT DISTINCT src FROM ({FLOW_EVENTS}))) GROUP BY ALL")
def s_inspect(spark: SparkSession, d: str) -> DataFrame:
    return messages.inspect(messages.parse_streams(streams(spark, d))).groupBy("type_name", "detail").agg(F.count("*").alias("n"))


@query(f"SELECT src AS transport_id, count(*) + 2 AS messages, CAST(0 AS BIGINT) AS errors, CAST(count(*) * 39 + 29 AS BIGINT) AS bytes, count(*) AS records, CAST(0 AS BIGINT) AS flows_opened, CAST(1 AS BIGINT) AS templates, CAST(0 AS BIGINT) AS fragments FROM ({FLOW_EVENTS}) GROUP BY src")
def l_metrics(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.flows import message_metrics

    return message_metrics(messages.parse_streams(streams(spark, d)))


@query(f"SELECT {', '.join(FLOW_KEY)}, octets, packets, records, first_ms, last_ms FROM ({FLOWS})")
def s_snapshot_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = flow_table(spark, d).withColumn("template_id", F.lit(256)).withColumn("template_gen", F.lit(1).cast("long"))
    return decode_snapshots(encode_snapshot(rows)).select(*[F.col(c).cast("long").alias(c) for c in (*FLOW_KEY, "octets", "packets", "records", "first_ms", "last_ms")])


RECORD = [(8, "u32", 0, "src"), (11, "u16", 0, "port"), (900, "i32", 0, "delta"), (85, "u64", 0, "octets"), (82, "utf8", 0, "name"), (400, "bytes", 0, "raw")]


def records(spark: SparkSession, d: str) -> DataFrame:
    """Events as record bytes with two variable fields at the end."""
    e = flow_events(spark, d)
    image = lambda c, n: F.lpad(F.substring(F.lpad(F.hex(c), 16, "0"), 17 - 2 * n, 2 * n), 2 * n, "0")
    delta = F.col("packets") - 25
    name = F.concat(F.lit("flow-"), F.col("flow_id").cast("string"))
    var = lambda c: F.concat(F.lpad(F.hex(F.length(c)), 2, "0"), F.hex(c))
    body = F.unhex(F.concat(image(F.col("src"), 4), image(F.col("dport"), 2), image(delta, 4), image(F.col("octets"), 8), var(name.cast("binary")), var(F.unhex(image(F.col("ord"), 8)))))
    return e.select("ord", body.alias("body"))


@query(f"SELECT ord, src, dport AS port, packets - 25 AS delta, octets, 'flow-' || flow_id AS name, lower(lpad(hex(ord), 16, '0')) AS raw, src + dport + packets - 25 + octets AS total FROM ({FLOW_EVENTS})")
def d_decode(spark: SparkSession, d: str) -> DataFrame:
    found = decode.decode(records(spark, d), RECORD)
    r = lambda c: F.col(f"record.{c}")
    return found.select("ord", r("src").alias("src"), r("port").cast("long").alias("port"), r("delta").cast("long").alias("delta"), r("octets").alias("octets"), r("name").alias("name"), F.lower(F.hex(r("raw"))).alias("raw"), decode.integral_sum(RECORD).alias("total"))


@query(f"SELECT ord, src, dport AS port, packets - 25 AS delta, octets FROM ({FLOW_EVENTS})")
def d_decode_native(spark: SparkSession, d: str) -> DataFrame:
    """Only fields at fixed offsets: no Python."""
    found = decode.decode(records(spark, d), RECORD[:4])
    return found.select("ord", *[F.col(f"record.{c}").cast("long").alias(c) for c in ("src", "port", "delta", "octets")])


@query(f"SELECT src, count(*) AS elements, CAST(sum(octets) AS BIGINT) AS total FROM ({FLOW_EVENTS}) GROUP BY src")
def d_structured(spark: SparkSession, d: str) -> DataFrame:
    """A list of eight-byte elements for each source, decoded and exploded."""
    e = flow_events(spark, d).groupBy("src", (F.col("ord") % 64).alias("g")).agg(F.collect_list(F.lpad(F.hex("octets"), 16, "0")).alias("x"))
    head = F.concat(F.lit("0108"), F.lpad(F.hex(F.size("x")), 4, "0"))
    packed = e.select("src", F.unhex(F.concat(head, F.array_join("x", ""))).alias("data"))
    found = decode.structured(packed, "data").select("src", F.explode("list.elements").alias("b"))
    return found.groupBy("src").agg(F.count("*").alias("elements"), F.sum(messages.big_endian(F.col("b"), 0, 8)).alias("total"))


def fragments(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut into overlapping pieces of 300 bytes, out of order."""
    t = read_table(spark, d, "documents").where("text is not null and text <> ''").select("doc_id", F.col("text").cast("binary").alias("b"))
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.length("b") - 1) / 256).cast("int"))).alias("i")
    cut = t.select("doc_id", "b", piece)
    return cut.select("doc_id", (F.col("i") * 256).cast("long").alias("offset"), ((F.col("i") * 7919) % 1009 * 1000 + F.col("i")).cast("long").alias("ord"), F.expr("substring(b, i * 256 + 1, 300)").alias("data"))


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE text <> ''")
def r_reassemble(spark: SparkSession, d: str) -> DataFrame:
    return reassembly.reassemble(fragments(spark, d), ["doc_id"], limit=1 << 26).select("doc_id", F.md5("data").alias("digest"))


ARRIVALS = "SELECT doc_id, (i * 7919) % 1009 * 1000 + i AS ord, least(300, size - i * 256) AS n FROM (SELECT doc_id, octet_length(encode(text)) AS size, unnest(range((octet_length(encode(text)) + 255) // 256)) AS i FROM documents WHERE text <> '')"


@query(f"""WITH RECURSIVE a AS (SELECT doc_id, ord, n, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM ({ARRIVALS})),
  f AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS pieces FROM a WHERE k = 1
    UNION ALL SELECT f.doc_id, a.k, CASE WHEN f.pieces < 256 AND f.bytes + a.n <= 16384 THEN f.bytes + a.n ELSE f.bytes END, CASE WHEN f.pieces < 256 AND f.bytes + a.n <= 16384 THEN f.pieces + 1 ELSE f.pieces END FROM f JOIN a ON a.doc_id = f.doc_id AND a.k = f.k + 1)
  SELECT doc_id, max(pieces) AS pieces FROM f GROUP BY doc_id""")
def r_admitted(spark: SparkSession, d: str) -> DataFrame:
    """Documents of every length, of which the longest exceed the limits."""
    return reassembly.accepted(fragments(spark, d), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("pieces"))


@query(f"SELECT ord, CAST(i AS BIGINT) AS row, CAST((octets >> (8 * (7 - 2 * i))) & 255 AS BIGINT) * 0 + ((octets >> (16 * (3 - i))) & 65535) AS v FROM ({FLOW_EVENTS}), (SELECT unnest(range(4)) AS i)")
def r_sections(spark: SparkSession, d: str) -> DataFrame:
    """Eight bytes as a grid of four rows of two."""
    grid = flow_events(spark, d).select("ord", F.unhex(F.lpad(F.hex("octets"), 16, "0")).alias("body"))
    rows = reassembly.section_rows(grid, "body", F.lit(6), F.lit(2))
    return rows.select("ord", F.col("row").cast("long").alias("row"), messages.big_endian(F.col("bytes"), 0, 2).alias("v"))


@query(f"""WITH RECURSIVE e AS (SELECT src, octets % 101 - 50 AS d, row_number() OVER (PARTITION BY src ORDER BY ord) AS n FROM ({FLOW_EVENTS})),
  f AS (SELECT src, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS refused FROM e WHERE n = 1
    UNION ALL SELECT f.src, e.n, CASE WHEN f.place + e.d BETWEEN 0 AND 4096 THEN f.place + e.d ELSE f.place END, CASE WHEN f.place + e.d BETWEEN 0 AND 4096 THEN f.refused ELSE f.refused + 1 END FROM f JOIN e ON e.src = f.src AND e.n = f.n + 1)
  SELECT src, arg_max(place, n) AS "at", max(refused) AS refused FROM f GROUP BY src""")
def r_seek(spark: SparkSession, d: str) -> DataFrame:
    e = flow_events(spark, d).withColumn("delta", F.col("octets") % 101 - 50)
    return reassembly.seek(e, ["src"], "delta", 4096, "ord")


@query("SELECT * FROM (VALUES (1, 1, 2, 8, 'u32', 4, 'sourceIPv4Address'), (1, 1, 2, 900, 'fixed', 3, 'f900'), (1, 2, 1, 82, 'utf8', 0, 'interfaceName'), (2, 1, 1, 82, 'utf8', 0, 'interfaceName')) t(schema_id, version, field_count, id, type, width, name)")
def d_schema_registry(spark: SparkSession, d: str) -> DataFrame:
    """Definitions and updates from bytes, with versions and field lists."""
    one, two = [(8, "u32", 4), (900, "fixed", 3)], [(82, "utf8", 0)]
    sent = [framing.session_open(1), framing.schema_def(3, one, update=True), framing.schema_def(1, one), framing.schema_def(1, two, update=True), framing.schema_def(2, two)]
    raw = spark.createDataFrame([("a", 1, 0, bytearray(framing.stream(sent)))], "stream_id string, transport_id long, capture_ts_ms long, data binary")
    found = messages.schema_versions(messages.schema_definitions(sessions.clocked(messages.parse_streams(raw))))
    fields = found.select(F.col("schema_id").cast("int").alias("schema_id"), "version", F.col("field_count").cast("int").alias("field_count"), F.explode(messages.field_list()).alias("f"))
    return fields.select("schema_id", "version", "field_count", "f.id", "f.type", "f.width", "f.name")


@query(None)
def r_record_store(spark: SparkSession, d: str) -> DataFrame:
    e = flow_events(spark, d).select(F.col("src").alias("owner"), F.col("dst").alias("key"), F.when(F.col("ord") % 3 == 0, "put").otherwise("get").alias("kind"), "ord")
    return replay.store_outcomes(e, "owner", 5, 10**12, now="ord")
