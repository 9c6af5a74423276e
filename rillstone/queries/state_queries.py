"""Files, sessions, sequential state, records, reports: operators on data from the tables, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config, export, pipeline, report, transform
from ..functions import bytes as B
from ..functions import columns as C
from ..operators import analytics, decode, joins, reassembly, replay, sessions
from ..operators.cursor import RecordCursor
from ..plans import filter_lang as lang
from ..plans.query import FlowQuery
from ..scratch import new_folder
from ..session import read_table
from ..sources import datasources, framing, messages
from ..streaming.windows import tee
from ..types import FLOW_KEY
from . import query
from .flow_queries import flow_table
from .views import FLOW_EVENTS, FLOWS, METRIC_EVENTS, flow_events, metric_events
from .wire_queries import RECORD, records, streams

KEY = ", ".join(FLOW_KEY)
#: The part of a source's orders that make one stream, as ``streams`` cuts them.
PARTS = f"SELECT *, ord // 20000000000000 AS part, min(ord // 20000000000000) OVER (PARTITION BY src) AS first_part FROM ({FLOW_EVENTS})"


def packed(f, *columns: str) -> Column:
    """Bytes that plain Python makes of a row's columns."""

    @F.pandas_udf("binary")
    def run(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([f(*row) for row in frame.itertuples(index=False)], dtype="object")

    return run(F.struct(*columns))


# Containers and files.


@query("SELECT p_partkey, CAST(p_size % 256 AS INTEGER) AS flags FROM part")
def s_stream_flags(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "part").withColumn("data", packed(lambda key, size: framing.stream([framing.session_open(key)], flags=size % 256), "p_partkey", "p_size"))
    return t.select("p_partkey", C.codec_udf(framing.stream_flags, "int")("data").alias("flags"))


def _batches(spark: SparkSession, d: str) -> DataFrame:
    """A batch of streams for each hundred customers."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        return pd.DataFrame({"path": [f"batch{int(group['g'].iloc[0])}"], "content": [framing.batch(framing.stream([framing.session_open(int(k))]) for k in group["key"])]})

    t = read_table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.expr("c_custkey div 100").alias("g"))
    return t.groupBy("g").applyInPandas(one, "path string, content binary")


@query("SELECT 'batch' || (c_custkey // 100) AS batch, count(*) AS streams, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer GROUP BY 1")
def s_batches(spark: SparkSession, d: str) -> DataFrame:
    found = datasources.messages_of(_batches(spark, d), "batch").where("type_name = 'SESSION_OPEN'")
    return found.groupBy(F.substring_index("stream_id", "#", 1).alias("batch")).agg(F.count("*").alias("streams"), F.sum(messages.number(0, 4)).cast("long").alias("total"))


def _captures(spark: SparkSession, d: str) -> str:
    """The flow streams written by the capture sink: a folder of files."""
    datasources.register(spark)
    folder = new_folder(spark, "captures")
    rows = streams(spark, d).select("capture_ts_ms", "data").repartition(4)
    rows.write.format("flow_capture").mode("append").save(folder)
    return folder


CAPTURED = f"SELECT 'DATA_RECORD' AS type_name, count(*) AS n, count(DISTINCT (src, part)) AS streams FROM ({PARTS}) UNION ALL SELECT 'SESSION_OPEN', count(DISTINCT src), count(DISTINCT src) FROM ({PARTS}) UNION ALL SELECT 'TEMPLATE_DEF', count(DISTINCT src), count(DISTINCT src) FROM ({PARTS})"


@query(CAPTURED)
def s_capture_files(spark: SparkSession, d: str) -> DataFrame:
    """Written by the sink, read by Spark's binary reader."""
    found = datasources.read_captures(spark, _captures(spark, d))
    return found.groupBy("type_name").agg(F.count("*").alias("n"), F.count_distinct("stream_id").alias("streams"))


@query(f"SELECT count(*) AS records, CAST(sum(flow_id) AS BIGINT) AS flow_ids FROM ({FLOW_EVENTS})")
def s_capture_source(spark: SparkSession, d: str) -> DataFrame:
    """The same files by the data source, with the type of message pushed into it."""
    found = spark.read.format("flow_capture").load(_captures(spark, d)).where("type_name = 'DATA_RECORD'")
    return messages.data_records(found).agg(F.count("*").alias("records"), F.sum("flow_id").cast("long").alias("flow_ids"))


@query(f"SELECT type_name, n FROM ({CAPTURED})")
def s_capture_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same files as a stream of files, to the end."""
    out, log = new_folder(spark, "streamed"), new_folder(spark, "log")
    found = datasources.stream_captures(spark, _captures(spark, d), maxFilesPerTrigger="2").select("type_name")
    found.writeStream.format("parquet").option("checkpointLocation", log).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("type_name string").parquet(out).groupBy("type_name").agg(F.count("*").alias("n"))


@query(f"SELECT {KEY}, CAST(sum(octets) AS BIGINT) AS octets, CAST(sum(packets) AS BIGINT) AS packets, count(*) AS records FROM ({PARTS}) WHERE part = first_part GROUP BY {KEY} HAVING sum(octets) > 50000")
def s_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """From files to filtered flows. Every stream is a session, so only those that define the template count."""
    return pipeline.run(spark, _captures(spark, d), "octets > 50000").select(*[F.col(c).cast("long").alias(c) for c in FLOW_KEY], "octets", "packets", "records")


SCHEMA_FIELDS = """
SELECT CAST(c_nationkey AS INTEGER) AS schema_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS pos, CAST(c_custkey % 120 + 1 AS INTEGER) AS id,
  CASE c_custkey % 7 WHEN 0 THEN 'u8' WHEN 1 THEN 'u16' WHEN 2 THEN 'u32' WHEN 3 THEN 'u64' WHEN 4 THEN 'fixed' WHEN 5 THEN 'u32' ELSE CASE WHEN c_custkey % 5 = 0 THEN 'utf8' ELSE 'u16' END END AS type,
  CAST(CASE c_custkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 WHEN 4 THEN c_custkey % 4 * 3 WHEN 5 THEN 4 ELSE CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 2 END END AS INTEGER) AS width,
  'c' || c_custkey AS name
FROM customer WHERE c_custkey % 20 < 9"""


def schema_fields(spark: SparkSession, d: str) -> DataFrame:
    """Schemas made of customers: one for each nation, a field for each of nine in twenty customers."""
    read_table(spark, d, "customer").createOrReplaceTempView("__customer")
    return spark.sql(SCHEMA_FIELDS.replace("||", "||").replace("FROM customer", "FROM __customer"))


SLOT = "CASE type WHEN 'u8' THEN 1 WHEN 'u16' THEN 2 WHEN 'u32' THEN 4 WHEN 'u64' THEN 8 WHEN 'fixed' THEN width ELSE 8 END"


@query(f"""SELECT schema_id, pos, CAST(CASE WHEN coalesce(max(CASE WHEN type = 'utf8' THEN 1 ELSE 0 END) OVER w, 0) = 0 THEN coalesce(sum(CASE WHEN type = 'utf8' THEN 0 ELSE {SLOT} END) OVER w, 0) END AS BIGINT) AS "offset"
  FROM ({SCHEMA_FIELDS}) WINDOW w AS (PARTITION BY schema_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def d_layout(spark: SparkSession, d: str) -> DataFrame:
    return decode.layout(schema_fields(spark, d)).select("schema_id", "pos", "offset")


@query(f"SELECT schema_id, CAST(sum({SLOT}) AS BIGINT) AS row_width, CAST(sum(CASE WHEN type = 'utf8' THEN 1 ELSE {SLOT} END) AS BIGINT) AS min_len, CAST(coalesce(min(CASE WHEN type = 'utf8' THEN pos END), max(pos) + 1) AS BIGINT) AS fixed_prefix FROM ({SCHEMA_FIELDS}) GROUP BY 1")
def d_layout_stats(spark: SparkSession, d: str) -> DataFrame:
    return decode.layout_stats(schema_fields(spark, d))


@query(f"""WITH f AS ({SCHEMA_FIELDS}), a AS (SELECT id, arg_min(type, pos) AS type, arg_min(width, pos) AS width FROM f WHERE schema_id < 12 GROUP BY id),
  b AS (SELECT id, arg_min(type, pos) AS type, arg_min(width, pos) AS width FROM f WHERE schema_id >= 12 GROUP BY id)
  SELECT id, CASE WHEN a.type IS NULL THEN 'added' WHEN b.type IS NULL THEN 'removed' WHEN a.type <> b.type THEN 'retyped' ELSE 'rewidth' END AS change, a.type IS NULL AS compatible
  FROM a FULL JOIN b USING (id) WHERE a.type IS DISTINCT FROM b.type OR a.width IS DISTINCT FROM b.width""")
def d_schema_diff(spark: SparkSession, d: str) -> DataFrame:
    """The first twelve nations' fields against the others', each id as it comes first: by its place, then by its customer."""
    f = schema_fields(spark, d)
    place = F.struct("pos", F.substring("name", 2, 20).cast("long"))
    old, new = (f.where(c).groupBy("id").agg(F.min_by(F.struct("type", "width"), place).alias("x")).select("id", "x.*") for c in ("schema_id < 12", "schema_id >= 12"))
    return decode.diff(old, new).select("id", "change", "compatible")


@query(f"""WITH f AS (SELECT *, count(*) OVER (PARTITION BY schema_id, id) AS n FROM ({SCHEMA_FIELDS}))
  SELECT schema_id, pos, 'duplicate id' AS problem FROM f WHERE n > 1 UNION ALL SELECT schema_id, pos, 'zero width' FROM f WHERE type = 'fixed' AND width = 0""")
def d_schema_problems(spark: SparkSession, d: str) -> DataFrame:
    """Without what depends on the information model, which is no table."""
    return decode.problems(schema_fields(spark, d)).where("problem in ('duplicate id', 'zero width')").select("schema_id", "pos", "problem")


@query(f"SELECT schema_id, CAST(3 AS INTEGER) AS version, pos, id, type, width, name FROM ({SCHEMA_FIELDS}) WHERE pos < 200")
def s_catalog_files(spark: SparkSession, d: str) -> DataFrame:
    """Catalogs written by the sink and read by the source."""
    datasources.register(spark)
    folder = new_folder(spark, "catalogs")
    fields = F.sort_array(F.collect_list(F.struct("pos", "id", "type", "width", "name")))
    rows = schema_fields(spark, d).where("pos < 200").groupBy("schema_id").agg(fields.alias("f"))
    rows.select("schema_id", F.lit(3).alias("version"), F.transform("f", lambda x: F.struct(x["id"], x["type"], x["width"], x["name"])).alias("fields")).repartition(3).write.format("schema_catalog").mode("append").save(folder)
    found = spark.read.format("schema_catalog").load(folder)
    return found.select("schema_id", "version", F.posexplode("fields").alias("pos", "f")).select("schema_id", "version", "pos", "f.id", "f.type", "f.width", "f.name")


# Sessions and brokers.


@query(f"SELECT src AS transport_id, kind, CAST(CASE kind WHEN 'messages' THEN count(*) + 2 WHEN 'records' THEN count(*) ELSE 0 END AS BIGINT) AS total FROM ({FLOW_EVENTS}), (SELECT unnest(['messages', 'records', 'errors', 'channels']) AS kind) GROUP BY 1, 2")
def s_session_outputs(spark: SparkSession, d: str) -> DataFrame:
    found = replay.session_outputs(messages.parse_streams(streams(spark, d)))
    return found.where("kind in ('messages', 'records', 'errors', 'channels')").groupBy("transport_id", "kind").agg(F.sum("value").alias("total"))


@query(f"SELECT count(DISTINCT src) AS sessions, CAST(count(*) + 2 * count(DISTINCT src) AS BIGINT) AS messages, CAST(count(*) AS BIGINT) AS records, CAST(0 AS BIGINT) AS errors FROM ({FLOW_EVENTS})")
def s_broker(spark: SparkSession, d: str) -> DataFrame:
    return sessions.broker_totals(sessions.session_totals(messages.parse_streams(streams(spark, d)))).select("sessions", *[F.col(c).cast("long").alias(c) for c in ("messages", "records", "errors")])


@query(f"WITH s AS (SELECT src, max(part) AS last_ms, count(*) AS records FROM ({PARTS}) GROUP BY src) SELECT src AS transport_id, records FROM s WHERE (SELECT count(*) FROM s) >= 5 AND (SELECT max(last_ms) FROM s) - last_ms >= 1")
def s_reapable(spark: SparkSession, d: str) -> DataFrame:
    found = sessions.session_totals(messages.parse_streams(streams(spark, d)))
    return sessions.reapable(found, 5, 1).select("transport_id", "records")


@query(f"SELECT DISTINCT src AS transport_id, CAST(1 AS BIGINT) AS templates, true AS fits FROM ({FLOW_EVENTS})")
def j_templates_fit(spark: SparkSession, d: str) -> DataFrame:
    return sessions.templates_fit(messages.parse_streams(streams(spark, d)), 8)


@query(f"""WITH e AS (SELECT key, v % 23 AS t, row_number() OVER (PARTITION BY key ORDER BY event_id) AS n FROM ({METRIC_EVENTS})),
  p AS (SELECT *, lag(n) OVER (PARTITION BY key, t ORDER BY n) AS before FROM e),
  s AS (SELECT p.key, p.n, any_value(p.before) AS before, count(DISTINCT e.t) AS others FROM p LEFT JOIN e ON e.key = p.key AND e.n > p.before AND e.n < p.n GROUP BY p.key, p.n)
  SELECT key AS owner, count(*) FILTER (before IS NOT NULL AND others < 8) AS hits, count(*) FILTER (before IS NULL OR others >= 8) AS misses,
    greatest(count(*) FILTER (before IS NULL OR others >= 8) - 8, 0) AS evictions FROM s GROUP BY key""")
def j_template_cache(spark: SparkSession, d: str) -> DataFrame:
    """The compact cache of eight templates; in SQL, a template is there if fewer than eight others came since."""
    e = metric_events(spark, d).select("key", (F.col("v") % 23).alias("template"), "event_id")
    return replay.template_outcomes(e, "key", config.COMPACT.template_capacity, ord="event_id")


@query(f"SELECT {KEY}, octets, packets, records, 'live' AS reason FROM ({FLOWS})")
def l_flush(spark: SparkSession, d: str) -> DataFrame:
    """Without an idle time nothing leaves the table before its end."""
    found = replay.replay_sessions(messages.parse_streams(streams(spark, d)), capacity=10_000_000, idle=0)
    return found.select(*[F.col(c).cast("long").alias(c) for c in FLOW_KEY], "octets", "packets", "records", "reason")


@query("SELECT p_partkey, CAST(p_partkey AS INTEGER) AS flow_capacity, CAST(p_size AS INTEGER) AS window_size, p_size % 2 = 0 AS aggregate, CAST(8 AS INTEGER) AS template_capacity FROM part")
def s_config(spark: SparkSession, d: str) -> DataFrame:
    """Settings files made of parts, over the compact preset."""
    hexed, word = F.lower(F.hex("p_size")), F.when(F.col("p_size") % 2 == 0, "yes").otherwise("off")
    t = read_table(spark, d, "part").select("p_partkey", F.concat(F.lit("# a part\n; too\n\nflow_capacity = "), F.col("p_partkey").cast("string"), F.lit("\nwindow_size=0x"), hexed, F.lit("\nunknown = 1\n aggregate = "), word).alias("text"))

    @F.pandas_udf("flow_capacity int, window_size int, aggregate boolean, template_capacity int")
    def parsed(text: pd.Series) -> pd.DataFrame:
        found = [config.parse(x, config.COMPACT) for x in text]
        return pd.DataFrame([(c.flow_capacity, c.window_size, c.aggregate, c.template_capacity) for c in found], columns=["flow_capacity", "window_size", "aggregate", "template_capacity"])

    return t.select("p_partkey", parsed("text").alias("c")).select("p_partkey", "c.*")


@query("SELECT o_orderkey AS owner, CAST(count(*) FILTER (l_linenumber % 2 = 0) AS BIGINT) AS depth, CAST(count(*) FILTER (l_linenumber % 2 = 0) AS BIGINT) AS plugins, CAST(0 AS BIGINT) AS errors FROM (SELECT DISTINCT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1")
def c_scopes(spark: SparkSession, d: str) -> DataFrame:
    """For each line of an order a scope begins and a plugin is registered in it; every other scope ends."""
    t = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").cast("long").alias("plugin")).distinct()
    events = t.select("owner", "plugin", F.posexplode(F.when(F.col("plugin") % 2 == 0, F.array(F.lit("begin"), F.lit("register"))).otherwise(F.array(F.lit("begin"), F.lit("register"), F.lit("end")))).alias("i", "kind"))
    found = replay.scope_states(events.withColumn("ord", F.col("plugin") * 3 + F.col("i")), "owner")
    return found.join(read_table(spark, d, "orders").select(F.col("o_orderkey").alias("owner")), "owner", "left_semi")


@query("SELECT p_partkey AS owner, CAST(65536 AS BIGINT) AS symbol, CAST(unnest([p_size, p_size + 1, NULL]) AS BIGINT) AS value FROM part")
def u_modules(spark: SparkSession, d: str) -> DataFrame:
    """A module that gives a part's size, called, then reloaded as one that gives one more, then unloaded."""
    code = lambda plus: packed(lambda size: transform.assemble(f"push {size + plus}\nret"), "p_size")
    t = read_table(spark, d, "part").select(F.col("p_partkey").alias("owner"), code(0).alias("a"), code(1).alias("b"))
    none = F.lit(None).cast("binary")
    events = [("load", 1, F.col("a")), ("call", 65536, none), ("reload", 1, F.col("b")), ("call", 65536, none), ("unload", 1, none), ("reload", 1, F.col("a")), ("call", 65536, none)]
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("kind"), F.lit(n).cast("long").alias("number"), c.alias("code")) for i, (k, n, c) in enumerate(events)])
    return replay.module_calls(t.select("owner", F.explode(rows).alias("e")).select("owner", "e.*"), "owner")


@query("SELECT p_partkey, unnest(['0000: push ' || p_size, '0002: load 0', '0004: add', '0005: ret']) AS line FROM part")
def u_disassembly(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "part").select("p_partkey", packed(lambda size: transform.assemble(f"push {size}\nload 0\nadd\nret"), "p_size").alias("code"))
    return t.select("p_partkey", F.explode(F.split(C.codec_udf(lambda x: "\n".join(transform.disassemble(x)), "string")("code"), "\n")).alias("line"))


@query("SELECT p_partkey, CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS step, CAST(unnest([p_size, 3, p_size * 3, p_size * 3]) AS BIGINT) AS top FROM part")
def u_trace(spark: SparkSession, d: str) -> DataFrame:
    """The steps of one program for every part's size."""
    transform.register_trace(spark)
    read_table(spark, d, "part").createOrReplaceTempView("__part")
    code = transform.assemble("load 0\npush 3\nmul\nret").hex()
    return spark.sql(f"SELECT p_partkey, t.step, t.top FROM __part, LATERAL transform_trace(X'{code}', CAST(p_size AS BIGINT)) t")


# Filters and queries.


@query(f"SELECT {KEY} FROM ({FLOWS}) WHERE octets > 50000 AND proto = 6")
def f_folded(spark: SparkSession, d: str) -> DataFrame:
    """A tree with constants and double negations, folded before it is compiled."""
    octets, proto = lang.Compare("octets", ">", 50000), lang.Compare("proto", "==", 6)
    tree = lang.And((lang.Const(True), lang.Not(lang.Not(octets)), lang.Or((lang.Const(False), proto, lang.Not(lang.Const(True))))))
    flows = flow_table(spark, d)
    return flows.where(lang.compile_filter(tree, flows, lang.flow_columns(flows))).select(*FLOW_KEY)


@query(f"SELECT count(*) FILTER (src BETWEEN 1 AND 200) AS matches, CAST(0 AS BIGINT) AS compat_matches FROM ({FLOWS})")
def f_depth(spark: SparkSession, d: str) -> DataFrame:
    """A chain of two hundred: one level here, and too deep where every link is nested."""
    flows = flow_table(spark, d)
    text = " or ".join(f"src == {n}" for n in range(1, 201))
    test = lambda compat: F.count_if(lang.compile_filter(text, flows, compat=compat))
    return flows.agg(test(False).alias("matches"), test(True).alias("compat_matches"))


@query(f"SELECT CAST(sum(octets) AS BIGINT) AS octets, count(*) AS scanned FROM ({FLOWS})")
def q_label(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate by its label, from the one pass that counts as well."""
    found = FlowQuery().aggregate("count", "sum_octets", "sum_octets").run(flow_table(spark, d))
    return found.totals.select(found.value("sum_octets").alias("octets"), "scanned")


@query(f"SELECT 'first' AS call, min(ord) AS v FROM ({FLOW_EVENTS}) WHERE dport = 443 AND octets > 90000 UNION ALL SELECT 'count', least(count(*), 500) FROM ({FLOW_EVENTS}) WHERE dport = 443 UNION ALL SELECT 'limit', max(ord) FROM (SELECT ord FROM ({FLOW_EVENTS}) ORDER BY ord LIMIT 70)")
def q_cursor(spark: SparkSession, d: str) -> DataFrame:
    """The first record that matches, a count that stops early, and a limit, over decoded records."""
    found = decode.decode(records(spark, d), RECORD[:4])
    cursor = RecordCursor(found, "ord")
    port, octets = F.col("record.port") == 443, F.col("record.octets") > 90000
    first = cursor.find_first(port & octets).select(F.lit("first").alias("call"), F.col("ord").alias("v"))
    counted = cursor.count(port, most=500).select(F.lit("count").alias("call"), F.col("n").alias("v"))
    return first.union(counted).union(cursor.limit(70).records.agg(F.lit("limit").alias("call"), F.max("ord").alias("v")))


@query(f"SELECT sport AS key, CAST(sum(octets) AS BIGINT) AS weight FROM ({FLOW_EVENTS}) GROUP BY 1 ORDER BY weight DESC, key LIMIT 5")
def a_lossy_top_n(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen ports and room for twenty: nothing is forgotten."""
    return analytics.lossy_top_n(flow_events(spark, d), "sport", "octets", 5)


@query(f"SELECT dport AS key, count(*) AS n FROM ({FLOW_EVENTS}) GROUP BY 1")
def a_top_k_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Four ports, which the sketch has room for, so its counts are exact."""
    return analytics.approx_top_k(flow_events(spark, d), "dport", 10)


@query(f"SELECT q, (SELECT quantile_disc(packets, q) FROM ({FLOW_EVENTS})) AS value FROM (SELECT unnest([CAST(0.5 AS DOUBLE), 0.9, 0.99]) AS q)".replace("(SELECT quantile_disc(packets, q)", "(SELECT CASE q WHEN 0.5 THEN quantile_disc(packets, 0.5) WHEN 0.9 THEN quantile_disc(packets, 0.9) ELSE quantile_disc(packets, 0.99) END"))
def a_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Fifty values, in the middle of which a summary would err by a value."""
    return analytics.quantiles(flow_events(spark, d), "packets", [0.5, 0.9, 0.99])


@query(f"SELECT CAST(length(bin(octets)) - 1 AS BIGINT) AS bucket, count(*) AS n FROM ({FLOW_EVENTS}) GROUP BY 1")
def a_merged_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of two parts of the events, merged."""
    e = flow_events(spark, d)
    found = analytics.merge_histograms(analytics.histogram(e.where("dport < 100"), "octets"), analytics.histogram(e.where("dport >= 100"), "octets"))
    return found.select(F.col("bucket").cast("long").alias("bucket"), "n")


@query(f"SELECT 'octets' AS part, CAST(length(bin(octets)) - 1 AS BIGINT) AS key, count(*) AS n FROM ({FLOWS}) GROUP BY 2 UNION ALL SELECT 'seen', 0, count(*) FROM ({FLOWS})")
def a_snapshot_summary(spark: SparkSession, d: str) -> DataFrame:
    """Flows written as snapshots by the sink, replayed into a summary."""
    datasources.register(spark)
    folder = new_folder(spark, "snapshots")
    rows = flow_table(spark, d).withColumn("template_id", F.lit(256)).withColumn("template_gen", F.lit(1).cast("long"))
    rows.select(*framing.SNAPSHOT_COLUMNS).write.format("flow_snapshot").mode("append").save(folder)
    found = pipeline.snapshot_summary(spark, folder)
    return found["octets"].select(F.lit("octets").alias("part"), F.col("bucket").cast("long").alias("key"), "n").union(found["seen"].select(F.lit("seen"), F.lit(0).cast("long"), "flows_seen"))


# Records.


@query(f"SELECT ord, upper(lpad(hex(src), 8, '0') || lpad(hex(dport), 4, '0') || lpad(hex(octets), 16, '0') || '0000000000000000' || '00') AS image FROM ({FLOW_EVENTS})")
def d_pack_row(spark: SparkSession, d: str) -> DataFrame:
    """Row images of 23 bytes: three fixed fields, eight bytes for a variable one, a zero to fill up."""
    fields = [RECORD[0], RECORD[1], RECORD[3], RECORD[4]]
    image = packed(lambda src, port, octets: decode.pack_row(fields, [src, port, octets, "x"], 23), "src", "dport", "octets")
    return flow_events(spark, d).select("ord", F.hex(image).alias("image"))


@query(f"SELECT event_id, CASE WHEN x < 0 OR x > 4294967295 THEN 4294967295 ELSE x END AS u32, x AS bits, CAST(x AS VARCHAR) AS shown FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN -v - 1 WHEN 1 THEN v ELSE v * 1000003 + 4294967295 END AS x FROM ({METRIC_EVENTS}))")
def d_coercions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    x = F.when(k == 0, -F.col("v") - 1).when(k == 1, F.col("v")).otherwise(F.col("v") * 1000003 + 4294967295)
    t = metric_events(spark, d).select("event_id", x.alias("x"))
    return t.select("event_id", decode.to_u32_saturating(F.col("x")).alias("u32"), decode.to_u64_bits(F.col("x")).alias("bits"), decode.display(F.col("x"), "i64").alias("shown"))


@query(f"""WITH e AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN event_id WHEN event_id % 7 = 1 THEN -1 END AS d FROM ({METRIC_EVENTS})),
  w AS (SELECT *, last_value(d IGNORE NULLS) OVER (PARTITION BY key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM e)
  SELECT event_id AS id, CASE WHEN last > -1 THEN last END AS def FROM w WHERE d IS NULL""")
def d_withdrawn_templates(spark: SparkSession, d: str) -> DataFrame:
    """Records under the last definition of their key, unless it was withdrawn: a withdrawal is one without a definition."""
    k = F.col("event_id") % 7
    e = metric_events(spark, d).select("key", F.col("event_id").alias("id"), F.col("event_id").alias("clock"), k.alias("k"))
    definitions = e.where("k < 2").select("key", "clock", F.when(F.col("k") == 0, F.col("id")).alias("def"))
    return joins.as_of(e.where("k >= 2").select("key", "id", "clock"), definitions, ["key"], "clock", ["def"]).select("id", "def")


# Reassembly.


@query("SELECT doc_id, md5(repeat(chr(0), CAST(doc_id % 5 AS INTEGER)) || text) AS digest FROM documents WHERE text <> ''")
def r_reorder(spark: SparkSession, d: str) -> DataFrame:
    """Pieces numbered from a base that a reorder message set, some bytes before the first piece."""
    from .wire_queries import fragments

    moved = fragments(spark, d).withColumn("base", F.lit(1000) - F.col("doc_id") % 5).withColumn("offset", F.col("offset") + 1000)
    return reassembly.reassemble(moved, ["doc_id"], base="base", limit=1 << 26).select("doc_id", F.md5("data").alias("digest"))


@query("SELECT doc_id AS owner, greatest(octet_length(encode(text)) - 64, 0) AS seq, right(hex(encode(text)), 128) AS tail FROM documents WHERE text <> ''")
def r_window(spark: SparkSession, d: str) -> DataFrame:
    """Every text placed piece by piece in a ring of 1,024 bytes, and its last 64 bytes read from there."""
    t = read_table(spark, d, "documents").where("text <> ''").select("doc_id", F.col("text").cast("binary").alias("b"))
    pieces = t.select("doc_id", "b", F.explode(F.sequence(F.lit(0), F.floor((F.length("b") - 1) / 300).cast("int"))).alias("i"))
    placed = pieces.select("doc_id", (F.col("i") * 300).cast("long").alias("seq"), F.lit(0).alias("n"), F.expr("substring(b, i * 300 + 1, 300)").alias("data"), F.col("i").cast("long").alias("ord"))
    reads = t.select("doc_id", F.greatest(F.length("b") - 64, F.lit(0)).cast("long").alias("seq"), F.least(F.length("b"), F.lit(64)).alias("n"), F.lit(None).cast("binary").alias("data"), F.lit(1 << 40).alias("ord"))
    found = replay.window_reads(placed.union(reads), "doc_id", 1000)
    return found.select("owner", "seq", F.hex("data").alias("tail"))


# Codecs.


@query("SELECT p_partkey, repeat('0000', CAST(p_size % 10 AS INTEGER)) || lpad(hex(p_partkey % 256), 2, '0') || repeat('00', 2 * (10 - CAST(p_size % 10 AS INTEGER)) - 1) || 'FF' AS image FROM part")
def k_scatter(spark: SparkSession, d: str) -> DataFrame:
    """Two entries, one at a part's size and one at ten, at a stride of two."""
    t = read_table(spark, d, "part").select("p_partkey", packed(lambda key, size: B.varint(2) + B.varint(size % 10) + bytes([key % 256]) + B.varint(10) + b"\xff", "p_partkey", "p_size").alias("sparse"))
    return t.select("p_partkey", F.hex(C.codec_udf(lambda x: B.scatter_decode(x, 64, 2), "binary")("sparse")).alias("image"))


VARINT = "CASE WHEN {x} < 128 THEN 1 WHEN {x} < 16384 THEN 2 WHEN {x} < 2097152 THEN 3 ELSE 4 END"


@query(f"SELECT l_orderkey, 1 + {VARINT.format(x='any_value(low)')} + CAST(sum({VARINT.format(x='(v - low)')}) AS BIGINT) AS size, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM (SELECT l_orderkey, v, min(v) OVER (PARTITION BY l_orderkey) AS low FROM (SELECT l_orderkey, CAST(floor(l_extendedprice) AS BIGINT) AS v FROM lineitem)) GROUP BY l_orderkey")
def k_block(spark: SparkSession, d: str) -> DataFrame:
    """Prices of an order as one frame-of-reference block: its bytes, and what they decode to."""
    values = F.sort_array(F.collect_list(F.struct("l_linenumber", F.floor("l_extendedprice").cast("long").alias("v"))))
    t = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(values, lambda x: x["v"]).alias("x"))

    @F.pandas_udf("size long, total long, n long")
    def coded(x: pd.Series) -> pd.DataFrame:
        raw = [B.block_encode([int(v) for v in row]) for row in x]
        back = [B.block_decode(r) for r in raw]
        return pd.DataFrame({"size": [len(r) for r in raw], "total": [sum(b) for b in back], "n": [len(b) for b in back]})

    return t.select("l_orderkey", coded("x").alias("c")).select("l_orderkey", "c.*")


# Exports and reports.


@query(f"""SELECT '{{"sourceIPv4Address":' || src || ',"port":' || dport || ',"delta":' || (packets - 25) || ',"octets":' || octets || ',"name":"flow-' || flow_id || '","raw":"' || lower(lpad(hex(ord), 16, '0')) || '"}}' AS line FROM ({FLOW_EVENTS})""".replace("sourceIPv4Address", "src"))
def x_record_json(spark: SparkSession, d: str) -> DataFrame:
    found = decode.decode(records(spark, d), RECORD)
    return found.select(export.record_json(found).alias("line"))


@query(f"SELECT 'json' AS format, count(*) AS n, CAST(sum(octets) AS BIGINT) AS octets FROM ({FLOWS}) UNION ALL SELECT 'csv', count(*), sum(octets) FROM ({FLOWS}) UNION ALL SELECT 'text', count(*), NULL FROM ({FLOWS})")
def x_files(spark: SparkSession, d: str) -> DataFrame:
    """Flows written in each format and read back."""
    flows = flow_table(spark, d).withColumn("template_id", F.lit(256))
    folders = {fmt: new_folder(spark, fmt) for fmt in ("json", "csv", "text")}
    for fmt, folder in folders.items():
        export.export(flows, folder, fmt)
    count = lambda df, fmt, total: df.agg(F.lit(fmt).alias("format"), F.count("*").alias("n"), total.alias("octets"))
    octets = F.sum("octets").cast("long")
    return (
        count(spark.read.schema("octets long").json(folders["json"]), "json", octets)
        .union(count(spark.read.option("header", True).csv(folders["csv"]).select(F.col("octets").cast("long")), "csv", octets))
        .union(count(spark.read.text(folders["text"]).where("value like '% proto=%'"), "text", F.lit(None).cast("long")))
    )


NATIONS = "SELECT n_nationkey, n_name FROM nation"


@query(f"""WITH n AS ({NATIONS}), w AS (SELECT greatest(3, max(length(CAST(n_nationkey AS VARCHAR)))) AS a, greatest(4, max(length(n_name))) AS b FROM n)
  SELECT CAST(0 AS BIGINT) AS line, lpad('key', CAST(a AS INTEGER), ' ') || '  ' || rpad('name', CAST(b AS INTEGER), ' ') AS text FROM w
  UNION ALL SELECT 1, repeat('-', CAST(a AS INTEGER)) || '  ' || repeat('-', CAST(b AS INTEGER)) FROM w
  UNION ALL SELECT 2 + row_number() OVER (ORDER BY n_nationkey) - 1, lpad(CAST(n_nationkey AS VARCHAR), CAST(a AS INTEGER), ' ') || '  ' || rpad(n_name, CAST(b AS INTEGER), ' ') FROM n, w""")
def x_table(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 rows
    text = report.table(["key", "name"], [tuple(r) for r in rows], right=(0,))
    return spark.createDataFrame([(n, line) for n, line in enumerate(text.splitlines())], "line long, text string")


@query(f"""WITH t AS (SELECT count(*) AS scanned, count(*) FILTER (proto = 6) AS matched, CAST(sum(octets) FILTER (proto = 6) AS BIGINT) AS octets FROM ({FLOWS}))
  SELECT unnest(['3 flow(s) shown of ' || matched || ' matched (' || scanned || ' scanned)', '  count = ' || matched, '  sum_octets = ' || octets]) AS text FROM t""")
def x_flow_report(spark: SparkSession, d: str) -> DataFrame:
    """The lines under a report's table."""
    text = report.flows(FlowQuery().where("proto == 6").limit(3).aggregate("count", "sum_octets").run(flow_table(spark, d)))
    return spark.createDataFrame([(line,) for line in text.splitlines()[6:]], "text string")


@query(f"SELECT 'flows observed : ' || count(*) AS text FROM ({FLOWS}) UNION ALL (SELECT '  ' || rpad(concat_ws('.', (src >> 24) & 255, (src >> 16) & 255, (src >> 8) & 255, src & 255), 15, ' ') || ' ' || CAST(sum(octets) AS BIGINT) FROM ({FLOWS}) GROUP BY src ORDER BY sum(octets) DESC, src LIMIT 5)")
def x_summary_report(spark: SparkSession, d: str) -> DataFrame:
    """How many flows there were, and the top sources; what stands between has queries of its own."""
    lines = report.flow_summary(flow_table(spark, d)).splitlines()
    return spark.createDataFrame([(line,) for line in [lines[0], *lines[lines.index("top sources:") + 1 :]]], "text string")


@query("SELECT 'first' AS sink, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events UNION ALL SELECT 'second', count(*), NULL FROM events")
def x_tee(spark: SparkSession, d: str) -> DataFrame:
    """A stream of the events in two sinks: the rows, and their numbers by batch."""
    rows, counts, log = (new_folder(spark, x) for x in ("rows", "counts", "log"))
    source = spark.readStream.schema(read_table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    first = lambda batch, n: batch.write.mode("append").parquet(rows)
    second = lambda batch, n: batch.groupBy().count().write.mode("append").parquet(counts)
    tee(source, first, second).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.parquet(rows).agg(F.lit("first").alias("sink"), F.count("*").alias("n"), F.sum("event_id").cast("long").alias("total"))
    return kept.union(spark.read.parquet(counts).agg(F.lit("second"), F.sum("count"), F.lit(None).cast("long")))


@query(f"SELECT 'messages=' || (count(*) + 2 * count(DISTINCT src)) || ' schemas=0 errors=0' AS text FROM ({FLOW_EVENTS})")
def x_validate(spark: SparkSession, d: str) -> DataFrame:
    """What the command line prints of a folder of captures."""
    from ..cli import validated

    return validated(datasources.read_captures(spark, _captures(spark, d)))
