"""Flow accumulation, filters, queries, pairing, joins over flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import analytics, flows, joins
from ..plans.filter_lang import compile_filter, flow_columns
from ..plans.query import FlowQuery
from ..session import read_table
from . import query
from .views import CONV_EVENTS, FLOW_EVENTS, FLOWS, METRIC_EVENTS, conv_events, flow_events, metric_events


def flow_table(spark: SparkSession, d: str) -> DataFrame:
    return flows.accumulate(flow_events(spark, d))


KEY = "src, dst, flow_id, sport, dport, proto"


@query(f"SELECT {KEY}, octets, packets, records, first_ms, last_ms, ord FROM ({FLOWS}) WHERE octets > 50000 AND proto = 6 ORDER BY octets DESC, ord DESC LIMIT 10")
def q_flagship_slice(spark: SparkSession, d: str) -> DataFrame:
    """Accumulate, filter, sort, limit."""
    return FlowQuery().where("octets > 50000 and proto == 6").limit(10).run(flow_table(spark, d)).rows


@query(f"SELECT * FROM ({FLOWS})")
def l_accumulate(spark: SparkSession, d: str) -> DataFrame:
    return flow_table(spark, d)


@query(f"SELECT count(*) AS count, CAST(sum(octets) AS BIGINT) AS sum_octets, CAST(sum(packets) AS BIGINT) AS sum_packets, max(octets) AS max_octets, min(octets) AS min_octets, count(DISTINCT src) AS distinct_sources FROM ({FLOWS}) WHERE proto = 17 OR dport IN (80, 443)")
def q_aggregates(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("count", "sum_octets", "sum_packets", "max_octets", "min_octets", "distinct_sources")
    return FlowQuery().where("proto == 17 or dport in [80, 443]").aggregate(*kinds).run(flow_table(spark, d)).aggregates


@query(f"SELECT CAST(0 AS BIGINT) + count(*) AS count, coalesce(max(octets), 0) AS max_octets, coalesce(min(octets), 0) AS min_octets FROM ({FLOWS}) WHERE octets < 0")
def q_aggregates_empty(spark: SparkSession, d: str) -> DataFrame:
    return FlowQuery().where("octets > 0 and octets < 1").aggregate("count", "max_octets", "min_octets").run(flow_table(spark, d)).aggregates


@query(f"SELECT count(*) AS scanned, count(*) FILTER (octets > 50000) AS total_matched FROM ({FLOWS})")
def q_counts(spark: SparkSession, d: str) -> DataFrame:
    return FlowQuery().where("octets > 50000").run(flow_table(spark, d)).counts


@query(f"SELECT {KEY}, greatest(last_ms - first_ms, 0) AS duration FROM ({FLOWS}) ORDER BY duration, ord LIMIT 50")
def q_sort_duration(spark: SparkSession, d: str) -> DataFrame:
    rows = FlowQuery().order_by("duration").limit(50).run(flow_table(spark, d)).rows
    return rows.select(*KEY.split(", "), F.greatest(F.col("last_ms") - F.col("first_ms"), F.lit(0)).alias("duration"))


@query(f"SELECT {KEY}, records FROM ({FLOWS}) ORDER BY records DESC, ord DESC LIMIT 25")
def q_descending_ties(spark: SparkSession, d: str) -> DataFrame:
    return FlowQuery().order_by("records", descending=True).limit(25).select(*KEY.split(", "), "records").run(flow_table(spark, d)).rows


@query(f"SELECT {KEY}, packets FROM ({FLOWS}) ORDER BY packets, ord LIMIT 25")
def q_ascending_packets(spark: SparkSession, d: str) -> DataFrame:
    return FlowQuery().order_by("packets").limit(25).select(*KEY.split(", "), "packets").run(flow_table(spark, d)).rows


@query(f"SELECT {KEY}, octets FROM ({FLOWS}) ORDER BY octets DESC, ord LIMIT 20")
def q_heaviest(spark: SparkSession, d: str) -> DataFrame:
    return flow_table(spark, d).orderBy(F.desc("octets"), "ord").limit(20).select(*KEY.split(", "), "octets")


@query(f"SELECT {KEY}, octets FROM ({FLOWS}) WHERE flow_id = 3 ORDER BY ord LIMIT 1")
def q_find_flow(spark: SparkSession, d: str) -> DataFrame:
    return flow_table(spark, d).where("flow_id = 3").orderBy("ord").limit(1).select(*KEY.split(", "), "octets")


@query(f"SELECT count(*) AS n, CAST(sum(octets) AS BIGINT) AS total FROM ({FLOWS}) WHERE last_ms <= 9000000")
def q_idle_before(spark: SparkSession, d: str) -> DataFrame:
    return flow_table(spark, d).where("last_ms <= 9000000").agg(F.count("*").alias("n"), F.sum("octets").alias("total"))


@query(f"SELECT {KEY} FROM ({FLOWS}) WHERE (octets >= 20000 AND octets < 60000) AND NOT (proto = 1 OR dport = 22)")
def f_boolean(spark: SparkSession, d: str) -> DataFrame:
    t = flow_table(spark, d)
    return t.where(compile_filter("octets >= 0x4e20 and octets < 60000 and not (proto = 1 or dport == 22)", t, flow_columns(t))).select(*KEY.split(", "))


@query("SELECT count(*) AS n FROM documents WHERE lang IN ('en', 'de') AND NOT contains(coalesce(text, ''), 'er') OR source = 'src3'")
def f_strings(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "documents")
    return t.where(compile_filter("lang in ['en', 'de'] and ! text contains 'er' or source == \"src3\"", t)).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) FILTER (false) AS missing_equal, count(*) FILTER (true) AS not_missing, count(*) FILTER (false) AS missing_differs FROM ({FLOWS})")
def f_missing_fields(spark: SparkSession, d: str) -> DataFrame:
    t = flow_table(spark, d)
    on = lambda text: F.count_if(compile_filter(text, t, flow_columns(t)))
    return t.agg(on("nosuch == 1").alias("missing_equal"), on("not nosuch == 1").alias("not_missing"), on("nosuch != 1").alias("missing_differs"))


@query(f"SELECT count(*) AS n FROM ({FLOWS}) WHERE octets >= 29537 AND octets < 9223372036854775807")
def f_mixed_types(spark: SparkSession, d: str) -> DataFrame:
    """A number against a string compares its eight bytes; all but the last two of 29537 ('sa') are zero."""
    t = flow_table(spark, d)
    image = "\x00\x00\x00\x00\x00\x00sa"
    return t.where(compile_filter(f"octets >= '{image}'", t, flow_columns(t))).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER ((addr >> 24) = 10) AS in8, count(*) FILTER ((addr >> 16) = 2561) AS in16, count(*) AS all_in FROM (SELECT 167772160 + (l_partkey * 977) % 16777216 + (l_suppkey % 3) * 16777216 AS addr FROM lineitem)")
def f_cidr(spark: SparkSession, d: str) -> DataFrame:
    a = addresses(spark, d)
    on = lambda p: F.count_if(C.in_cidr(F.col("addr"), p))
    return a.agg(on("10.0.0.0/8").alias("in8"), on("10.1.77.3/16").alias("in16"), on("0.0.0.0/0").alias("all_in"))


def addresses(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select((F.lit(167772160) + (F.col("l_partkey") * 977) % 16777216 + (F.col("l_suppkey") % 3) * 16777216).alias("addr"), "l_orderkey", "l_linenumber")


@query(f"SELECT count(*) FILTER (dport IN (80, 443) OR sport BETWEEN 1025 AND 1030) AS n FROM ({FLOWS})")
def f_ports(spark: SparkSession, d: str) -> DataFrame:
    return flow_table(spark, d).agg(F.count_if(C.in_ports(F.col("dport"), "443, 80") | C.in_ports(F.col("sport"), "1030-1025")).alias("n"))


@query(f"SELECT count(*) AS n FROM ({FLOWS}) WHERE least(octets, 20000) > 15000 AND gcd(octets, 12) = 4")
def f_builtin_calls(spark: SparkSession, d: str) -> DataFrame:
    t = flow_table(spark, d)
    return t.where(compile_filter("min(octets, 20000) > 15000 and gcd(octets, 12) == 4", t, flow_columns(t), calls=True)).agg(F.count("*").alias("n"))


@query(
    """SELECT l_orderkey, l_linenumber, least(a, b) AS lo, greatest(a, b) AS hi, least(greatest(a, 10), 500) AS clamped, abs(m) AS magnitude, CAST(sign(m) AS BIGINT) AS sgn,
    CAST(bit_count(m) AS BIGINT) AS ones, CAST(64 - CASE WHEN a = 0 THEN 0 ELSE length(bin(a)) END AS BIGINT) AS zeros, gcd(a, b) AS divisor,
    CASE WHEN z = 0 THEN 0 ELSE (m + z - 1) // z END AS ceiling, CASE WHEN z <> 0 THEN a ELSE b END AS chosen
    FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey AS a, l_suppkey AS b, l_partkey - 500 AS m, l_suppkey % 4 AS z FROM lineitem)"""
)
def b_scalars(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_partkey") - 500).alias("m"), (F.col("l_suppkey") % 4).alias("z"))
    a, b, m, z = (F.col(c) for c in "abmz")
    lit = lambda x: F.lit(x).cast("long")
    call = C.builtin
    return t.select(
        "l_orderkey", "l_linenumber", call("min", a, b).alias("lo"), call("max", a, b).alias("hi"), call("clamp", a, lit(10), lit(500)).alias("clamped"), call("abs", m).alias("magnitude"), call("sign", m).alias("sgn"),
        call("popcount", m).alias("ones"), call("leading_zeros", a).alias("zeros"), call("gcd", a, b).alias("divisor"), call("ceil_div", m, z).alias("ceiling"), call("select", z, a, b).alias("chosen"),
    )


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN -9223372036854775807 - 1 + l_partkey ELSE l_partkey END AS wrapped FROM lineitem")
def b_wrap_add(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "lineitem")
    x = F.when(F.col("l_partkey") % 2 == 0, F.lit((1 << 63) - 1)).otherwise(F.lit(-1)).cast("long")
    return t.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), C.wrap_add(x, F.col("l_partkey") + 1).alias("wrapped"))


@query(
    f"""SELECT a, b, aport, bport, proto, fwd_octets, rev_octets, fwd_packets, rev_packets, fwd_octets + rev_octets AS total_octets,
    CASE WHEN rev_octets = 0 THEN CAST('inf' AS DOUBLE) ELSE CAST(fwd_octets AS DOUBLE) / rev_octets END AS ratio FROM (
    SELECT CASE WHEN fwd THEN src ELSE dst END AS a, CASE WHEN fwd THEN dst ELSE src END AS b, CASE WHEN fwd THEN sport ELSE dport END AS aport, CASE WHEN fwd THEN dport ELSE sport END AS bport, proto,
      CAST(coalesce(sum(octets) FILTER (fwd), 0) AS BIGINT) AS fwd_octets, CAST(coalesce(sum(octets) FILTER (NOT fwd), 0) AS BIGINT) AS rev_octets,
      CAST(coalesce(sum(packets) FILTER (fwd), 0) AS BIGINT) AS fwd_packets, CAST(coalesce(sum(packets) FILTER (NOT fwd), 0) AS BIGINT) AS rev_packets
    FROM (SELECT *, src < dst OR src = dst AND sport <= dport AS fwd FROM ({CONV_EVENTS})) GROUP BY 1, 2, 3, 4, 5)"""
)
def j_biflow(spark: SparkSession, d: str) -> DataFrame:
    return flows.biflows(conv_events(spark, d))


@query(f"SELECT CASE WHEN src < dst OR src = dst AND sport <= dport THEN 'forward' ELSE 'reverse' END AS direction, dport < sport AS server_is_dst, count(*) AS n FROM ({FLOWS}) GROUP BY 1, 2")
def j_direction(spark: SparkSession, d: str) -> DataFrame:
    return flows.direction(flow_table(spark, d)).groupBy("direction", "server_is_dst").agg(F.count("*").alias("n"))


@query(
    f"""WITH e AS ({FLOW_EVENTS}), s AS (
      SELECT src, dst, flow_id, sum(octets) o, sum(packets) p, count(*) r, max(ts_ms) l, min(ord) ord, ord % 200 < 100 AS side FROM e GROUP BY src, dst, flow_id, side)
    SELECT src, dst, flow_id, CAST(sum(o) AS BIGINT) AS octets, CAST(sum(p) AS BIGINT) AS packets, CAST(sum(r) AS BIGINT) AS records, max(l) AS last_ms, arg_min(ord, CASE WHEN side THEN 0 ELSE 1 END) AS first_ord FROM s GROUP BY src, dst, flow_id"""
)
def j_snapshot_merge(spark: SparkSession, d: str) -> DataFrame:
    e = flow_events(spark, d)
    part = lambda side: e.where(side).groupBy("src", "dst", "flow_id").agg(F.sum("octets").alias("octets"), F.sum("packets").alias("packets"), F.count("*").alias("records"), F.max("ts_ms").alias("last_ms"), F.min("ord").alias("ord")).withColumn("first_ord", F.col("ord"))
    return flows.merge_snapshots(part(F.col("ord") % 200 < 100), part(F.col("ord") % 200 >= 100)).select("src", "dst", "flow_id", "octets", "packets", "records", "last_ms", "first_ord")


PREFIXES = ("0.0.0.0/0", "10.0.0.0/8", "10.128.0.0/9", "11.0.0.0/8", "11.64.0.0/10", "10.1.0.0/16")


@query(
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN addr >> 16 = 2561 THEN '10.1.0.0/16' WHEN addr >> 22 = 45 THEN '11.64.0.0/10' WHEN addr >> 23 = 21 THEN '10.128.0.0/9'
    WHEN addr >> 24 = 10 THEN '10.0.0.0/8' WHEN addr >> 24 = 11 THEN '11.0.0.0/8' ELSE '0.0.0.0/0' END AS label
    FROM (SELECT l_orderkey, l_linenumber, 167772160 + (l_partkey * 977) % 16777216 + (l_suppkey % 3) * 16777216 AS addr FROM lineitem)"""
)
def j_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    prefixes = spark.createDataFrame(joins.prefix_rows(PREFIXES), "base long, prefix_len int, label string")
    return joins.longest_prefix(addresses(spark, d), "addr", prefixes).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "label")


@query("SELECT (SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1 UNION SELECT l_partkey FROM lineitem WHERE l_linenumber = 2)) AS in_either, (SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_linenumber = 2)) AS in_both")
def j_bitset(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "lineitem")
    a, b = (t.where(F.col("l_linenumber") == n).select("l_partkey") for n in (1, 2))
    return joins.bitset_union(a, b).agg(F.count("*").alias("in_either")).crossJoin(joins.bitset_intersect(a, b).agg(F.count("*").alias("in_both")))  # two single rows


SPANS = "SELECT l_suppkey AS key, (l_partkey * 7) % 20000 AS s, (l_partkey * 7) % 20000 + CAST(l_quantity AS BIGINT) AS e FROM lineitem"


def spans(spark: SparkSession, d: str) -> DataFrame:
    s = (F.col("l_partkey") * 7) % 20000
    return read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), s.alias("start"), (s + F.col("l_quantity").cast("long")).alias("end"))


ISLANDS = f"""SELECT key, min(s) AS "start", max(e) AS "end" FROM (
  SELECT *, sum(new) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM ({SPANS})))
  GROUP BY key, island"""


@query(ISLANDS)
def j_islands(spark: SparkSession, d: str) -> DataFrame:
    return joins.islands(spans(spark, d), ["key"], "start", "end")


@query(f'SELECT key, CAST(sum("end" - "start") AS BIGINT) AS covered, coalesce(max("end") FILTER ("start" = 0), 0) AS prefix FROM ({ISLANDS}) GROUP BY key')
def j_coverage(spark: SparkSession, d: str) -> DataFrame:
    return joins.coverage(joins.islands(spans(spark, d), ["key"], "start", "end"), ["key"])


@query(
    f"""WITH i AS ({ISLANDS}), m AS (SELECT *, lag("end", 1, 0) OVER (PARTITION BY key ORDER BY "start") AS p, lead("start") OVER (PARTITION BY key ORDER BY "start") IS NULL AS last FROM i),
    g AS (SELECT key, p AS a, least("start", 15000) AS b FROM m UNION ALL SELECT key, "end", 15000 FROM m WHERE last)
    SELECT key, count(*) AS holes, CAST(sum(b - a) AS BIGINT) AS missing FROM g WHERE b > a GROUP BY key"""
)
def j_gaps(spark: SparkSession, d: str) -> DataFrame:
    found = joins.gaps(joins.islands(spans(spark, d), ["key"], "start", "end"), ["key"], 15000)
    return found.groupBy("key").agg(F.count("*").alias("holes"), F.sum("length").alias("missing"))


@query(
    f"""SELECT CASE WHEN greatest(s, 5000) >= least(e, 5040) THEN 'take_new' WHEN even THEN CASE WHEN e > 5040 THEN 'take_tail' ELSE 'keep_old' END ELSE 'conflict' END AS decision, count(*) AS n
    FROM (SELECT *, key % 2 = 0 AS even FROM ({SPANS})) GROUP BY 1"""
)
def j_overlap_policy(spark: SparkSession, d: str) -> DataFrame:
    lit = lambda x: F.lit(x).cast("long")
    decision = joins.overlap_decision("strict", lit(5000), lit(5040), F.col("start"), F.col("end"), F.col("key") % 2 == 0)
    return spans(spark, d).groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))


@query(f"SELECT name, row_number() OVER (ORDER BY first) - 1 AS id FROM (SELECT CAST(src AS VARCHAR) AS name, min(ord) AS first FROM ({FLOW_EVENTS}) GROUP BY 1)")
def j_intern(spark: SparkSession, d: str) -> DataFrame:
    return joins.intern(flow_events(spark, d).select(F.col("src").cast("string").alias("name"), "ord"), "name", "ord")


@query(f"SELECT src, count(*) AS n, arg_max(octets, ord) AS octets FROM ({FLOW_EVENTS}) GROUP BY src HAVING arg_max(octets, ord) BETWEEN 20000 AND 40000")
def q_index_range(spark: SparkSession, d: str) -> DataFrame:
    e = flow_events(spark, d)
    index = joins.latest_by_key(e, "src", "octets", "ord")
    return joins.value_range(index, "octets", 20000, 40000).join(e.groupBy("src").agg(F.count("*").alias("n")), "src").select("src", "n", "octets")


@query(
    """SELECT id, CASE WHEN generation > 0 THEN def END AS def, CASE WHEN generation > 0 THEN generation END AS generation FROM (
      SELECT o_orderkey AS id, is_def, max(CASE WHEN is_def THEN o_orderkey END) OVER w AS def, count(*) FILTER (is_def) OVER w AS generation
      FROM (SELECT o_orderkey, o_custkey % 50 AS k, o_orderkey % 16 = 0 AS is_def FROM orders)
      WINDOW w AS (PARTITION BY k ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)) WHERE NOT is_def"""
)
def j_template_asof(spark: SparkSession, d: str) -> DataFrame:
    """Orders resolved to the latest earlier definition of their customer group."""
    t = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("k"), F.col("o_orderkey").alias("clock"))
    is_def = F.col("id") % 16 == 0
    defs = t.where(is_def).select("k", "clock", F.col("id").alias("def"))
    return joins.as_of(t.where(~is_def), defs, ["k"], "clock", ["def"]).select("id", "def", "generation")


def _fnv(x: str) -> str:
    """FNV-1a of a number's four bytes, most significant first, as an unsigned 64-bit number."""
    out = "14695981039346656037::HUGEINT"
    for shift in (24, 16, 8, 0):
        out = f"(xor({out}, CAST(({x} >> {shift}) & 255 AS HUGEINT)) * 1099511628211 % 18446744073709551616::HUGEINT)"
    return out


@query(f"""WITH h AS (SELECT {KEY}, {_fnv('src')} AS a, {_fnv('dst')} AS b, CAST(flow_id AS HUGEINT) * 11400714819323198485::HUGEINT % 18446744073709551616::HUGEINT AS c FROM ({FLOWS})),
  x AS (SELECT {KEY}, xor(xor(xor(a, (b * 131072) % 18446744073709551616::HUGEINT + b // 140737488355328), c), CAST((sport << 16) + dport AS HUGEINT)) AS d FROM h),
  y AS (SELECT {KEY}, xor(d, CAST(proto AS HUGEINT) * 281474976710656) AS d FROM x)
  SELECT {KEY}, CAST(CASE WHEN d >= 9223372036854775808::HUGEINT THEN d - 18446744073709551616::HUGEINT ELSE d END AS BIGINT) AS digest FROM y""")
def j_flow_digest(spark: SparkSession, d: str) -> DataFrame:
    t = flow_table(spark, d)
    return t.select(*KEY.split(", "), C.flow_digest(*[F.col(c) for c in KEY.split(", ")]).alias("digest"))


@query(
    f"""SELECT {KEY}, arg_max(t, ord) AS template_id, arg_max(g, ord) AS template_gen, bool_or(changed) AS layout_changed FROM (
      SELECT *, min(g) OVER (PARTITION BY {KEY}, t) <> max(g) OVER (PARTITION BY {KEY}, t) AS changed FROM (
        SELECT *, 256 + ord % 3 AS t, 1 + (ord // 3) % 2 AS g FROM ({FLOW_EVENTS}))) GROUP BY {KEY}"""
)
def l_bindings(spark: SparkSession, d: str) -> DataFrame:
    e = flow_events(spark, d)
    bound = e.withColumn("template_id", 256 + F.col("ord") % 3).withColumn("template_gen", 1 + C.div(F.col("ord"), F.lit(3).cast("long")) % 2)
    return flows.bindings(bound)


IDLE = f"""SELECT dst, {KEY.replace('dst, ', '')}, incarnation, CAST(sum(octets) AS BIGINT) AS octets, count(*) AS records FROM (
  SELECT *, CAST(sum(gone) OVER (PARTITION BY {KEY} ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS incarnation FROM (
    SELECT *, CASE WHEN lag(ord) OVER (PARTITION BY dst ORDER BY ord) >= lag(ord) OVER (PARTITION BY {KEY} ORDER BY ord) + 50000000000 THEN 1 ELSE 0 END AS gone FROM ({FLOW_EVENTS}))) GROUP BY ALL"""


@query(IDLE)
def l_idle_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Destinations as sessions, arrival places as ticks."""
    e = flow_events(spark, d).withColumn("session", F.col("dst")).withColumn("clock", F.col("ord"))
    found = flows.idle_sessions(e, 50_000_000_000)
    return found.groupBy("dst", *[c for c in KEY.split(", ") if c != "dst"], "incarnation").agg(F.sum("octets").alias("octets"), F.count("*").alias("records"))


@query(f"SELECT CASE WHEN records >= 12 THEN 'record_cap' WHEN 10000000 - last_ms >= 700000 THEN 'idle' WHEN 10000000 - first_ms >= 900000 THEN 'active' ELSE 'none' END AS reason, count(*) AS n FROM ({FLOWS}) GROUP BY 1")
def l_expiry_policy(spark: SparkSession, d: str) -> DataFrame:
    reason = flows.expiry(F.lit(10_000_000), idle=700_000, active=900_000, cap=12)
    return flow_table(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT {KEY}, duration_ms, bps, pps, mean_packet, CASE WHEN duration_ms = 0 THEN 100 ELSE least(100, (bps // greatest(records, 1)) // 1024) END AS burstiness, bps >= 1000000 AS elephant FROM (
      SELECT *, CAST(floor(octets * 8 / (greatest(duration_ms, 1) / 1000.0::DOUBLE)) AS BIGINT) AS bps, CAST(floor(packets / (greatest(duration_ms, 1) / 1000.0::DOUBLE)) AS BIGINT) AS pps,
        CASE WHEN packets = 0 THEN 0 ELSE octets // packets END AS mean_packet FROM (SELECT *, greatest(last_ms - first_ms, 0) AS duration_ms FROM ({FLOWS})))"""
)
def l_flow_stats(spark: SparkSession, d: str) -> DataFrame:
    return flows.stats(flow_table(spark, d)).select(*KEY.split(", "), "duration_ms", "bps", "pps", "mean_packet", "burstiness", "elephant")


@query(f"SELECT src, count(*) FILTER (held > 100000) AS denied, max(held) AS peak FROM (SELECT src, CAST(sum(amount) OVER (PARTITION BY src ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS held FROM (SELECT src, ord, CASE WHEN ord % 3 = 0 THEN -octets ELSE octets END AS amount FROM ({FLOW_EVENTS}))) GROUP BY src")
def l_quotas(spark: SparkSession, d: str) -> DataFrame:
    e = flow_events(spark, d).withColumn("amount", F.when(F.col("ord") % 3 == 0, -F.col("octets")).otherwise(F.col("octets")))
    return flows.quota_denials(e, 100_000, "src", "amount").groupBy("src").agg(F.count_if("over").alias("denied"), F.max("held").alias("peak"))


LOG2 = "CASE WHEN {x} = 0 THEN 0 ELSE length(bin({x})) - 1 END"


@query(f"SELECT CAST({LOG2.format(x='octets')} AS BIGINT) AS bucket, count(*) AS n FROM ({FLOWS}) GROUP BY 1")
def a_histogram(spark: SparkSession, d: str) -> DataFrame:
    return analytics.histogram(flow_table(spark, d), "octets").select(F.col("bucket").cast("long").alias("bucket"), "n")


PERCENTILES = [0.0, 0.5, 0.9, 0.99, 1.0]


@query(
    f"""WITH h AS (SELECT b.i AS bucket, count(f.octets) AS n FROM (SELECT unnest(range(64)) AS i) b LEFT JOIN (SELECT *, {LOG2.format(x='octets')} AS k FROM ({FLOWS})) f ON f.k = b.i GROUP BY 1),
    c AS (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS reached, sum(n) OVER () AS total FROM h)
    SELECT p, CAST(power(2, min(bucket)) AS BIGINT) AS value FROM c, (SELECT unnest([0.0::DOUBLE, 0.5, 0.9, 0.99, 1.0]) AS p) WHERE reached >= ceil(p * total) GROUP BY p"""
)
def a_percentile(spark: SparkSession, d: str) -> DataFrame:
    return analytics.percentiles(analytics.histogram(flow_table(spark, d), "octets"), PERCENTILES)


@query(f"SELECT src AS key, CAST(sum(octets) AS BIGINT) AS weight FROM ({FLOWS}) GROUP BY src ORDER BY weight DESC, key LIMIT 16")
def a_top_n(spark: SparkSession, d: str) -> DataFrame:
    return analytics.top_n(flow_table(spark, d), "src", "octets", 16)



@query(
    f"""WITH b AS (SELECT CASE WHEN packets = 0 THEN 0 WHEN packets >= 13 THEN 127 ELSE CAST(floor(ln(packets) / ln(1.02::DOUBLE)) AS BIGINT) END AS i, packets FROM ({FLOWS})),
    c AS (SELECT i, count(*) AS n, min(packets) AS lo, max(packets) AS hi FROM b GROUP BY i),
    r AS (SELECT i, sum(n) OVER (ORDER BY i) AS reached, sum(n) OVER () AS total, min(lo) OVER () AS lo, max(hi) OVER () AS hi FROM c)
    SELECT q, least(greatest(CASE WHEN min(i) = 0 THEN 0 ELSE CAST(floor(power(1.02::DOUBLE, min(i))) AS BIGINT) END, min(lo)), min(hi)) AS value
    FROM r, (SELECT unnest([0.05::DOUBLE, 0.1, 0.25, 0.5, 0.99]) AS q) WHERE reached > floor(q * (total - 1) + 0.5) GROUP BY q"""
)
def a_compat_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return analytics.compat_quantiles(flow_table(spark, d), "packets", [0.05, 0.1, 0.25, 0.5, 0.99])



@query(f"SELECT 'source' AS side, * FROM (SELECT src AS key, CAST(sum(octets) AS BIGINT) AS weight FROM ({FLOWS}) GROUP BY 1 ORDER BY weight DESC, key LIMIT 5) UNION ALL SELECT 'destination', * FROM (SELECT dst AS key, CAST(sum(octets) AS BIGINT) AS weight FROM ({FLOWS}) GROUP BY 1 ORDER BY weight DESC, key LIMIT 5)")
def a_summary(spark: SparkSession, d: str) -> DataFrame:
    found = analytics.summary(flow_table(spark, d), 5)
    side = lambda name, label: found[name].select(F.lit(label).alias("side"), "key", "weight")
    return side("top_sources", "source").union(side("top_destinations", "destination"))


@query(f"SELECT name, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, arg_max(v, event_id) AS last, CAST(sum(v) AS DOUBLE) / count(*) AS mean FROM ({METRIC_EVENTS}) GROUP BY name")
def a_meters(spark: SparkSession, d: str) -> DataFrame:
    return analytics.meters(metric_events(spark, d), "name", "v", "event_id")


@query(
    f"""WITH e AS (SELECT name, event_id, v, CASE WHEN event_id % 50 = 0 THEN 'set' ELSE 'add' END AS kind FROM ({METRIC_EVENTS})),
    s AS (SELECT name, max(event_id) AS at, arg_max(v, event_id) AS v FROM e WHERE kind = 'set' GROUP BY name)
    SELECT e.name, CAST(coalesce(max(s.v), 0) + coalesce(sum(e.v) FILTER (kind = 'add' AND (s.at IS NULL OR event_id > s.at)), 0) AS BIGINT) AS gauge FROM e LEFT JOIN s USING (name) GROUP BY e.name"""
)
def a_gauges(spark: SparkSession, d: str) -> DataFrame:
    e = metric_events(spark, d).withColumn("kind", F.when(F.col("event_id") % 50 == 0, "set").otherwise("add"))
    return analytics.gauges(e, "name", "kind", "v", "event_id")


@query(f"SELECT octets % 64 AS slot, count(*) AS n FROM ({FLOW_EVENTS}) GROUP BY 1")
def a_tallies(spark: SparkSession, d: str) -> DataFrame:
    return analytics.tallies(flow_events(spark, d), "octets")


@query(f"SELECT src, ord, octets FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ord DESC) AS r FROM ({FLOW_EVENTS})) WHERE r <= 8")
def r_latest(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.reassembly import latest

    return latest(flow_events(spark, d).select("src", "ord", "octets"), ["src"], "ord", 8)


@query(f"SELECT src, id, generation FROM (SELECT src, ord AS id, kind, count(*) FILTER (kind = 'open') OVER (PARTITION BY src ORDER BY ord ROWS UNBOUNDED PRECEDING) AS generation FROM (SELECT src, ord, CASE WHEN ord % 5 = 0 THEN 'open' ELSE 'use' END AS kind FROM ({FLOW_EVENTS})))")
def c_handles(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.sessions import handles

    e = flow_events(spark, d).withColumn("kind", F.when(F.col("ord") % 5 == 0, "open").otherwise("use"))
    return handles(e, "src", "ord").select("src", F.col("ord").alias("id"), "generation")


CONN = f"SELECT dst AS s, src AS conn, ord, CASE WHEN ord % 41 = 0 THEN 'process' WHEN ord % 11 = 0 THEN 'open' WHEN ord % 13 = 0 THEN 'reset' ELSE 'request' END AS kind FROM ({FLOW_EVENTS})"


@query(
    f"""SELECT s, outcome, count(*) AS n FROM (SELECT s, kind, CASE WHEN o IS NULL THEN 'unresolved' WHEN p IS NULL THEN 'waiting' WHEN r < p THEN 'dropped' ELSE 'served' END AS outcome FROM (
      SELECT *, min(CASE WHEN kind = 'process' THEN ord END) OVER (PARTITION BY s ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS p,
        min(CASE WHEN kind = 'reset' THEN ord END) OVER (PARTITION BY s, conn ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r,
        max(CASE WHEN kind = 'open' THEN 1 END) OVER (PARTITION BY s, conn ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM ({CONN}))) WHERE kind = 'request' GROUP BY s, outcome"""
)
def c_requests(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.sessions import served_requests

    o = F.col("ord")
    kind = F.when(o % 41 == 0, "process").when(o % 11 == 0, "open").when(o % 13 == 0, "reset").otherwise("request")
    e = flow_events(spark, d).select(F.col("dst").alias("s"), F.col("src").alias("conn"), "ord", kind.alias("kind"))
    return served_requests(e, "s", "ord").groupBy("s", "outcome").agg(F.count("*").alias("n"))


@query(
    """SELECT n_name AS nation, c_mktsegment AS segment, grouping(n_name) + grouping(c_mktsegment) AS level, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)"""
)
def s_rollup_join(spark: SparkSession, d: str) -> DataFrame:
    """Joins and rollups, which come with Spark; the dimension is left to be broadcast by its size."""
    o, c, n = (read_table(spark, d, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.rollup("n_name", "c_mktsegment").agg((F.grouping("n_name") + F.grouping("c_mktsegment")).cast("long").alias("level"), F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents")).select(F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"), "level", "orders", "cents")


@query(f"SELECT {KEY}, octets, row_number() OVER (PARTITION BY src ORDER BY octets DESC, ord) AS rank FROM ({FLOWS}) QUALIFY rank <= 3")
def q_top_per_source(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("src").orderBy(F.desc("octets"), "ord")
    return flow_table(spark, d).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select(*KEY.split(", "), "octets", "rank")
