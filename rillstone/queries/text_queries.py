"""Codecs, checksums, text forms, exports and transforms over documents and flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import export, transform
from ..functions import bytes as B
from ..functions import columns as C
from ..operators import analytics
from ..session import read_table
from . import query
from .flow_queries import flow_table
from .views import FLOW_EVENTS, FLOWS, flow_events


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


WHOLE = "SELECT doc_id, md5(coalesce(text, '')) AS digest, octet_length(encode(coalesce(text, ''))) AS size FROM documents"


def _round_trip(spark: SparkSession, d: str, codec: int, entries: tuple[bytes, ...] = ()) -> DataFrame:
    """Encode and decode every text; the digest shows that nothing is lost."""
    packed = documents(spark, d).select("doc_id", C.deflate(codec, entries)(F.col("text").cast("binary")).alias("packed"))
    back = packed.select("doc_id", C.inflate(codec, 1 << 26, entries)("packed").alias("back"))
    return back.select("doc_id", F.md5("back").alias("digest"), F.length("back").cast("long").alias("size"))


@query(WHOLE)
def k_rle(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, B.CODEC_RLE)


@query(WHOLE)
def k_huffman(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, B.CODEC_HUFFMAN)


@query(WHOLE)
def k_lz(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, B.CODEC_LZ)


@query(WHOLE)
def k_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return _round_trip(spark, d, B.CODEC_DICT, (b"the ", b"tion", b"er", b"en", b"\n"))


@query(WHOLE)
def k_frame(spark: SparkSession, d: str) -> DataFrame:
    """Container frames with a checksum, and the pass-through codec inside."""
    framed = documents(spark, d).select("doc_id", C.wrap_frame(B.CODEC_RLE)(F.col("text").cast("binary")).alias("f"))
    back = framed.select("doc_id", C.unwrap_frame(1 << 26)("f").alias("back"))
    return back.select("doc_id", F.md5("back").alias("digest"), F.length("back").cast("long").alias("size"))


@query(f"SELECT src, count(*) AS n, CAST(sum(octets) AS BIGINT) AS total, CAST(max(octets) AS BIGINT) AS high FROM ({FLOW_EVENTS}) GROUP BY src")
def k_delta_column(spark: SparkSession, d: str) -> DataFrame:
    """Columns of octets, one for each order of a source and in order of arrival, delta-coded to bytes and
    back to eight-byte values."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", "octets"))), lambda x: F.lpad(F.hex(x["octets"]), 16, "0"))
    columns = flow_events(spark, d).groupBy("src", F.expr("ord div 1000000000")).agg(F.unhex(F.array_join(ordered, "")).alias("raw"))
    back = columns.select("src", C.inflate(B.CODEC_DELTA, 1 << 26)(C.deflate(B.CODEC_DELTA)("raw")).alias("raw"))
    value = F.explode(F.transform(F.sequence(F.lit(0), F.length("raw") - 8, F.lit(8)), lambda i: C.big_endian(F.col("raw"), i, 8)))
    return back.select("src", value.alias("v")).groupBy("src").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.max("v").alias("high"))


@query(f"SELECT src, flow_id, CAST(sum(CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 ELSE 4 END) AS BIGINT) AS size FROM (SELECT src, flow_id, octets - min(octets) OVER (PARTITION BY src, flow_id) AS v FROM ({FLOW_EVENTS})) GROUP BY src, flow_id")
def k_block_size(spark: SparkSession, d: str) -> DataFrame:
    """What frame-of-reference blocks of each group would take, without making them."""
    e = flow_events(spark, d)
    low = e.groupBy("src", "flow_id").agg(F.min("octets").alias("low"))
    return e.join(low, ["src", "flow_id"]).groupBy("src", "flow_id").agg(F.sum(C.varint_len(F.col("octets") - F.col("low"))).alias("size"))


#: The bytes of a text as a list of numbers.
BYTES = "list_transform(regexp_extract_all(hex(encode({t})), '..'), lambda x: CAST('0x' || x AS INTEGER))"
SIGNED = "CASE WHEN {x} >= 9223372036854775808::HUGEINT THEN {x} - 18446744073709551616::HUGEINT ELSE {x} END"


@query(f"""WITH t AS (SELECT doc_id, {BYTES.format(t="coalesce(text, '')")} AS b FROM documents),
  crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT))) AS steps),
  f AS (SELECT doc_id, b, list_reduce(b, lambda c, x: xor(c >> 8, steps[xor(c, CAST(x AS BIGINT)) & 255 + 1]), CAST(4294967295 AS BIGINT)) AS c,
    list_reduce(b, lambda h, x: (xor(h, CAST(x AS HUGEINT)) * 1099511628211) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT) AS h FROM t, crc)
  SELECT doc_id, xor(c, 4294967295) AS crc,
    (CAST(len(b) AS BIGINT) + coalesce(list_sum(list_transform(b, lambda x, i: (len(b) - i + 1) * x)), 0)) % 65521 * 65536 + (1 + coalesce(list_sum(b), 0)) % 65521 AS adler,
    CAST({SIGNED.format(x='h')} AS BIGINT) AS fnv FROM f""".replace("xor(c, CAST(x AS BIGINT)) & 255 + 1", "(xor(c, CAST(x AS BIGINT)) & 255) + 1"))
def k_checksums(spark: SparkSession, d: str) -> DataFrame:
    data = F.col("text").cast("binary")
    return documents(spark, d).select("doc_id", F.crc32(data).alias("crc"), C.adler32()(data).alias("adler"), C.fnv1a()(data).alias("fnv"))


@query("SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS digits, base64(encode(coalesce(text, ''))) AS b64, true AS same FROM documents")
def k_text_forms(spark: SparkSession, d: str) -> DataFrame:
    data = F.col("text").cast("binary")
    digits, b64 = C.hex_text(data), F.regexp_replace(F.base64(data), "\r\n", "")
    same = (C.hex_bytes(F.concat(digits, F.lit(" \n"))) == data) & (C.base64_bytes(F.concat(b64, F.lit(" \n"))) == data)
    return documents(spark, d).select("doc_id", digits.alias("digits"), b64.alias("b64"), same.alias("same"))


@query(f"SELECT src, concat_ws('.', (a >> 24) & 255, (a >> 16) & 255, (a >> 8) & 255, a & 255) AS quad, a AS back, CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' ELSE 'icmp' END AS protocol, count(*) AS n FROM (SELECT src, src * 7919 + 167772160 AS a, proto FROM ({FLOW_EVENTS})) GROUP BY ALL")
def k_addresses(spark: SparkSession, d: str) -> DataFrame:
    e = flow_events(spark, d).select("src", (F.col("src") * 7919 + 167772160).alias("a"), "proto")
    shown = e.select("src", C.ipv4_text(F.col("a")).alias("quad"), C.protocol_name(F.col("proto")).alias("protocol"))
    return shown.withColumn("back", C.ipv4_number(F.col("quad"))).groupBy("src", "quad", "back", "protocol").agg(F.count("*").alias("n"))


@query("SELECT b AS byte, count(*) AS n FROM (SELECT unnest(string_split_regex(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' ')) AS b FROM documents) WHERE b <> '' GROUP BY 1")
def a_byte_counts(spark: SparkSession, d: str) -> DataFrame:
    return analytics.byte_counts(documents(spark, d).select(F.col("text").cast("binary").alias("b")), "b")


@query("WITH c AS (SELECT b, count(*) AS n FROM (SELECT unnest(string_split_regex(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' ')) AS b FROM documents) WHERE b <> '' GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_bytes, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS bits, false AS high_entropy FROM c")
def a_entropy(spark: SparkSession, d: str) -> DataFrame:
    found = analytics.entropy(analytics.byte_counts(documents(spark, d).select(F.col("text").cast("binary").alias("b")), "b"))
    return found.withColumn("bits", F.round("bits", 6))


@query("""WITH c AS (SELECT doc_id, b, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' ')) AS b FROM documents) WHERE b <> '' GROUP BY ALL),
  e AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS bits FROM c GROUP BY 1)
  SELECT doc_id, coalesce(round(abs(bits), 6), 0) AS bits FROM documents LEFT JOIN e USING (doc_id)""")
def a_row_entropy(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.round(analytics.row_entropy()(F.col("text").cast("binary")), 6).alias("bits"))


EXPORTED = "src, dst, sport, dport, proto, octets, packets, records"


@query(f"""SELECT '{{"src":' || src || ',"dst":' || dst || ',"sport":' || sport || ',"dport":' || dport || ',"proto":' || proto || ',"octets":' || octets || ',"packets":' || packets || ',"records":' || records || ',"template":256}}' AS line FROM ({FLOWS})""")
def x_json(spark: SparkSession, d: str) -> DataFrame:
    return export.lines(flow_table(spark, d).withColumn("template_id", F.lit(256)), "json")


@query(f"SELECT concat_ws(',', {EXPORTED}, 256) AS line FROM ({FLOWS})")
def x_csv(spark: SparkSession, d: str) -> DataFrame:
    return export.lines(flow_table(spark, d).withColumn("template_id", F.lit(256)), "csv")


@query(f"SELECT src || ':' || sport || ' -> ' || dst || ':' || dport || ' proto=' || proto || ' ' || octets || 'o/' || packets || 'p' AS line FROM ({FLOWS})")
def x_text(spark: SparkSession, d: str) -> DataFrame:
    return export.lines(flow_table(spark, d), "text")


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[,"\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM documents""")
def x_csv_quoting(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", export.csv_field(F.col("text")).alias("field"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > 12 THEN trim(regexp_replace(lower(left(hex(encode(text)), 24)), '(..)', '\\1 ', 'g')) || ' …' ELSE trim(regexp_replace(lower(hex(encode(text))), '(..)', '\\1 ', 'g')) END AS preview FROM documents")
def x_preview(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", C.hex_preview(F.col("text").cast("binary")).alias("preview"))


PART = "rpad(trim(regexp_replace(lower(substr(h, {a}, 16)), '(..)', '\\1 ', 'g')), 23, ' ')"


@query(f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(coalesce(text, ''))), '.{{1,32}}')) AS h, generate_subscripts(regexp_extract_all(hex(encode(coalesce(text, ''))), '.{{1,32}}'), 1) - 1 AS i FROM documents),
  l AS (SELECT doc_id, i, lower(lpad(hex(16 * i), 8, '0')) || '  ' || {PART.format(a=1)} || '  ' || {PART.format(a=17)} || '  |' ||
    array_to_string(list_transform(regexp_extract_all(h, '..'), lambda x: CASE WHEN x BETWEEN '20' AND '7E' THEN chr(CAST('0x' || x AS INTEGER)) ELSE '.' END), '') || '|' || chr(10) AS line FROM t)
  SELECT doc_id, coalesce(string_agg(line, '' ORDER BY i), '') AS dump FROM documents LEFT JOIN l USING (doc_id) GROUP BY doc_id""")
def x_hexdump(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", C.hexdump()(F.col("text").cast("binary")).alias("dump"))


SCORE = """
    ; octets * 8 - packets
    load 0
    push 8
    mul
    load 1
    sub
    ret
"""
CAPPED = """
    load 1
    push 25
    sub
    jz even
    load 0
    ret
even:
    pushw 1000
    ret
"""


@query(f"SELECT src, dst, flow_id, sport, dport, proto, octets * 8 - packets AS score FROM ({FLOWS})")
def u_transform(spark: SparkSession, d: str) -> DataFrame:
    t = transform.transform(flow_table(spark, d), transform.assemble(SCORE), {0: "octets", 1: "packets"}, "score")
    return t.select("src", "dst", "flow_id", "sport", "dport", "proto", "score")


@query(f"SELECT src, dst, flow_id, sport, dport, proto, CASE WHEN packets = 25 THEN 1000 ELSE octets END AS score FROM ({FLOWS})")
def u_transform_jumps(spark: SparkSession, d: str) -> DataFrame:
    t = transform.transform(flow_table(spark, d), transform.assemble(CAPPED), {0: "octets", 1: "packets"}, "score")
    return t.select("src", "dst", "flow_id", "sport", "dport", "proto", "score")
