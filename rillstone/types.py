"""Schemas, wire constants and dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Fixed values of the stream format.
STREAM_MAGIC = bytes.fromhex("43565750")
CAPTURE_MAGIC = bytes.fromhex("43564350")
SNAPSHOT_MAGIC = bytes.fromhex("43565353")
CATALOG_MAGIC = bytes.fromhex("43564354")
STREAM_VERSION, CAPTURE_VERSION, SNAPSHOT_VERSION, CATALOG_VERSION = 4, 1, 1, 1
MAX_MESSAGE, MAX_CAPTURED, MAX_BATCHED = 16 << 20, 8 << 20, 8 << 20
STREAM_TRAILER_CRC, STREAM_COMPRESSED = 1, 2
MESSAGE_COMPRESSED, MESSAGE_CONTINUATION, MESSAGE_CONTROL = 1, 2, 4

# Code, name, category, least payload length, needs an open session, is control.
MESSAGE_TYPES = [
    (0x01, "SESSION_OPEN", "session", 8, False, True),
    (0x02, "SESSION_CLOSE", "session", 0, False, True),
    (0x03, "SCHEMA_DEF", "schema", 4, True, False),
    (0x04, "SCHEMA_UPDATE", "schema", 4, True, False),
    (0x05, "TEMPLATE_DEF", "schema", 4, True, False),
    (0x06, "DATA_RECORD", "data", 2, True, False),
    (0x07, "FRAGMENT", "reassembly", 10, True, False),
    (0x08, "FRAGMENT_REORDER", "reassembly", 8, True, False),
    (0x09, "FLOW_OPEN", "flow", 8, True, True),
    (0x0A, "FLOW_TIMEOUT", "flow", 4, True, True),
    (0x0B, "COMPRESSED_BLOCK", "compression", 5, True, False),
    (0x0C, "SECTION_HEADER", "data", 4, True, False),
    (0x0D, "CONN_OPEN", "connection", 4, True, True),
    (0x0E, "CONN_RESET", "connection", 4, True, True),
    (0x0F, "CONTINUATION", "data", 0, True, False),
    (0x10, "MODULE_LOAD", "engine", 4, True, False),
    (0x11, "MODULE_RELOAD", "engine", 4, True, False),
    (0x12, "CALL_SYMBOL", "engine", 4, True, False),
    (0x13, "SCOPE_BEGIN", "engine", 0, True, True),
    (0x14, "PLUGIN_REGISTER", "engine", 4, True, False),
    (0x15, "SCOPE_END", "engine", 0, True, True),
    (0x16, "PLUGIN_INVOKE", "engine", 4, True, False),
    (0x17, "COMPRESS_CONFIG", "compression", 1, True, False),
    (0x18, "COMPRESS_DATA", "compression", 4, True, False),
    (0x19, "REQUEST", "connection", 4, True, False),
    (0x1A, "PROCESS_QUEUE", "connection", 0, True, False),
    (0x1B, "STREAM_OPEN", "stream", 4, True, False),
    (0x1C, "PACKET", "stream", 2, True, False),
    (0x1D, "READ_WINDOW", "stream", 4, True, False),
    (0x1E, "SEEK_RELATIVE", "stream", 4, True, False),
    (0x1F, "CHANNEL_OPEN", "channel", 4, True, True),
    (0x20, "CHANNEL_TEARDOWN", "channel", 4, True, True),
    (0x21, "CHANNEL_ALLOC", "channel", 8, True, False),
    (0x22, "NESTED_RECORD", "data", 0, True, False),
    (0x23, "SNAPSHOT_BEGIN", "snapshot", 0, True, True),
    (0x24, "SNAPSHOT_COMMIT", "snapshot", 0, True, True),
]
MESSAGE_NAMES = {code: name for code, name, *_ in MESSAGE_TYPES}
MESSAGE_CODES = {name: code for code, name in MESSAGE_NAMES.items()}

# Wire code -> name and width (0: the spec's width or a length prefix).
FIELD_TYPES = {
    1: ("u8", 1),
    2: ("u16", 2),
    3: ("u32", 4),
    4: ("u64", 8),
    5: ("i32", 4),
    6: ("i64", 8),
    7: ("fixed", 0),
    8: ("bytes", 0),
    9: ("utf8", 0),
    10: ("timestamp", 8),
}
FIELD_CODES = {name: code for code, (name, _) in FIELD_TYPES.items()}
VARIABLE_TYPES = ("bytes", "utf8")

# Fixed values of the information model: id, name, type, width.
ELEMENTS = [
    (1, "octetCount", "u64", 8),
    (2, "packetCount", "u64", 8),
    (3, "flowCount", "u64", 8),
    (4, "protocolIdentifier", "u8", 1),
    (5, "ipClassOfService", "u8", 1),
    (6, "tcpControlBits", "u16", 2),
    (7, "sourceTransportPort", "u16", 2),
    (8, "sourceIPv4Address", "u32", 4),
    (9, "sourceIPv4PrefixLength", "u8", 1),
    (10, "ingressInterface", "u32", 4),
    (11, "destinationTransportPort", "u16", 2),
    (12, "destinationIPv4Address", "u32", 4),
    (13, "destinationIPv4PrefixLength", "u8", 1),
    (14, "egressInterface", "u32", 4),
    (15, "ipNextHopIPv4Address", "u32", 4),
    (16, "bgpSourceAsNumber", "u32", 4),
    (17, "bgpDestinationAsNumber", "u32", 4),
    (21, "flowEndSysUpTime", "u32", 4),
    (22, "flowStartSysUpTime", "u32", 4),
    (32, "icmpTypeCodeIPv4", "u16", 2),
    (34, "samplingInterval", "u32", 4),
    (35, "samplingAlgorithm", "u8", 1),
    (36, "flowActiveTimeout", "u16", 2),
    (37, "flowIdleTimeout", "u16", 2),
    (40, "exportedOctetTotalCount", "u64", 8),
    (41, "exportedMessageTotalCount", "u64", 8),
    (42, "exportedFlowRecordTotalCount", "u64", 8),
    (52, "minimumTTL", "u8", 1),
    (53, "maximumTTL", "u8", 1),
    (56, "sourceMacAddress", "fixed", 6),
    (57, "postDestinationMacAddress", "fixed", 6),
    (58, "vlanId", "u16", 2),
    (60, "ipVersion", "u8", 1),
    (61, "flowDirection", "u8", 1),
    (82, "interfaceName", "utf8", 0),
    (83, "interfaceDescription", "utf8", 0),
    (85, "octetTotalCount", "u64", 8),
    (86, "packetTotalCount", "u64", 8),
    (136, "flowEndReason", "u8", 1),
    (150, "flowStartSeconds", "timestamp", 8),
    (151, "flowEndSeconds", "timestamp", 8),
    (152, "flowStartMilliseconds", "timestamp", 8),
    (153, "flowEndMilliseconds", "timestamp", 8),
    (210, "paddingOctets", "fixed", 0),
    (214, "exportProtocolVersion", "u8", 1),
    (230, "natEvent", "u8", 1),
    (233, "firewallEvent", "u8", 1),
    (234, "ingressVRFID", "u32", 4),
    (235, "egressVRFID", "u32", 4),
    (239, "biflowDirection", "u8", 1),
    (243, "dot1qVlanId", "u16", 2),
    (256, "sourceIPv6Address", "fixed", 16),
    (257, "destinationIPv6Address", "fixed", 16),
    (258, "applicationId", "fixed", 4),
    (300, "observationDomainName", "utf8", 0),
    (315, "dataLinkFrameSize", "u16", 2),
    (346, "privateEnterpriseNumber", "u32", 4),
    (400, "layer2FrameSection", "bytes", 0),
]
ELEMENT_NAMES = {i: name for i, name, _, _ in ELEMENTS}

#: Six columns that name a flow, in this order.
FLOW_KEY = ["src", "dst", "flow_id", "sport", "dport", "proto"]

#: The clock's epoch, 2020-01-01T00:00:00Z, in milliseconds since 1970.
EPOCH_MS = 1_577_836_800_000

FIELD_SPEC = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("name", T.StringType())])

MESSAGES = T.StructType(
    [
        T.StructField("stream_id", T.StringType()),
        T.StructField("transport_id", T.LongType()),
        T.StructField("capture_ts_ms", T.LongType()),
        T.StructField("stream_flags", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("type_code", T.IntegerType()),
        T.StructField("type_name", T.StringType()),
        T.StructField("flags", T.IntegerType()),
        T.StructField("offset", T.IntegerType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)

FLOWS = T.StructType(
    [
        T.StructField("src", T.LongType()),
        T.StructField("dst", T.LongType()),
        T.StructField("flow_id", T.LongType()),
        T.StructField("sport", T.IntegerType()),
        T.StructField("dport", T.IntegerType()),
        T.StructField("proto", T.IntegerType()),
        T.StructField("octets", T.LongType()),
        T.StructField("packets", T.LongType()),
        T.StructField("records", T.LongType()),
        T.StructField("first_ms", T.LongType()),
        T.StructField("last_ms", T.LongType()),
        T.StructField("template_id", T.IntegerType()),
        T.StructField("template_gen", T.LongType()),
    ]
)


def message_types(spark: SparkSession) -> DataFrame:
    """The message types as a dimension table of fixed size (36 rows)."""
    return spark.createDataFrame(MESSAGE_TYPES, "type_code int, type_name string, category string, min_len int, requires_open boolean, is_control boolean")


def info_model(spark: SparkSession) -> DataFrame:
    """The information model as a dimension table of fixed size."""
    return spark.createDataFrame(ELEMENTS, "id int, name string, type string, width int")
