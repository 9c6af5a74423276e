"""Column functions. All are built-in expressions but those at the end, whose bytes need Python."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Sequence
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from ..types import EPOCH_MS
from . import bytes as B

#: The size of the unsigned 64-bit range, and where its sign bit is.
I64, TOP = Decimal(1 << 64), Decimal(1 << 63)


def long(x) -> Column:
    return (x if isinstance(x, Column) else F.col(x)).cast("long")


def wrap_i64(x: Column) -> Column:
    """A decimal reduced to the signed 64-bit range."""
    r = F.pmod(x.cast("decimal(38,0)"), F.lit(I64))
    return F.when(r >= F.lit(TOP), r - F.lit(I64)).otherwise(r).cast("long")


def wrapping_sum(x: Column) -> Column:
    """A sum that wraps at 64 bits as counters do, where a plain sum would raise."""
    return wrap_i64(F.sum(x.cast("decimal(20,0)")))


# Scalar builtins.


def b_min(a, b):
    return F.least(a, b)


def b_max(a, b):
    return F.greatest(a, b)


def clamp(x, lo, hi) -> Column:
    return F.when(lo > hi, F.raise_error(F.lit("clamp: lo > hi")).cast("long")).otherwise(F.least(F.greatest(x, lo), hi))


def b_abs(x) -> Column:
    """Absolute value; the least long, which has none, stays itself."""
    return F.when(x == F.lit(-(1 << 63)), x).otherwise(F.abs(x))


def sign(x) -> Column:
    return F.signum(x).cast("long")


def popcount(x) -> Column:
    return F.bit_count(x).cast("long")


def bit_length_of(x) -> Column:
    """Bits of a long seen as unsigned; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def leading_zeros(x) -> Column:
    return (64 - bit_length_of(x)).cast("long")


def gcd(a, b) -> Column:
    """Euclid's steps as a fold; 64-bit numbers need under 96."""
    start = F.struct(b_abs(a).cast("long").alias("x"), b_abs(b).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(96)), start, step, lambda s: s["x"])


def div(a: Column, b: Column) -> Column:
    """Integer division, toward zero."""
    return F.call_function("div", a, b)


def ceil_div(a, b) -> Column:
    return F.when(b == 0, F.lit(0).cast("long")).otherwise(div(a + b - 1, F.nullif(b, F.lit(0).cast("long"))))


def wrap_add(a, b) -> Column:
    return wrap_i64(a.cast("decimal(20,0)") + b.cast("decimal(20,0)"))


def select(c, a, b) -> Column:
    return F.when(c != 0, a).otherwise(b)


#: Builtins by name: number of arguments and function.
BUILTINS: dict[str, tuple[int, Callable[..., Column]]] = {
    "abs": (1, b_abs),
    "ceil_div": (2, ceil_div),
    "clamp": (3, clamp),
    "gcd": (2, gcd),
    "leading_zeros": (1, leading_zeros),
    "max": (2, b_max),
    "min": (2, b_min),
    "popcount": (1, popcount),
    "select": (3, select),
    "sign": (1, sign),
    "wrap_add": (2, wrap_add),
}


def builtin(name: str, *args: Column) -> Column | None:
    """The builtin applied, or None if the name or the number of arguments is wrong."""
    n, f = BUILTINS.get(name, (-1, None))
    return f(*args) if f and n == len(args) else None


# Addresses and ports.


def cidr(text: str) -> tuple[int, int]:
    """``a.b.c.d/n`` -> base (host bits cleared) and prefix length."""
    m = re.fullmatch(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})/(\d{1,2})", text.strip())
    if not m or int(m[5]) > 32 or any(int(x) > 255 for x in m.groups()[:4]):
        raise ValueError(f"not a prefix: {text!r}")
    address, n = reduce(lambda a, x: a << 8 | int(x), m.groups()[:4], 0), int(m[5])
    return address & mask_of(n), n


def mask_of(n: int) -> int:
    return 0xFFFFFFFF ^ (0xFFFFFFFF >> n)


def in_cidr(address: Column, text: str) -> Column:
    base, n = cidr(text)
    return address.bitwiseAND(F.lit(mask_of(n)).cast("long")) == base


def network(address: Column, n: int) -> Column:
    return address.bitwiseAND(F.lit(mask_of(n)).cast("long"))


def broadcast_address(address: Column, n: int) -> Column:
    return address.bitwiseOR(F.lit(0xFFFFFFFF ^ mask_of(n)).cast("long"))


def port_set(text: str) -> list[tuple[int, int]]:
    """``80,443,1024-2048`` -> sorted ranges; bounds may be reversed, touching ranges merge."""
    spans = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        lo, _, hi = part.partition("-")
        a, b = int(lo), int(hi or lo)
        if not (0 <= a < 65536 and 0 <= b < 65536):
            raise ValueError(f"not a port: {part!r}")
        spans.append((min(a, b), max(a, b)))
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def port_count(text: str) -> int:
    return sum(b - a + 1 for a, b in port_set(text))


def in_ports(port: Column, text: str) -> Column:
    return reduce(lambda a, b: a | b, (port.between(lo, hi) for lo, hi in port_set(text)), F.lit(False))


def ipv4_text(address: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(address, s).bitwiseAND(F.lit(255).cast("long")).cast("string") for s in (24, 16, 8, 0)])


def ipv4_number(text: Column) -> Column:
    """Null for what is no dotted quad."""
    parts = F.transform(F.split(text, r"\."), lambda x: x.try_cast("long"))
    good = text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda x: x <= 255)
    return F.when(good, F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x))


def mac_text(address: Column) -> Column:
    """Six bytes as ``aa:bb:..``."""
    return F.regexp_replace(F.lower(F.hex(address)), "(..)(?!$)", "$1:")


def mac_bytes(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9A-Fa-f]{2}([:-][0-9A-Fa-f]{2}){5}$"), F.unhex(F.regexp_replace(text, "[:-]", "")))


def mac_bit(address: Column, bit: int) -> Column:
    first = F.conv(F.hex(F.substring(address, 1, 1)), 16, 10).cast("int")
    return first.bitwiseAND(F.lit(bit)) != 0


def mac_is_multicast(address: Column) -> Column:
    return mac_bit(address, 1)


def mac_is_local(address: Column) -> Column:
    return mac_bit(address, 2)


# Protocol numbers and their names.
PROTOCOLS = {1: "icmp", 6: "tcp", 17: "udp", 47: "gre", 50: "esp", 58: "icm6", 132: "sctp"}


def protocol_name(proto: Column) -> Column:
    out = F.lit("?")
    for number, name in PROTOCOLS.items():
        out = F.when(proto == number, name).otherwise(out)
    return out


# Bytes as text, and times.


def u64_image(x: Column) -> Column:
    """The eight big-endian bytes of a long."""
    return F.unhex(F.lpad(F.hex(x), 16, "0"))


def big_endian(data: Column, at: int, width: int) -> Column:
    """An unsigned number of up to seven bytes, or the two's complement of eight, at an offset from 0."""
    digits = F.hex(F.substring(data, at + 1, width))
    if width < 8:
        return F.conv(digits, 16, 10).cast("long")
    return wrap_i64(F.conv(digits, 16, 10).cast("decimal(20,0)"))


def hex_text(data: Column) -> Column:
    return F.lower(F.hex(data))


def hex_bytes(text: Column) -> Column:
    return F.unhex(F.regexp_replace(text, r"\s", ""))


def hex_preview(data: Column, n: int = 12) -> Column:
    shown = F.regexp_replace(F.lower(F.hex(F.substring(data, 1, n))), "(..)(?!$)", "$1 ")
    return F.when(F.length(data) > n, F.concat(shown, F.lit(" …"))).otherwise(shown)


def base64_bytes(text: Column) -> Column:
    return F.unbase64(F.regexp_replace(text, r"\s", ""))


def varint_len(x: Column) -> Column:
    """Bytes of the varint of a long seen as unsigned."""
    return F.greatest(F.lit(1), F.ceil(bit_length_of(x) / 7)).cast("long")


def ts48_bytes(ms: Column) -> Column:
    return F.unhex(F.lpad(F.hex(ms.bitwiseAND(F.lit((1 << 48) - 1))), 12, "0"))


def ts48_value(data: Column) -> Column:
    return F.conv(F.hex(F.substring(data, 1, 6)), 16, 10).cast("long")


def to_epoch(unix_ms: Column) -> Column:
    """Milliseconds since 2020; 0 before."""
    return F.greatest(unix_ms - EPOCH_MS, F.lit(0).cast("long"))


def from_epoch(ms: Column) -> Column:
    return ms + EPOCH_MS


# Functions of whole byte strings, by Arrow batches.


def codec_udf(f: Callable[[bytes], bytes | str | int], returns: str):
    """A pandas UDF of one binary column; null stays null, and unreadable input becomes null."""

    def one(x):
        try:
            return None if x is None else f(bytes(x))
        except B.CodecError:
            return None

    @pandas_udf(returns)
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in data], dtype="object")

    return run


def inflate(codec: int, limit: int, entries: Sequence[bytes] = (), stride: int = 1):
    return codec_udf(lambda x: B.inflate(codec, x, limit, entries, stride), "binary")


def deflate(codec: int, entries: Sequence[bytes] = ()):
    return codec_udf(lambda x: B.deflate(codec, x, entries), "binary")


def wrap_frame(codec: int):
    return codec_udf(lambda x: B.wrap_frame(codec, x), "binary")


def unwrap_frame(limit: int):
    return codec_udf(lambda x: B.unwrap_frame(x, limit), "binary")


def adler32():
    return codec_udf(lambda x: zlib.adler32(x), "long")


def fnv1a():
    return codec_udf(lambda x: B.signed(B.fnv1a(x)), "long")


def ipv6_text():
    return codec_udf(B.ipv6_text, "string")


def hexdump():
    return codec_udf(B.hexdump, "string")


LOW = 0xFFFFFFFF


def _times_low(x: Column, c: int) -> Column:
    """The low 32 bits of a product of 32-bit numbers, by halves of ``c``, so that nothing overflows."""
    return (x * long(F.lit(c & 0xFFFF)) + F.shiftleft((x * long(F.lit(c >> 16))).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(LOW))


def wrap_mul(x: Column, c: int) -> Column:
    """``x * c`` in 64 bits, wrapping, for a constant of up to 64 bits whose low half is under 2**31."""
    low, high = x.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(x, 32)
    first = low * long(F.lit(c & LOW))
    upper = _times_low(high, c & LOW) + _times_low(low, c >> 32) + F.shiftrightunsigned(first, 32)
    return F.shiftleft(upper.bitwiseAND(F.lit(LOW)), 32).bitwiseOR(first.bitwiseAND(F.lit(LOW)))


def fnv1a_u32(x: Column) -> Column:
    """FNV-1a of a number's four bytes, the most significant first.

    A fold, whose variables are values: written out, every round would hold the one before several times.
    """
    parts = F.array(*[F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(0xFF)) for shift in (24, 16, 8, 0)])
    mixed = lambda h, b: F.transform(F.array(h.bitwiseXOR(b)), lambda y: wrap_mul(y, B.FNV_PRIME))[0]
    return F.aggregate(parts, long(F.lit(B.signed(B.FNV_OFFSET))), mixed)


def flow_digest(src, dst, flow_id, sport, dport, proto) -> Column:
    """The compatible digest of a flow key, as a signed long. Null parts give null."""
    src, dst, flow_id, sport, dport, proto = (long(x) for x in (src, dst, flow_id, sport, dport, proto))
    turned = F.transform(F.array(fnv1a_u32(dst)), lambda x: F.shiftleft(x, 17).bitwiseOR(F.shiftrightunsigned(x, 47)))[0]
    ports = F.shiftleft(sport, 16).bitwiseOR(dport)
    return fnv1a_u32(src).bitwiseXOR(turned).bitwiseXOR(wrap_mul(flow_id, 0x9E3779B97F4A7C15)).bitwiseXOR(ports).bitwiseXOR(F.shiftleft(proto, 48))
