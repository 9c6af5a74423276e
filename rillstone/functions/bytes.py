"""Byte-level codecs and checks, in plain Python; ``columns.py`` wraps them for DataFrames."""

from __future__ import annotations

import heapq
import struct
import zlib
from collections import Counter
from collections.abc import Sequence
from itertools import groupby

U64 = (1 << 64) - 1


class CodecError(ValueError):
    """Input that a codec or parser can't read, or output over its limit."""


def _room(have: int, more: int, limit: int) -> None:
    if have + more > limit:
        raise CodecError("output over limit")


# Variable-length integers: seven bits a byte, low bits first, ten bytes at most.


def varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """The value and the position behind it."""
    value = 0
    for i in range(10):
        if at + i >= len(data):
            raise CodecError("varint past the end")
        byte = data[at + i]
        value |= (byte & 0x7F) << 7 * i
        if byte < 0x80:
            if value > U64:
                raise CodecError("varint over 64 bits")
            return value, at + i + 1
    raise CodecError("varint too long")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def zigzag(value: int) -> int:
    return (value << 1 ^ value >> 63) & U64


def unzigzag(value: int) -> int:
    return value >> 1 ^ -(value & 1)


# Run-length coding: a control byte under 0x80 takes control + 1 literals, another repeats the next
# byte control - 0x80 + 2 times.


def rle_encode(data: bytes) -> bytes:
    out, literal = bytearray(), bytearray()

    def flush() -> None:
        for i in range(0, len(literal), 128):
            part = literal[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for byte, run in groupby(data):
        n = sum(1 for _ in run)
        while n > 1:
            flush()
            take = min(n, 129)
            out += bytes((0x80 + take - 2, byte))
            n -= take
        if n:
            literal.append(byte)
    flush()
    return bytes(out)


def rle_decode(data: bytes, limit: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        control = data[at]
        n, width = (control + 1, control + 1) if control < 0x80 else (control - 0x80 + 2, 1)
        chunk = data[at + 1 : at + 1 + width]
        if len(chunk) < width:
            raise CodecError("run past the end")
        _room(len(out), n, limit)
        out += chunk if control < 0x80 else chunk * n
        at += 1 + width
    return bytes(out)


# Zig-zag deltas of a column of unsigned 64-bit values, the count first.


def delta_encode(values: Sequence[int]) -> bytes:
    before, parts = 0, [varint(len(values))]
    for v in values:
        parts.append(varint(zigzag(signed((v - before) & U64))))
        before = v
    return b"".join(parts)


def delta_decode(data: bytes, max_values: int) -> list[int]:
    count, at = read_varint(data, 0)
    if count > max_values:
        raise CodecError("column too long")
    total, out = 0, []
    for _ in range(count):
        step, at = read_varint(data, at)
        total = (total + unzigzag(step)) & U64
        out.append(total)
    return out


def scatter_decode(data: bytes, limit: int, stride: int) -> bytes:
    """(index, byte) pairs placed at index * stride of a zero buffer; bounded in bytes."""
    count, at = read_varint(data, 0)
    if count > limit:
        raise CodecError("too many entries")
    placed: dict[int, int] = {}
    for _ in range(count):
        index, at = read_varint(data, at)
        if at >= len(data):
            raise CodecError("entry past the end")
        if index * stride >= limit:
            raise CodecError("index out of range")
        placed[index * stride] = data[at]
        at += 1
    out = bytearray(max(placed, default=-1) + 1)
    for place, byte in placed.items():
        out[place] = byte
    return bytes(out)


# Bits, most significant first.


class BitWriter:
    def __init__(self) -> None:
        self.value, self.n = 0, 0
        self.parts: list[bytes] = []

    def write(self, value: int, width: int) -> None:
        self.value = self.value << width | value
        self.n += width
        if self.n >= 4096:
            keep = self.n % 8
            self.parts.append((self.value >> keep).to_bytes(self.n // 8, "big"))
            self.value &= (1 << keep) - 1
            self.n = keep

    def finish(self) -> bytes:
        pad = -self.n % 8
        return b"".join([*self.parts, (self.value << pad).to_bytes((self.n + pad) // 8, "big")])


class BitReader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def left(self) -> int:
        return self.end - self.at

    def read(self, width: int) -> int:
        if width > self.left():
            raise CodecError("bits past the end")
        first, last = self.at // 8, (self.at + width + 7) // 8
        window = int.from_bytes(self.data[first:last], "big")
        self.at += width
        return window >> (8 * last - self.at) & ((1 << width) - 1)


# Canonical Huffman codes: shorter codes first, then by symbol. A block is the output's length, 256
# code lengths of four bits each, and the bits.

MAX_CODE = 15


def huffman_lengths(data: bytes) -> list[int]:
    """Code lengths of at most 15 bits; counts are flattened until the tree is that low."""
    counts = Counter(data)
    lengths = [0] * 256
    if len(counts) == 1:
        lengths[data[0]] = 1
        return lengths
    while counts:
        heap = [(n, [s]) for s, n in sorted(counts.items())]
        heapq.heapify(heap)
        depth: Counter[int] = Counter()
        while len(heap) > 1:
            (n, a), (m, b) = heapq.heappop(heap), heapq.heappop(heap)
            depth.update(a + b)
            heapq.heappush(heap, (n + m, a + b))
        if max(depth.values()) <= MAX_CODE:
            for s, d in depth.items():
                lengths[s] = d
            break
        counts = Counter({s: (n + 1) // 2 for s, n in counts.items()})
    return lengths


def canonical_codes(lengths: Sequence[int]) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol."""
    codes, code, before = {}, 0, 0
    for length, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        if length > MAX_CODE:
            raise CodecError("code too long")
        code <<= length - before
        before = length
        codes[length, code] = symbol
        code += 1
    return codes


def huffman_symbols(lengths: Sequence[int], bits: bytes, count: int) -> bytes:
    codes, reader, out = canonical_codes(lengths), BitReader(bits), bytearray()
    while len(out) < count:
        code = 0
        for length in range(1, MAX_CODE + 1):
            code = code << 1 | reader.read(1)
            if (symbol := codes.get((length, code))) is not None:
                out.append(symbol)
                break
        else:
            raise CodecError("no such code")
    return bytes(out)


def huffman_encode(data: bytes) -> bytes:
    lengths = huffman_lengths(data)
    codes = {s: (c, n) for (n, c), s in canonical_codes(lengths).items()}
    writer = BitWriter()
    for byte in data:
        writer.write(*codes[byte])
    nibbles = bytes(a << 4 | b for a, b in zip(lengths[::2], lengths[1::2], strict=True))
    return struct.pack(">I", len(data)) + nibbles + writer.finish()


def huffman_decode(data: bytes, limit: int) -> bytes:
    if len(data) < 132:
        raise CodecError("block without its lengths")
    (count,) = struct.unpack_from(">I", data)
    _room(0, count, limit)
    return huffman_symbols([x for byte in data[4:132] for x in (byte >> 4, byte & 15)], data[132:], count)


# LZSS: flag 0 and a byte, or flag 1, twelve bits of distance and four of length - 3. A distance of
# 4096 has no code, so the window is one shorter.

LZ_MIN, LZ_MAX, LZ_WINDOW = 3, 18, 4095


def lz_encode(data: bytes) -> bytes:
    writer, at = BitWriter(), 0
    seen: dict[bytes, list[int]] = {}

    def note(start: int, end: int) -> None:
        for i in range(start, min(end, len(data) - LZ_MIN + 1)):
            seen.setdefault(data[i : i + LZ_MIN], []).append(i)

    while at < len(data):
        best, place = 0, 0
        for start in reversed(seen.get(data[at : at + LZ_MIN], ())):
            if at - start > LZ_WINDOW or best == LZ_MAX:
                break
            n = LZ_MIN
            while n < LZ_MAX and at + n < len(data) and data[start + n] == data[at + n]:
                n += 1
            if n > best:
                best, place = n, start
        if best:
            writer.write(1 << 16 | at - place << 4 | best - LZ_MIN, 17)
        else:
            writer.write(data[at], 9)
        note(at, at + (best or 1))
        at += best or 1
    return writer.finish()


def lz_decode(data: bytes, limit: int) -> bytes:
    reader, out = BitReader(data), bytearray()
    while reader.left() >= 9:
        if reader.read(1):
            distance, n = reader.read(12), reader.read(4) + LZ_MIN
            if not 0 < distance <= len(out):
                raise CodecError("reference out of range")
            _room(len(out), n, limit)
            for _ in range(n):
                out.append(out[-distance])
        else:
            _room(len(out), 1, limit)
            out.append(reader.read(8))
    return bytes(out)


# Dictionary substitution: a tag under 0x80 takes tag + 1 literals, others are 15 bits of entry.


def dict_encode(data: bytes, entries: Sequence[bytes]) -> bytes:
    by_size = sorted(((e, i) for i, e in reversed(list(enumerate(entries))) if e), key=lambda x: (-len(x[0]), x[1]))
    out, literal, at = bytearray(), bytearray(), 0
    while at <= len(data):
        entry = next(((e, i) for e, i in by_size if data.startswith(e, at)), None) if at < len(data) else None
        if literal and (entry or at == len(data) or len(literal) == 128):
            out.append(len(literal) - 1)
            out += literal
            literal.clear()
        if at == len(data):
            break
        if entry:
            out += struct.pack(">H", 0x8000 | entry[1])
            at += len(entry[0])
        else:
            literal.append(data[at])
            at += 1
    return bytes(out)


def dict_decode(data: bytes, entries: Sequence[bytes], limit: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        if data[at] < 0x80:
            part = data[at + 1 : at + 2 + data[at]]
            if len(part) <= data[at]:
                raise CodecError("literal past the end")
            at += 1 + len(part)
        else:
            if at + 2 > len(data):
                raise CodecError("reference past the end")
            index = struct.unpack_from(">H", data, at)[0] & 0x7FFF
            if index >= len(entries):
                raise CodecError("no such entry")
            part = entries[index]
            at += 2
        _room(len(out), len(part), limit)
        out += part
    return bytes(out)


# Frame of reference: count, minimum, then distances from the minimum.


def block_encode(values: Sequence[int]) -> bytes:
    low = min(values, default=0)
    return b"".join(map(varint, [len(values), low, *(v - low for v in values)]))


def block_decode(data: bytes) -> list[int]:
    count, at = read_varint(data, 0)
    if count > 1 << 20:
        raise CodecError("block too long")
    low, at = read_varint(data, at)
    out = []
    for _ in range(count):
        step, at = read_varint(data, at)
        out.append((low + step) & U64)
    return out


# Codec numbers; 0xFF also passes data through.
CODEC_NONE, CODEC_RLE, CODEC_DELTA, CODEC_HUFFMAN, CODEC_LZ, CODEC_DICT = range(6)
CODEC_PASS = 0xFF


def inflate(codec: int, data: bytes, limit: int, entries: Sequence[bytes] = (), stride: int = 1) -> bytes:
    """Decoded bytes; a delta column gives eight big-endian bytes a value, or with a stride a scatter."""
    if codec in (CODEC_NONE, CODEC_PASS):
        return bytes(data)
    if codec == CODEC_RLE:
        return rle_decode(data, limit)
    if codec == CODEC_DELTA:
        if stride > 1:
            return scatter_decode(data, limit, stride)
        values = delta_decode(data, limit // 8)
        return struct.pack(f">{len(values)}Q", *values)
    if codec == CODEC_HUFFMAN:
        return huffman_decode(data, limit)
    if codec == CODEC_LZ:
        return lz_decode(data, limit)
    if codec == CODEC_DICT:
        return dict_decode(data, entries, limit)
    raise CodecError(f"no codec {codec}")


def deflate(codec: int, data: bytes, entries: Sequence[bytes] = ()) -> bytes:
    if codec in (CODEC_NONE, CODEC_PASS):
        return bytes(data)
    if codec == CODEC_RLE:
        return rle_encode(data)
    if codec == CODEC_DELTA:
        return delta_encode(struct.unpack(f">{len(data) // 8}Q", data[: len(data) // 8 * 8]))
    if codec == CODEC_HUFFMAN:
        return huffman_encode(data)
    if codec == CODEC_LZ:
        return lz_encode(data)
    if codec == CODEC_DICT:
        return dict_encode(data, entries)
    raise CodecError(f"no codec {codec}")


def wrap_frame(codec: int, data: bytes) -> bytes:
    """A self-describing frame: codec, raw length, Adler-32 of the raw bytes, payload."""
    return struct.pack(">BII", codec, len(data), zlib.adler32(data)) + deflate(codec, data)


def unwrap_frame(frame: bytes, limit: int) -> bytes:
    if len(frame) < 9:
        raise CodecError("frame without its head")
    codec, size, check = struct.unpack_from(">BII", frame)
    _room(0, size, limit)
    out = inflate(codec, frame[9:], limit)
    if len(out) != size or zlib.adler32(out) != check:
        raise CodecError("frame length or checksum differs")
    return out


# Hashes and addresses.

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    value = FNV_OFFSET
    for byte in data:
        value = (value ^ byte) * FNV_PRIME & U64
    return value


def flow_digest(src: int, dst: int, flow_id: int, sport: int, dport: int, proto: int) -> int:
    """Mixes a flow key into 64 bits: hashes of the addresses, the second rotated, then the rest."""
    a, b = (fnv1a(struct.pack(">I", x)) for x in (src, dst))
    turned = (b << 17 | b >> 47) & U64
    return a ^ turned ^ (flow_id * 0x9E3779B97F4A7C15 & U64) ^ (sport << 16 | dport) ^ proto << 48


def ipv6_text(address: bytes) -> str:
    """Groups in hexadecimal, the longest run of two or more zero groups as ``::``."""
    groups = struct.unpack(">8H", address)
    runs, at = [], 0
    for zero, run in groupby(groups, lambda g: g == 0):
        n = sum(1 for _ in run)
        if zero and n > 1:
            runs.append((n, -at))
        at += n
    if not runs:
        return ":".join(f"{g:x}" for g in groups)
    n, start = max(runs)
    start = -start
    return ":".join(f"{g:x}" for g in groups[:start]) + "::" + ":".join(f"{g:x}" for g in groups[start + n :])


def hexdump(data: bytes, base: int = 0) -> str:
    """Sixteen bytes a line: offset, two halves in hexadecimal, printable characters."""
    lines = []
    for at in range(0, len(data), 16):
        row = data[at : at + 16]
        left, right = (" ".join(f"{b:02x}" for b in part).ljust(23) for part in (row[:8], row[8:]))
        shown = "".join(chr(b) if 0x20 <= b < 0x7F else "." for b in row)
        lines.append(f"{base + at:08x}  {left}  {right}  |{shown}|\n")
    return "".join(lines)
