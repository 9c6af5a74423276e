import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillstone.functions import bytes as B

LIMIT = 1 << 20


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=700) | st.text(alphabet="ab", max_size=900).map(str.encode))
def test_codecs_lose_nothing(data):
    for codec in (B.CODEC_NONE, B.CODEC_RLE, B.CODEC_HUFFMAN, B.CODEC_LZ, B.CODEC_PASS):
        assert B.inflate(codec, B.deflate(codec, data), LIMIT) == data
    for codec in (B.CODEC_NONE, B.CODEC_RLE, B.CODEC_HUFFMAN, B.CODEC_LZ):
        assert B.unwrap_frame(B.wrap_frame(codec, data), LIMIT) == data
    entries = [b"ab", b"abab", b"", b"b"]
    assert B.dict_decode(B.dict_encode(data, entries), entries, LIMIT) == data


@given(st.lists(st.integers(0, B.U64), max_size=60))
def test_columns_lose_nothing(values):
    assert B.delta_decode(B.delta_encode(values), 1000) == values
    assert B.block_decode(B.block_encode(values)) == values
    raw = struct.pack(f">{len(values)}Q", *values)
    assert B.inflate(B.CODEC_DELTA, B.deflate(B.CODEC_DELTA, raw), LIMIT) == raw


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=200))
def test_damage_is_an_error_and_nothing_else(data):
    for codec in range(6):
        try:
            assert len(B.inflate(codec, data, 4096, [b"x"])) <= 4096
        except B.CodecError:
            pass


def test_limits_hold():
    for codec in (B.CODEC_RLE, B.CODEC_HUFFMAN, B.CODEC_LZ):
        with pytest.raises(B.CodecError):
            B.inflate(codec, B.deflate(codec, b"a" * 500), 499)
    frame = bytearray(B.wrap_frame(B.CODEC_RLE, b"hello hello"))
    frame[7] ^= 1
    with pytest.raises(B.CodecError):
        B.unwrap_frame(bytes(frame), LIMIT)


def test_known_values():
    assert B.huffman_symbols([1 if i in (97, 98) else 0 for i in range(256)], b"\x50", 4) == b"abab"
    assert zlib.crc32(b"123456789") == 0xCBF43926 and zlib.adler32(b"Wikipedia") == 0x11E60398
    for v in (0, 1, 127, 128, 300, 16384, 2**32 - 1, B.U64):
        assert B.read_varint(B.varint(v), 0) == (v, len(B.varint(v)))
    for v in (0, -1, 1, 2**63 - 1, -(2**63)):
        assert B.unzigzag(B.zigzag(v)) == v
    assert B.delta_decode(B.delta_encode([1000, 1001, 1002, 999, 5000, 5000]), 6) == [1000, 1001, 1002, 999, 5000, 5000]
    assert B.ipv6_text(bytes.fromhex("20010000000000000000000000000001")) == "2001::1"
    assert B.ipv6_text(bytes(16)) == "::"
    assert B.fnv1a(b"") == B.FNV_OFFSET
    assert B.scatter_decode(B.varint(2) + B.varint(3) + b"x" + B.varint(0) + b"y", 64, 2) == b"y\0\0\0\0\0x"


def test_long_input_stays_quick():
    data = bytes(random.Random(1).choices(b"abcd", k=60_000))
    assert B.lz_decode(B.lz_encode(data), LIMIT) == data
