"""Operator 1: harmonic packing of documents into sequences of a fixed capacity.

Lengths fall into classes by the reciprocal of the capacity C: class k holds lengths from C/(k + 1) to
C/k, and a bin of class k takes k documents, a fixed number. That leaves a gap of under C/(k + 1).
As documents may be cut, the document that comes next fills the gaps that are open; what it has left
goes to the class of its length. So there is about one cut a bin, and most documents stay whole. A
document of a capacity and more first gives whole sequences. Cutting leaves no piece, and no gap, of
under ``LEAST`` tokens: shorter pieces are documents that are as short, and a smaller gap is padding.

Every task fills its own bins, so nothing is shuffled and workers don't wait for each other. The
bins that are open at the end of a task (under one a class) are emptied, and their pieces are packed
first-fit by decreasing length; so a task leaves one sequence that isn't nearly full.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_automaton import codec
from .common import chunks, documents, texts_of
from .tokenization import vocabulary

CAPACITY = 4096
END_ID = 2

#: Tokens of the least piece that a cut makes, and of the least gap that is worth a cut.
LEAST = 32

#: Sequences a task may number; the task's partition number stands above these bits.
TASK_BITS = 36


class Placed(NamedTuple):
    """A piece's place: tokens ``start`` to ``start + length`` of ``document`` stand at ``offset``."""

    sequence: int
    offset: int
    document: object
    start: int
    length: int


class HarmonicPacker:
    """Places documents, given in any order, into bins; one object for each worker."""

    def __init__(self, capacity: int = CAPACITY, first: int = 0, least: int = LEAST):
        self.capacity, self.next, self.least = capacity, first, least
        self.open: dict[int, list] = {}  # class -> (document, start, length)
        self.gaps: list[list[int]] = []  # sequence, tokens in it

    def _number(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, document, length: int) -> list[Placed]:
        """What this document of ``length`` tokens settles: full capacities, gaps, a bin that it fills."""
        start, out = 0, []
        while length - start >= self.capacity:
            after = length - start - self.capacity
            take = self.capacity - (max(0, self.least - after) if after else 0)
            out.append(Placed(self._number(), 0, document, start, take))
            start += take
        while self.gaps and start < length:
            sequence, used = self.gaps[-1]
            room, rest = self.capacity - used, length - start
            take = rest if rest <= room else min(room, rest - self.least)
            if take < min(self.least, rest):
                break
            out.append(Placed(sequence, used, document, start, take))
            start += take
            self.gaps.pop()
            if room - take >= self.least:
                self.gaps.append([sequence, used + take])
        if start < length:
            per_bin = self.capacity // (length - start)
            held = self.open.setdefault(per_bin, [])
            held.append((document, start, length - start))
            if len(held) == per_bin:
                del self.open[per_bin]
                sequence, used = self._number(), 0
                for piece in held:
                    out.append(Placed(sequence, used, *piece))
                    used += piece[2]
                if self.capacity - used >= self.least:
                    self.gaps.append([sequence, used])
        return out

    def finish(self) -> list[Placed]:
        """Place what is left, longest pieces first, each into the first bin with room."""
        bins, out = self.gaps, []
        # Bins that have no room for the shortest piece any more are passed over for good.
        held = sorted((piece for pieces in self.open.values() for piece in pieces), key=lambda p: -p[2])
        shortest = held[-1][2] if held else 0
        for piece in held:
            b = next((b for b in bins if b[1] + piece[2] <= self.capacity), None)
            if b is None:
                b = [self._number(), 0]
                bins.append(b)
            out.append(Placed(b[0], b[1], *piece))
            b[1] += piece[2]
            if b[1] + shortest > self.capacity:
                bins.remove(b)
        self.open, self.gaps = {}, []
        return out


def pack_documents(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: ``key, start, length, doc_tokens, sequence_id, offset, tokens``.

    ``tokens`` holds the piece's ids, four little-endian bytes each. Null and empty texts are a piece
    with the end id alone; repeated rows are packed each; null keys pass through; an empty table
    gives no rows; other columns are left out.
    """
    names = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    schema = df.select(key).schema
    for name in names:
        schema = schema.add(name, "long")
    schema = schema.add("tokens", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = codec(path), np.uint32(end_id).astype("<u4").tobytes()
        packer = HarmonicPacker(capacity, TaskContext.get().partitionId() << TASK_BITS)
        kind = None

        def rows(placed: list) -> pa.RecordBatch:
            sequence, offset, document, start, length = zip(*placed, strict=True)
            numbers = [start, length, [len(raw) // 4 for _, raw in document], sequence, offset]
            tokens = [raw[4 * a : 4 * (a + n)] for (_, raw), a, n in zip(document, start, length, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in document], kind), *(pa.array(c, pa.int64()) for c in numbers), pa.array(tokens, pa.binary())], schema.names)

        for batch in chunks(batches, text="__text"):
            kind = batch.column(0).type
            placed: list = []
            for name, ids in zip(batch.column(0).to_pylist(), bpe.encode(texts_of(batch, "__text")), strict=True):
                raw = ids.astype("<u4").tobytes() + end
                placed += packer.add((name, raw), len(raw) // 4)
            if placed:
                yield rows(placed)
        if placed := packer.finish():
            yield rows(placed)

    return df.select(key, F.col(text).alias("__text")).mapInArrow(run, schema)


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 1: every piece of every document, with the checksum of its ids."""
    return pack_documents(documents(spark, sf_dir), vocabulary()).select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
