"""Operator 8: SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared in tiles of a fixed size: numpy takes the exclusive-or of every fingerprint
of one tile with every one of another and counts its bits. Which tiles meet is decided exactly.

* Two fingerprints within ``radius`` bits agree on one of ``radius + 1`` blocks of bits at least, so
  only fingerprints with an equal block, a *bucket*, are compared. Buckets stand one after the other,
  each sorted by population count, and are cut into tiles wherever a tile is full.
* Two tiles that hold parts of one bucket are compared unless their population counts there differ by
  more than the radius (as then any two fingerprints of theirs do).
* A bucket of more than ``crowd`` fingerprints is shared among tasks: it is cut by population count,
  and a population by hash, into crowds of about that size, and the same rule decides which meet.

So a bucket that holds a third of all fingerprints is work for many tasks, none of which holds more
than two crowds. Equal fingerprints are grouped before, and of the links within a stretch of tiles only
a spanning forest is kept, so copies are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, materialize, text_or_empty
from .components import components

WIDTH, SEED, RADIUS = 3, 42, 3

#: Fingerprints of a tile, and the most of one bucket that one task takes.
TILE, CROWD = 64, 2048

#: Pairs of tiles whose bits are in memory at once.
PAIRS_AT_ONCE = 256


def fingerprints_of(texts: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The SimHash of each UTF-8 text, as unsigned 64-bit numbers."""
    from functools import partial

    from xxhash import xxh64_intdigest

    digest = partial(xxh64_intdigest, seed=SEED)
    hashes: list[int] = []
    sizes = []
    for text in texts:
        words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
        before = len(hashes)
        if len(words) > width:
            hashes += map(digest, map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
        elif words:
            hashes.append(digest(b" ".join(words)))
        sizes.append(len(hashes) - before)
    n = np.array(sizes, np.int64)
    ones = np.zeros((len(texts), 64), np.int64)
    filled = np.flatnonzero(n)
    if len(filled):
        raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        first = np.cumsum(n) - n
        for bit in range(8):  # one plane of bits at a time keeps the unpacked hashes small
            ones[filled, bit::8] = np.add.reduceat((raw >> bit) & 1, first[filled], axis=0, dtype=np.int64)
    set_bits = 2 * ones > n[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel()


def simhash(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``key`` and ``fp`` (the fingerprint's 64 bits as a long) of every row; map-only.

    Null and empty texts have fingerprint 0; repeated rows and null keys are kept as they are.
    """
    schema = df.select(key).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text"):
            found = fingerprints_of(batch.column(1).cast(pa.binary()).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.astype(np.int64))], schema.names)

    return df.select(key, text_or_empty(text).alias("__text")).mapInArrow(run, schema)


class Runs(NamedTuple):
    """Fingerprints sorted by ``(run, population count)``. Of a run, all with ``side`` 0 are compared with
    each other; those with side 1 are compared with those with side 2."""

    run: np.ndarray
    side: np.ndarray
    fp: np.ndarray

    def cut(self, a: int, b: int | None = None) -> Runs:
        return Runs(*(x[a:b] for x in self))


class Links(NamedTuple):
    """Places ``(a, b)`` of near fingerprints, and how many pairs of tiles were compared and skipped."""

    a: np.ndarray
    b: np.ndarray
    compared: int
    skipped: int


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between places below ``n`` -> (member, root) edges that join the same places."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        low = low[low[root]]
        if (low == root).all():
            break
        root = low
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


def compare_tiles(runs: Runs, radius: int, tile: int = TILE) -> Links:
    """The near pairs of sorted runs, tile by tile; a forest of them for each distance of tiles."""
    n = len(runs.fp)
    count = -(-n // tile)
    first, last = np.arange(count) * tile, np.minimum(np.arange(1, count + 1) * tile, n) - 1
    pop = np.bitwise_count(runs.fp).astype(np.int16)
    pad = count * tile - n
    shaped = [np.concatenate([x, np.zeros(pad, x.dtype)]).reshape(count, tile) for x in (runs.fp, runs.run, runs.side)]
    real = (np.arange(count * tile) < n).reshape(count, tile)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    compared = skipped = apart = 0
    while apart < count:
        i = np.arange(count - apart)
        if apart:  # a run that both hold is the last of the first tile and the first of the second
            i = i[runs.run[last[i]] == runs.run[first[i + apart]]]
            if not len(i):
                break
            close = pop[first[i + apart]] - pop[last[i]] <= radius
            skipped += len(i) - int(close.sum())
            i = i[close]
        compared += len(i)
        for at in range(0, len(i), PAIRS_AT_ONCE):
            x = i[at : at + PAIRS_AT_ONCE]
            y = x + apart
            fp, run, side = ((s[x][:, :, None], s[y][:, None, :]) for s in shaped)
            near = np.bitwise_count(fp[0] ^ fp[1]) <= radius
            near &= (run[0] == run[1]) & ((side[0] == 0) | (side[0] != side[1])) & real[x][:, :, None] & real[y][:, None, :]
            if not apart:
                near &= np.tri(tile, k=-1, dtype=bool).T
            t, r, c = np.nonzero(near)
            a, b = x[t] * tile + r, y[t] * tile + c
            if len(a) > tile * len(x):
                lo = int(x[0]) * tile
                a, b = (z + lo for z in forest(int(y[-1] + 1) * tile - lo, a - lo, b - lo))
            out_a.append(a)
            out_b.append(b)
        apart += 1
    return Links(np.concatenate(out_a), np.concatenate(out_b), compared, skipped)


def _compare_runs(batches: Iterator[pa.RecordBatch], radius: int, tile: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(run, side, fp)`` sorted by run and population count -> edges ``(u, v)``."""
    held = Runs(np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.uint64))

    def edges(runs: Runs) -> Iterator[pa.RecordBatch]:
        links = compare_tiles(runs, radius, tile)
        if len(links.a):
            member, root = forest(len(runs.fp), links.a, links.b)
            yield pa.RecordBatch.from_arrays([pa.array(runs.fp[x].view(np.int64)) for x in (member, root)], ["u", "v"])

    for batch in batches:
        new = Runs(batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int8), batch.column(2).to_numpy().view(np.uint64))
        every = Runs(*(np.concatenate(x) for x in zip(held, new, strict=True)))
        whole = int(np.searchsorted(every.run, every.run[-1])) if len(every.run) else 0  # the last run may go on
        yield from edges(every.cut(0, whole))
        held = every.cut(whole)
    yield from edges(held)


def near_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, crowd: int = CROWD) -> DataFrame:
    """Distinct fingerprints ``fp`` -> edges ``(u, v)`` that span every component at ``radius``."""
    blocks = radius + 1
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    pieces = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) if hi - lo < 64 else F.col("fp") for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    member = fps.select("fp", F.bit_count("fp").alias("pop"), F.posexplode(F.array(*pieces)).alias("block", "bits"))
    cells = member.groupBy("block", "bits", "pop").agg(F.count("*").alias("n"))
    # Sizes decide how a bucket is cut; the groups are as many as the buckets, whatever their sizes.
    sizes = cells.groupBy("block", "bits").agg(F.sum("n").alias("total")).where("total > 1")
    big = cells.join(sizes.where(F.col("total") > crowd).select("block", "bits"), ["block", "bits"])
    crowds = big.select("block", "bits", "pop", F.ceil(F.col("n") / crowd).cast("int").alias("subs")).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    a = crowds.select("block", "bits", F.col("pop").alias("pop_a"), F.col("sub").alias("sub_a"))
    b = crowds.select("block", "bits", F.col("pop").alias("pop_b"), F.col("sub").alias("sub_b"))
    pairs = a.join(b, ["block", "bits"]).where((F.col("pop_b") - F.col("pop_a")).between(0, radius) & ((F.col("pop_b") > F.col("pop_a")) | (F.col("sub_b") >= F.col("sub_a"))))
    pairs = pairs.withColumn("run", F.xxhash64("block", "bits", "pop_a", "sub_a", "pop_b", "sub_b")).withColumn("self", F.expr("pop_a = pop_b and sub_a = sub_b"))
    left = pairs.select("block", "bits", F.col("pop_a").alias("pop"), F.col("sub_a").alias("sub"), "run", F.when(F.col("self"), 0).otherwise(1).alias("side"))
    right = pairs.where("not self").select("block", "bits", F.col("pop_b").alias("pop"), F.col("sub_b").alias("sub"), "run", F.lit(2).alias("side"))
    cut = crowds.select("block", "bits", "pop", "subs").distinct()
    in_crowds = member.join(cut, ["block", "bits", "pop"]).withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int"))
    large = in_crowds.join(left.union(right), ["block", "bits", "pop", "sub"]).select("run", "side", "fp", "pop")
    small = member.join(sizes.where(F.col("total") <= crowd).select("block", "bits"), ["block", "bits"]).select(F.xxhash64("block", "bits").alias("run"), F.lit(0).alias("side"), "fp", "pop")
    runs = small.union(large).repartition("run").sortWithinPartitions("run", "pop", "side", "fp").select("run", "side", "fp")
    return runs.mapInArrow(lambda batches: _compare_runs(batches, radius, tile), "u long, v long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE, crowd: int = CROWD) -> DataFrame:
    """``key, fp, component_id`` of every row.

    ``component_id`` is the least key that is reachable by links of up to ``radius`` differing bits.
    Null and empty texts share fingerprint 0 and are linked like any other; repeated rows share a
    component; a null key is never the least unless its component has no other; an empty table gives
    no rows; other columns are left out.
    """
    rows = materialize(simhash(df, key, text), "simhash")
    nodes = rows.groupBy("fp").agg(F.min(key).alias("low"))
    links = components(near_links(nodes.select("fp"), radius, tile, crowd))
    rooted = nodes.join(links.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = rooted.join(lowest, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select(key, "fp", "component_id")


def survivors(df: DataFrame, key: str = "doc_id", text: str = "text", find: Callable[[DataFrame, str, str], DataFrame] = near_duplicates) -> DataFrame:
    """The rows of ``df`` that a near-dedup keeps: of each component the one with the least key.

    ``find`` gives the ``component_id`` of every row.
    Rows that share a key are one document, of which one row stays. Rows with a null key can't be
    named; they stay unless every component has a named document.
    """
    found = materialize(find(df, key, text), "components")
    chosen = found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("__id")).distinct()
    kept = df.join(chosen, df[key].eqNullSafe(chosen["__id"]), "left_semi")
    if found.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty():
        return kept
    return kept.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(kept.where(F.col(key).isNull()))


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 8: fingerprint and component of every document."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
