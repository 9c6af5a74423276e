"""Near-duplicate texts: five-word shingles, Jaccard similarity of 0.8 and more.

At that similarity 64-bit SimHashes differ in 10 bits on average and in up to 20, so a radius that
held all such pairs would hold unrelated texts too. MinHash bands choose the pairs here: of 48 bands
of 5 values, three at least agree but for 1.5 in a million of the pairs at 0.8 (fewer above it), so
texts with fewer bands that others have as well are out. What is linked is decided by the exact
similarity of the shingle sets, in two rounds.

1. The texts of a band form a group, of bands that hold the same most crowded text one group, and meet its
   *hub*. That is the most crowded text or, in a group of ``CROWD`` texts and more, the one that lacks the
   least of the group's *reference*: the shingles that most of its texts have.
2. What the links so far leave apart meets in pairs within a small group. In a large one, links that go past
   a hub are found by what the texts have beside the reference or lack of it. Texts of
   n and m shingles are alike if they share 4/9 (n + m). If some of these are not in the reference, one
   is among the first of each text's own shingles, in the order of hashes, and neither text may have so
   many before it that too few are left. If all are in the reference, they lack so much of the same that
   one missing shingle is among the first of both; or they lack so little that both are alike the hub.
   Copies of a text with edits of their own thus make no pairs, however many they are, unless their edits
   agree.

Pairs within a component can't change it and are left out, so copies make no pairs either.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialize, release, text_or_empty
from .components import components
from .simhash import fingerprints_of, near_links

WIDTH, BANDS, ROWS, SEED = 5, 48, 5, 42

#: Bands that alike texts share at the least.
SHARED_BANDS = 3

CHUNK_CHARS = 500_000

#: Texts of a group that is searched by a reference; in smaller ones all may meet.
CROWD = 16

#: Shingles before one that go with it, by which a pair is seen to have met already.
BEFORE = 4

#: 64-bit words of the bit maps that are sent ahead of joins.
MAP_WORDS = 1 << 16

_RANDOM = np.random.default_rng(SEED)
TURNS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
FACTORS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
MIX = _RANDOM.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
BAND_SEEDS = _RANDOM.integers(0, 1 << 64, BANDS, np.uint64)


def shingles_of(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; fewer than ``width`` words are one shingle."""
    from xxhash import xxh64_intdigest

    digest = partial(xxh64_intdigest, seed=SEED)
    out = []
    for text in texts:
        words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
        if len(words) > width:
            hashes = list(map(digest, map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))))
        else:
            hashes = [digest(b" ".join(words))] if words else []
        out.append(np.unique(np.array(hashes, np.uint64)))
    return out


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """``BANDS`` hashes of each set; those of empty sets are 0."""
    n = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), BANDS), np.uint64)
    filled = np.flatnonzero(n)
    if len(filled):
        every = np.concatenate([sets[i] for i in filled])
        first = np.cumsum(n[filled]) - n[filled]
        least = np.stack([np.minimum.reduceat((every ^ t) * f, first) for t, f in zip(TURNS, FACTORS, strict=True)], axis=1)
        mixed = (least.reshape(-1, BANDS, ROWS) >> np.uint64(7)) * MIX
        mixed = (mixed ^ (mixed >> np.uint64(32))).sum(axis=2, dtype=np.uint64) ^ BAND_SEEDS
        out[filled] = mixed * FACTORS[0]
    return out


def _lists(rows: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(rows.view(np.int64))).cast(pa.list_(pa.int64()))


def _hash_of(items: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(items.tobytes(), seed=SEED)


def shingled(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``key``, a row number, the text's hash, the shingle set's hash and size, its bands, and the SimHash of the
    text; map-only."""
    schema = df.select(key).schema.add("rid", "long").add("th", "long").add("node", "long").add("n", "integer").add("bands", T.ArrayType(T.LongType())).add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text", CHUNK_CHARS):
            texts = batch.column(3).cast(pa.binary()).to_pylist()
            sets, fp = shingles_of(texts, width), fingerprints_of(texts)
            node = np.array([_hash_of(s) for s in sets], np.uint64).view(np.int64)
            n = np.array([len(s) for s in sets], np.int32)
            bands = _lists(np.ascontiguousarray(bands_of(sets)).ravel(), np.arange(len(sets) + 1) * BANDS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(node), pa.array(n), bands, pa.array(fp.view(np.int64))], schema.names)

    full = text_or_empty(text)
    return df.select(key, F.monotonically_increasing_id().alias("rid"), F.xxhash64(full).alias("th"), full.alias("__text")).mapInArrow(run, schema)


def _likely(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``df`` without most of the rows whose ``key``, a hash, is not among ``wanted``.

    A bit map of fixed size says so before a row is sent; the exact join comes behind it.
    """
    word = F.pmod(F.shiftright(key, 6), F.lit(MAP_WORDS)).alias("__word")
    bit = F.expr(f"shiftleft(1L, cast({key} & 63 as int))")
    words = wanted.groupBy(word).agg(F.bit_or(bit).alias("__map"))
    return df.withColumn("__word", word).join(F.broadcast(words), "__word").where(F.col("__map").bitwiseAND(bit) != 0).drop("__word", "__map")


def _items_of(df: DataFrame, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """``node, items``: the shingle sets of the ``wanted`` rows ``(node, th)``.

    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text", CHUNK_CHARS):
            sets = shingles_of(batch.column(1).cast(pa.binary()).to_pylist(), width)
            node = np.array([_hash_of(s) for s in sets], np.uint64).view(np.int64)
            items = _lists(np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), items], ["th", "node", "items"])

    full = text_or_empty(text)
    likely = _likely(df.select(F.xxhash64(full).alias("th"), full.alias("__text")), wanted, "th").select("th", "__text")
    found = likely.mapInArrow(run, "th long, node long, items array<long>")
    # A node is wanted from one text, so equal rows are copies of that.
    return found.join(wanted, ["th", "node"], "left_semi").dropDuplicates(["th", "node"]).select("node", "items")


def _alike(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` whose sets have a Jaccard similarity of 0.8 and more."""
    left = items.select(F.col("node").alias("u"), F.col("items").alias("a"))
    right = items.select(F.col("node").alias("v"), F.col("items").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    # shared / (a + b - shared) >= 4 / 5
    return pairs.join(left, "u").join(right, "v").where(9 * shared >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def _near_size(a: str, b: str) -> Column:
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _ends(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def _compared(met: DataFrame, items: DataFrame) -> DataFrame:
    """Texts of large groups ``(c, node, n)`` -> the same with ``nc, m``, the reference's size and what the
    text lacks of it, and the first shingles ``beside`` it and of those that it ``lacks``."""
    sizes = met.groupBy("c").agg(F.count("*").alias("k"))
    held = materialize(met.join(items.select("node", F.col("items").alias("x")), "node"), "held")
    common = held.select("c", F.explode("x").alias("item")).groupBy("c", "item").agg(F.count("*").alias("times"))
    common = common.join(sizes, "c").where("2 * times > k").groupBy("c").agg(F.sort_array(F.collect_list("item")).alias("y"))
    # A group without common shingles has an empty reference.
    references = materialize(sizes.select("c").join(common, "c", "left").select("c", F.coalesce("y", F.array().cast("array<long>")).alias("y")), "references")
    both = held.join(references, "c")
    both = both.select("c", "node", "n", F.size("y").alias("nc"), F.array_except("x", "y").alias("beside"), F.array_except("y", "x").alias("lacks")).withColumn("m", F.size("lacks"))
    # An alike text holds 4/5 of the shingles at least, so one of the first n - ceil(4 n / 5) + 1.
    first_own = F.slice("beside", F.lit(1), F.expr("cast(n - (4 * n + 4) div 5 + 1 as int)"))
    # The other text has 4/5 to 5/4 of n shingles; all that it shares is in the reference, or this is of no use.
    first_lacks = F.slice("lacks", F.lit(1), F.when(F.expr("5 * (nc - m) >= 4 * n"), F.expr("cast(greatest(0, least(nc - 4 * n / 5, 9 * n / 20)) + 1 as int)")).otherwise(0))
    out = materialize(both.select("c", "node", "n", "nc", "m", first_own.alias("beside"), first_lacks.alias("lacks")), "compared")
    for done in (held, references):
        release(done)
    return out


def _past_hubs(compared: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` of texts of a large group that are in different components and may be alike."""
    rooted = compared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def placed(shingles: str) -> Column:
        """Each shingle with its place and those just before it."""
        return F.inline(F.transform(shingles, lambda x, i: F.struct(i.alias("at"), x.alias("item"), F.slice(shingles, F.greatest(i - (BEFORE - 1), F.lit(1)), F.least(i, F.lit(BEFORE))).alias("before"))))

    beside = rooted.select("c", "node", "root", "n", F.lit(0).alias("m"), F.lit(0).alias("nc"), F.col("n").alias("held"), F.lit(False).alias("lack"), placed("beside"))
    lacks = rooted.select("c", "node", "root", "n", "m", "nc", F.col("m").alias("held"), F.lit(True).alias("lack"), placed("lacks"))
    entries = materialize(beside.union(lacks).withColumn("left", F.col("held") - F.col("at")).drop("held", "at"), "entries")
    by = ["c", "lack", "item"]
    several = entries.groupBy(*by).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(*by)
    a, b = (entries.join(several, by).select(*by, *[F.col(c).alias(c + s) for c in ("node", "n", "root", "m", "nc", "left", "before")]) for s in "ab")
    enough = F.expr("9 * least(lefta, leftb) >= 4 * (na + nb) + 9 * (ma + mb - nca)")
    apart = (F.col("nodea") < F.col("nodeb")) & (F.col("roota") != F.col("rootb"))
    # A pair that shares an earlier shingle has met there; the first that it shares is what must be enough.
    pairs = a.join(b, by).where(apart & _near_size("na", "nb") & enough & ~F.arrays_overlap("beforea", "beforeb"))
    out = materialize(pairs.select(*_ends("nodea", "nodeb")).distinct(), "pairs")
    release(entries)
    return out


def _small_pairs(met: DataFrame, roots: DataFrame) -> DataFrame:
    """All pairs ``(u, v)`` within small groups of texts in different components."""
    rooted = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    a, b = (rooted.select("c", *[F.col(x).alias(x + s) for x in ("node", "n", "root")]) for s in "ab")
    return a.join(b, "c").where((F.col("nodea") < F.col("nodeb")) & (F.col("roota") != F.col("rootb")) & _near_size("na", "nb")).select(*_ends("nodea", "nodeb"))


def _by_fingerprints(rows: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of the nodes that op8's way links, SimHash fingerprints compared by tiles.

    Nodes of one fingerprint meet the least of them, and the least ones those of near fingerprints.
    """
    # A node may have several fingerprints, as its texts may differ in how often they repeat a shingle.
    held = materialize(rows.select("fp", "node").distinct(), "fingerprints")
    least = held.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("k"))
    same = held.join(least.where("k > 1"), "fp").where("node > least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    near = near_links(held.select("fp").distinct()).withColumnsRenamed({"u": "a", "v": "b"})
    left, right = (least.select(F.col("fp").alias(fp), F.col("least").alias(node)) for fp, node in (("a", "x"), ("b", "y")))
    met = near.join(left, "a").join(right, "b").where("x <> y").select(*_ends("x", "y"))
    return materialize(same.union(met).distinct(), "near_fingerprints")


def near_texts(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, fingerprints: bool = False) -> DataFrame:
    """``key, component_id`` of every row.

    ``component_id`` is the least key that is reachable by links of similarity 0.8 and more. Null and
    empty texts are linked to each other only; keys are taken as in ``near_duplicates``. With ``fingerprints`` the
    pairs that op8's SimHash fingerprints link are met and checked first.
    """
    rows = materialize(shingled(df, key, text, width), "shingles")
    nodes = materialize(rows.groupBy("node").agg(F.min(key).alias("low"), F.min(F.struct("rid", "th")).alias("first")).select("node", "low", "first.*"), "nodes")
    member = rows.select("rid", "node", "n", "bands").join(nodes.select("rid"), "rid", "left_semi").where("n > 0").select("node", "n", F.explode("bands").alias("band"))
    # One shuffle of all bands, which grows as the input does.
    every = materialize(member.withColumn("k", F.count("*").over(Window.partitionBy("band"))).where("k > 1"), "crowds")
    score = every.groupBy("node").agg(F.sum("k").alias("score"), F.count("*").alias("bands")).where(F.col("bands") >= SHARED_BANDS).select("node", "score")
    banded = materialize(every.join(score, "node"), "banded")
    groups = materialize(banded.groupBy("band").agg(F.max(F.struct("score", "node")).alias("c")).select("band", F.col("c.node").alias("c")), "groups")
    met = materialize(banded.select("node", "n", "band").join(groups, "band").select("node", "n", "c").distinct(), "met")
    asked, by_fps = met.select("node"), None
    if fingerprints:
        by_fps = _by_fingerprints(rows)
        asked = asked.union(by_fps.select("u")).union(by_fps.select("v"))
    wanted = materialize(nodes.select("node", "th").join(asked.distinct(), "node", "left_semi"), "wanted")
    items = materialize(_items_of(df, text, width, wanted), "items")
    sizes = materialize(met.groupBy("c").agg(F.count("*").alias("k")), "sizes")
    small, large = (met.join(sizes.where(cond).select("c"), "c") for cond in (F.col("k") < CROWD, F.col("k") >= CROWD))
    compared = _compared(large, items)
    hubs = compared.groupBy("c").agg(F.min(F.struct((9 * F.col("m") + 4 * F.col("n")).alias("o"), "node", "n")).alias("h")).select("c", F.col("h.node").alias("hub"), F.col("h.n").alias("hn"))
    hubs = hubs.union(small.where("node = c").select("c", F.col("node").alias("hub"), F.col("n").alias("hn")))
    stars = met.join(materialize(hubs, "hubs"), "c").where((F.col("node") != F.col("hub")) & _near_size("n", "hn")).select(*_ends("node", "hub"))
    stars = (stars.union(by_fps) if fingerprints else stars).distinct()
    first = materialize(_alike(stars, items), "links")
    roots = components(first)
    rest = _past_hubs(compared, roots).union(_small_pairs(small, roots)).distinct()
    found = components(first.union(materialize(_alike(rest, items), "links")))
    for done in (every, banded, groups, met, wanted, items, sizes, compared):
        release(done)

    rooted = nodes.join(found, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    labels = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "component_id")
    return rows.select(key, "node").join(labels, "node").select(key, "component_id")
