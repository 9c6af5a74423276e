"""Operator 5: Order MinHash fingerprints, in built-in functions only.

A text's items are its k-mers of words, one from each word on (the last ones are shorter), each with its
occurrence number, so a k-mer that comes twice is two items. A component of a fingerprint selects the two
minimal items under a hash order of its own, puts them back in text order and hashes the pair, so moving
text about changes components that a set-based MinHash keeps. (G. Marcais et al., "Locality-sensitive
hashing for the edit distance".)

Orders are turns of a few independent ones (one-permutation hashing): a *ring* holds all items by one
hash, and each of its equally spaced *places* selects the next two items. One sort a ring serves all its
places: they are sorted in with the items. An item is a long with 36 bits of hash above 28 bits of
position, so it sorts without a structure around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, release, text_or_empty
from .native import let, words

K, RINGS, PLACES = 3, 4, 16
POSITION_BITS = 28
POSITION = (1 << POSITION_BITS) - 1


def _item(hashed: Column, position: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~POSITION)).bitwiseOR(position)


def _position(item: Column) -> Column:
    """Positions count from 1, so that no item ends in zero bits only."""
    return item.bitwiseAND(F.lit(POSITION))


def _hash(item: Column) -> Column:
    return F.shiftright(item, POSITION_BITS)


def _kmers(items: Column, k: int) -> Column:
    """The k-mers from each word on, as items by position; an empty text has one, of no words."""
    many = F.size(items) >= POSITION
    hashed = F.when(many, F.raise_error(F.lit(f"a text of {POSITION} words and more"))).otherwise(F.transform(items, lambda w: F.xxhash64(w)))
    joined = lambda h: F.transform(h, lambda x, i: _item(F.xxhash64(x, *[F.get(h, i + n) for n in range(1, k)]), (i + 1).cast("long")))
    return let(hashed, lambda h: F.when(F.size(h) > 0, joined(h)).otherwise(F.array(_item(F.xxhash64(F.lit("")), F.lit(1).cast("long")))))


def _numbered(kmers: Column) -> Column:
    """Items whose hash takes the occurrence number in, where that is not the first."""
    sequence = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def body(s: Column) -> Column:
        fresh = lambda x, i: (i == 0) | (_hash(x) != _hash(F.get(s, i - 1)))
        again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~fresh(F.get(s, i), i))

        def renamed(at: Column) -> Column:
            # Places in ``at`` that follow on each other are the second, third ... of one k-mer.
            starts = F.filter(sequence(F.size(at)), lambda j: (j == 0) | (F.get(at, j) != F.get(at, j - 1) + 1))
            item = lambda i, n: _item(F.xxhash64(_hash(F.get(s, i)), n), _position(F.get(s, i)))
            run = lambda first, j, all_starts: F.slice(at, first + 1, F.coalesce(F.get(all_starts, j + 1), F.size(at)) - first)
            repeats = let(starts, lambda firsts: F.flatten(F.transform(firsts, lambda first, j: F.transform(run(first, j, firsts), lambda i, n: item(i, n + 1)))))
            return F.when(F.size(at) == 0, s).otherwise(F.concat(F.filter(s, fresh), repeats))

        return let(again, renamed)

    return let(F.sort_array(kmers), body)


def _components(items: Column, ring: int, places: int) -> Column:
    """What each place of a ring selects."""
    at_places = F.array(*[F.lit(-(1 << 63) + j * ((1 << 64) // places)).cast("long") for j in range(places)])
    turned = F.transform(items, lambda x: _item(F.xxhash64(_hash(x), F.lit(ring)), _position(x)))

    def select(s: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: _position(F.get(s, i)) == 0)

        def chosen(own: Column) -> Column:
            pair = lambda a, b: F.when(_position(a) <= _position(b), F.xxhash64(_hash(a), _hash(b))).otherwise(F.xxhash64(_hash(b), _hash(a)))
            pick = lambda place, j, n: F.get(own, F.pmod(place - j + n, F.size(own)))
            return F.transform(at, lambda place, j: pair(pick(place, j, 0), pick(place, j, 1)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))

        return let(F.filter(s, lambda x: _position(x) != 0), chosen)

    return let(F.sort_array(F.concat(turned, at_places)), select)


def fingerprint(text: Column, k: int = K, rings: int = RINGS, places: int = PLACES) -> Column:
    """An array of ``rings * places`` ints, whatever the text's length; k-mers of one ``k`` in all texts."""
    items = _numbered(_kmers(words(text), k))
    return let(items, lambda x: F.concat(*[_components(x, r, places) for r in range(rings)]))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda x, y: x + y) / F.size(a)


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 8, "0")), "")


def successors(keys: DataFrame, order: list[str]) -> DataFrame:
    """Rows that ``order`` tells apart, with ``next_*`` of these columns: the following row's, the first's after the last.

    Ranges are numbered by task and each finds its own successors; only the ranges' first rows, one
    for each task, meet in one place.
    """
    ranged = materialize(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    here = F.struct(*order)
    within = ranged.withColumn("__next", F.lead(here).over(Window.partitionBy("part").orderBy(*order)))
    firsts = ranged.groupBy("part").agg(F.min(here).alias("first"))
    every = Window.orderBy("part")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(every), F.first("first").over(whole)).alias("__after"))
    following = F.coalesce("__next", "__after")
    found = within.join(firsts, "part").select(*keys.columns, *[following[c].alias(f"next_{c}") for c in order])
    out = materialize(found, "next")
    release(ranged)
    return out


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp`` of every row: the fingerprint of its whole text, null as empty. No shuffle."""
    return df.select(key, fingerprint(text_or_empty(text)).alias("fp"))


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The edited text has its last half replaced by the start of the next document's. A null key counts
    as the least; rows that share a key are ordered by their texts' hashes, and rows that agree in
    both are one document with equal results, of which every row is returned. Null texts are empty; an
    empty table gives no rows; a lone document is its own next; other columns are left out.

    Every distinct text is shuffled once, and the starts of texts that edited texts need once more.
    """
    lowest, order = F.lit(-(1 << 63)).cast("long"), ["id", "th"]
    rows = df.select(F.coalesce(F.col(key).cast("long"), lowest).alias("id"), text_or_empty(text).alias("t"))
    rows = rows.select("id", F.xxhash64("t").alias("th"), "t")
    own = materialize(rows.select(*order, F.char_length("t").cast("long").alias("n_chars"), fingerprint(F.col("t")).alias("fp")), "fingerprints")
    following = successors(own.select(*order, "n_chars").distinct(), order)
    # The previous document of each: where its text's start is needed, and how much of it.
    before = following.select(F.col("next_id").alias("id"), F.col("next_th").alias("th"), F.col("id").alias("to_id"), F.col("th").alias("to_th"), F.expr("n_chars div 2").cast("int").alias("take"))
    known = own.groupBy(*order).agg(F.any_value("fp").alias("fp"), F.any_value("n_chars").alias("n_chars"), F.count("*").cast("int").alias("copies"))
    placed = rows.dropDuplicates(order).join(known.join(before, order), order)
    tails = placed.select(F.col("to_id").alias("id"), F.col("to_th").alias("th"), F.substring("t", F.lit(1), F.col("take")).alias("tail"), F.col("fp").alias("next_fp"))
    half = (F.col("n_chars") - F.expr("n_chars div 2")).cast("int")
    edited = placed.join(tails, order).withColumn("e", F.concat(F.substring("t", F.lit(1), half), "tail"))
    found = edited.select(F.when(F.col("id") != lowest, F.col("id")).alias(key), "n_chars", F.sha2("e", 256).alias("edited_sha256"), "fp", fingerprint(F.col("e")).alias("edited_fp"), "next_fp", "copies")
    return found.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 5."""
    found = edited_fingerprints(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
