"""Join-like and set-like operators, on windows, grouped folds and equality joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cidr, mask_of
from ..types import FLOW_KEY
from .ranges import row_numbers


def as_of(records: DataFrame, definitions: DataFrame, keys: Sequence[str], clock: str, columns: Sequence[str]) -> DataFrame:
    """Records with the latest earlier definition of their key: ``columns`` and ``generation``.

    One union, one shuffle by key, one sort; definitions before a record are seen by a running
    ``last``. A null ``generation`` means that the key was unknown then.
    """
    packed = F.struct(*columns)
    defs = definitions.select(*keys, F.col(clock), packed.alias("__def"), F.lit(0).alias("__kind"), F.lit(None).cast(records.select(F.struct("*")).schema[0].dataType).alias("__row"))
    rows = records.select(*keys, F.col(clock), F.lit(None).cast(defs.schema["__def"].dataType).alias("__def"), F.lit(1).alias("__kind"), F.struct("*").alias("__row"))
    seen = Window.partitionBy(*keys).orderBy(clock, "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = defs.unionByName(rows).withColumn("__found", F.last("__def", ignorenulls=True).over(seen)).withColumn("__gen", F.count("__def").over(seen))
    out = both.where("__kind = 1").select("__row.*", *[F.col("__found")[c].alias(c) for c in columns], F.when(F.col("__found").isNotNull(), F.col("__gen")).alias("generation"))
    return out


def longest_prefix(df: DataFrame, address: str, prefixes: DataFrame) -> DataFrame:
    """``df`` with ``prefix_len`` and ``label`` of the longest prefix that holds the address, or nulls.

    ``prefixes`` is ``base, prefix_len, label``. There are at most 33 lengths, so an address becomes
    one masked value for each length in use and meets the prefixes by equality.
    """
    lengths = sorted(r[0] for r in prefixes.select("prefix_len").distinct().collect())  # at most 33
    if not lengths:
        return df.withColumns({"prefix_len": F.lit(None).cast("int"), "label": F.lit(None).cast("string")})
    masked = F.array(*[F.struct(F.lit(n).alias("prefix_len"), F.col("__a").bitwiseAND(F.lit(mask_of(n)).cast("long")).alias("base")) for n in lengths])
    each = df.select(F.col(address).alias("__a")).distinct().select("__a", F.explode(masked).alias("m"))
    met = each.select("__a", "m.prefix_len", "m.base").join(prefixes, ["prefix_len", "base"])
    best = met.groupBy("__a").agg(F.max_by("label", "prefix_len").alias("label"), F.max("prefix_len").alias("prefix_len"))
    return df.join(best, df[address] == best["__a"], "left").drop("__a")


def prefix_rows(texts: Sequence[str]) -> list[tuple[int, int, str]]:
    """Rows ``base, prefix_len, label`` of prefixes in text form."""
    return [(*cidr(t), t) for t in texts]


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Half-open intervals merged where they overlap or touch: ``keys, start, end``."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.where(F.col(end) > F.col(start)).withColumn("__new", F.coalesce(F.col(start) > before, F.lit(True)).cast("int"))
    numbered = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("__island")


def coverage(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``covered`` units, and ``prefix``: how far coverage reaches from 0 without a hole."""
    return merged.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.coalesce(F.max(F.when(F.col("start") == 0, F.col("end"))), F.lit(0).cast("long")).alias("prefix"))


def gaps(merged: DataFrame, keys: Sequence[str], limit: Column | int) -> DataFrame:
    """Holes below ``limit``: ``keys, start, length``; what lies before the first interval counts."""
    bound = limit if isinstance(limit, Column) else F.lit(limit).cast("long")
    order = Window.partitionBy(*keys).orderBy("start")
    marked = merged.withColumn("__from", F.coalesce(F.lag("end").over(order), F.lit(0).cast("long"))).withColumn("__last", F.lead("start").over(order).isNull())
    inner = marked.select(*keys, F.col("__from").alias("a"), F.least("start", bound).alias("b"))
    tail = marked.where("__last").select(*keys, F.col("end").alias("a"), bound.alias("b"))
    return inner.union(tail).where("b > a").select(*keys, F.col("a").alias("start"), (F.col("b") - F.col("a")).alias("length"))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> tuple[Column, Column]:
    """Start and end of the intersection of two half-open spans; nulls if there is none."""
    lo, hi = F.greatest(a0, b0), F.least(a1, b1)
    return F.when(lo < hi, lo), F.when(lo < hi, hi)


def overlap_decision(policy: str, a0: Column, a1: Column, b0: Column, b1: Column, consistent: Column) -> Column:
    """What to do with new span b over old span a: take_new, keep_old, take_tail or conflict."""
    disjoint = F.greatest(a0, b0) >= F.least(a1, b1)
    out = F.when(disjoint, "take_new").when(consistent, F.when(b1 > a1, "take_tail").otherwise("keep_old"))
    if policy == "first_wins":
        return out.otherwise("keep_old")
    if policy == "last_wins":
        return out.otherwise("take_new")
    if policy == "strict":
        return out.otherwise("conflict")
    raise ValueError(f"no policy {policy!r}")


def intern(df: DataFrame, name: str, ord: str) -> DataFrame:
    """``name, id``: dense numbers from 0 in order of first appearance.

    Names are numbered within ranges of their first places; only the ranges' sizes, a row for each
    task, meet in one place.
    """
    first = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(ord).alias("__first"))
    placed = first.select(name, F.struct("__first", name).alias("__at"))
    return row_numbers(placed, [], "__at", "id").select(name, (F.col("id") - 1).alias("id"))


def bitset_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def bitset_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def latest_by_key(df: DataFrame, key: str, value: str, ord: str) -> DataFrame:
    """The index after all inserts: each key under its last value."""
    return df.groupBy(key).agg(F.max_by(value, ord).alias(value))


def point(index: DataFrame, value: str, at: int) -> DataFrame:
    return index.where(F.col(value) == at)


def value_range(index: DataFrame, value: str, lo: int, hi: int) -> DataFrame:
    return index.where(F.col(value).between(lo, hi))


def flow_digest(keys: Sequence[str] = FLOW_KEY) -> Column:
    """A 64-bit digest of the key columns for grouping and salting."""
    return F.xxhash64(*keys)
