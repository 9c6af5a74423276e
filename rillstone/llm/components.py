"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join (R. Kiveris et al., "Connected Components in MapReduce and
Beyond"). A node that very many edges touch is dealt out by a salt: its edges and partial minima go to
``SALTS`` groups, and only these groups' minima, at most ``SALTS`` rows, meet by node. The edges are
written to the shared folder after each round, which cuts the lineage; nothing but a count and a
checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


#: Groups that the edges of one node are dealt out to.
SALTS = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """``u, v`` with ``m``, the least v of the same u."""
    salted = edges.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(SALTS)).alias("salt"))
    groups = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = groups.groupBy("u").agg(F.min("m").alias("m"))
    return salted.join(groups.select("u", "salt").join(least, "u"), ["u", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger node u to the smaller v."""
    found = _with_least(edges)
    return found.select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` edges of long nodes -> ``(node, root)`` for every node but the roots.

    The root is a component's least node. Edges may repeat, point either way, or loop; null ends are
    ignored; no edges give no rows.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "edges")
    state = _state(now)
    while state[0]:
        new = materialize(_small_star(_large_star(now)).distinct(), "edges")
        after = _state(new)
        release(now)
        now, done = new, after == state
        if done:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
