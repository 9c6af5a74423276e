"""Operator 4: boilerplate lines by their spread over distinct sites, in built-in functions only.

1. Lines are hashed (96 bits). A grouped minimum and maximum of the site's hash, combined before the
   shuffle, drops every line that one site alone has, which is nearly all of them.
2. The occurrences of the rest are written out once, and combined to one row for each line and site.
   HyperLogLog sketches of the sites merge by aggregation into one for each line.
3. Lines whose estimate is near the threshold get an exact distinct count.
4. A line that at least ``min_sites`` sites have is boilerplate: it goes from every document but the
   one with the least doc_id, so that no content is lost altogether.

A line that a third of all documents have is a skewed join, which adaptive execution splits; no group
is ever collected but the boilerplate lines within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, text_or_empty

MIN_SITES = 10

#: log2 of the sketches' registers: a standard error of 1.6 %.
LG_K = 12

#: Estimates within this share of the threshold are counted exactly: six standard errors.
NEAR = 0.1

LINE = ["h", "g"]

#: Parts that a document's removed lines are dealt to.
SLOTS = 64


def line_key(line: Column) -> list[Column]:
    """A line's identity: 96 bits of hash of the line without blanks at its ends."""
    return [F.xxhash64(line).alias("h"), F.hash(line).alias("g")]


def boilerplate(occurrences: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """Rows ``h, g, site, doc_id`` -> the lines ``h, g, home`` that at least ``min_sites`` sites have.

    Rows are combined to one for each line and site first, so a line that all documents have is no more
    than its sites to what follows.
    """
    sites = materialize(occurrences.groupBy(*LINE, "site").agg(F.min("doc_id").alias("doc_id")), "sites")
    estimates = sites.groupBy(*LINE).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("estimate"), F.min("doc_id").alias("home"))
    margin = max(1.0, near * min_sites)
    sure = estimates.where(F.col("estimate") > min_sites + margin).select(*LINE, "home")
    close = estimates.where(F.col("estimate").between(min_sites - margin, min_sites + margin)).select(*LINE, "home")
    counted = sites.join(close.select(*LINE), LINE).groupBy(*LINE).agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.union(close.join(counted.select(*LINE), LINE))


def remove_boilerplate(df: DataFrame, min_sites: int = MIN_SITES, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """``df`` with ``text`` without cross-site boilerplate, and ``n_lines``, ``n_removed`` (long).

    Null texts have no lines and stay null; lines without a character other than blanks are never
    removed; null sites count as one more site; a document without removed lines is unchanged. Rows
    that share a key share their fate: a line's home is the least key that has it, null if no other.
    """
    lines = df.select(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(site, F.lit(""))).alias("site"), F.explode(F.array_distinct(F.transform(F.split(text_or_empty(text), "\n"), lambda x: F.trim(x)))).alias("line"))
    lines = lines.where("line <> ''").select(*line_key(F.col("line")), "site", "doc_id")
    spread = lines.groupBy(*LINE).agg(F.min("site").alias("lo"), F.max("site").alias("hi")).where("lo <> hi" if min_sites > 1 else "true")
    # Written out, both sides of the joins are plain shuffles, whose hot lines can be split.
    spread = materialize(spread.select(*LINE), "spread")
    occurrences = materialize(lines.join(spread, LINE), "lines")
    found = materialize(boilerplate(occurrences, min_sites), "boilerplate")
    hits = occurrences.join(found, LINE).where(~F.col("doc_id").eqNullSafe(F.col("home")))
    gone = hits.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(F.struct("h", "g")).alias("__all"))
    # Dealt to slots by hash, so that a line is looked up among few whatever the document has lost.
    slot = lambda x: F.pmod(x, F.lit(SLOTS)).cast("int")
    gone = gone.select("__id", F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.filter("__all", lambda x: slot(x["h"]) == i)).alias("__gone"))
    joined = df.join(gone, df[key].eqNullSafe(gone["__id"]), "left").drop("__id")
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.get("__gone", slot(F.xxhash64(F.trim(x)))), F.struct(*line_key(F.trim(x)))))
    n_lines = F.coalesce(F.size(F.split(text, "\n")).cast("long"), F.lit(0).cast("long"))
    counted = joined.withColumn("__kept", F.when(F.col("__gone").isNotNull() & F.col(text).isNotNull(), kept)).withColumn("n_lines", F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(n_lines))
    counted = counted.withColumn("n_removed", F.when(F.col("__kept").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines") - F.size("__kept")))
    return counted.withColumn(text, F.when(F.col("__kept").isNull(), F.col(text)).otherwise(F.array_join("__kept", "\n"))).drop("__kept", "__gone")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after cross-site boilerplate removal."""
    return remove_boilerplate(documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "text", "n_lines", "n_removed")


OP4_SQL = f"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents
), b AS (
  SELECT trim(line, ' ') AS line, min(doc_id) AS home
  FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT site) >= {MIN_SITES}
), k AS (
  SELECT l.doc_id, l.line, l.pos, b.line IS NOT NULL AND l.doc_id <> b.home AS gone
  FROM l LEFT JOIN b ON trim(l.line, ' ') = b.line
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
       count(*) AS n_lines, count(*) FILTER (gone) AS n_removed
FROM k GROUP BY doc_id
"""
