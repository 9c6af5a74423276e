"""The corpus pipeline: quality rules, line dedup, near-dedup, secret redaction, packing.

Every stage takes all that the one before kept. All but the last return the columns of ``documents``;
the last returns the packed pieces. Every stage takes the columns of ``documents`` by name, leaves others
out, whatever their names, and gives an empty table for an empty one.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm.common import DOCUMENT_COLUMNS, documents, materialize
from rillstone.llm.line_dedup import remove_boilerplate
from rillstone.llm.native import computed
from rillstone.llm.near_texts import near_texts
from rillstone.llm.packing import pack_documents
from rillstone.llm.quality import judge
from rillstone.llm.secrets import redact_secrets
from rillstone.llm.simhash import survivors
from rillstone.llm.tokenization import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others, lines that break a rule.

    Null and empty texts have no words and go; repeated rows are judged each.
    """
    judged = computed(judge(docs.select(*DOCUMENT_COLUMNS)), "kept", "clean_text").where("kept")
    return _with_text(judged, F.col("clean_text"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go, and documents of which nothing else is left.

    Null texts have no lines and stay, as do texts without a line that is removed; null sites are one
    more site; repeated rows are treated alike.
    """
    cleaned = remove_boilerplate(docs.select(*DOCUMENT_COLUMNS))
    return _with_text(cleaned.where("n_removed = 0 or text rlike '[^\\\\s]'"), F.col("text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts of similarity 0.8 and more stays: the one with the least doc_id.

    Pairs come from op8's SimHash fingerprints, compared by tiles, and from MinHash bands, which find those that
    differ in more than three bits; the exact similarity decides.
    Null and empty texts are one group; of rows that share a doc_id one stays; rows without a doc_id
    stay unless every group has a document with one.
    """
    return survivors(docs.select(*DOCUMENT_COLUMNS), find=partial(near_texts, fingerprints=True))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays, null and empty texts as they are."""
    return redact_secrets(docs.select(*DOCUMENT_COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids; null and empty texts are the end id alone."""
    return pack_documents(docs, vocabulary())


def _with_text(df: DataFrame, text) -> DataFrame:
    changed = df.withColumn("__text", text)
    return changed.select("doc_id", F.col("__text").alias("text"), "lang", "source", F.char_length("__text").cast("long").alias("n_chars"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL can express neither the components of near-dedup nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
