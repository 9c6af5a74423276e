"""Operator 7: token counts through a digest cache.

A count is stored under the digest of the normalised content and the digest of the tokenizer's
version (its file and the settings in use). A run joins its digests to the stored counts, encodes
each distinct miss once, and appends the new counts to the cache.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, documents, materialize, new_folder, text_or_empty
from .tokenization import vocabulary

CACHE_SCHEMA = "digest binary, n_tokens long"
LIMIT = 1024


@lru_cache(maxsize=4)
def _counter(path: str):
    """A function from texts to token counts, one for each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def tokenizer_digest(path: str) -> str:
    """Names everything that a stored count depends on besides the text."""
    with open(path, "rb") as f:
        return hashlib.sha256(b"counts without added special tokens\0" + f.read()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """Stored ``(digest, n_tokens)``; a digest that two runs have appended counts once."""
    path = f"{cache}/tokenizer={tokenizer}"
    if not _exists(spark, path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(df: DataFrame, path: str, cache: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens`` of every row, and the cache brought up to date as a side effect.

    Only the distinct misses' texts are shuffled: the grouping by digest combines copies within each
    task first, so a text that a third of the rows share moves once a task. Content is normalised by
    taking null as empty, which no tokenizer can tell apart; anything more could change a count.
    Repeated rows share one count; null keys pass through; other columns are left out.
    """
    spark = df.sparkSession
    tokenizer = tokenizer_digest(path)
    content = text_or_empty(text)
    rows = df.select(key, content.alias("__text"), F.unhex(F.sha2(content, 256)).alias("digest"))
    distinct = rows.groupBy("digest").agg(F.any_value("__text").alias("__text"))
    known = _exists(spark, f"{cache}/tokenizer={tokenizer}")
    misses = distinct.join(read_cache(spark, cache, tokenizer), "digest", "left_anti") if known else distinct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in chunks(batches, "__text", 500_000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count(batch.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    misses.mapInArrow(run, CACHE_SCHEMA).write.mode("append").parquet(f"{cache}/tokenizer={tokenizer}")
    digests = df.select(key, F.octet_length(content).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest"))
    # Written out, the counts are a plain side of the join, whose hot digests can then be split.
    counts = materialize(read_cache(spark, cache, tokenizer), "counts")
    return digests.join(counts, "digest").select(key, "n_bytes", "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 7. The query's cache is its own and starts empty, so every run does all the work."""
    cache = new_folder(spark, "token-counts")
    counts = count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
