"""Operator 10: BPE encoding and decoding of a documents table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .bpe_automaton import codec
from .common import chunks, documents, texts_of


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(df: DataFrame, path: str, decode: bool = False, as_text: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, the text's ``ids`` and, if asked for, the ``decoded`` text of these ids.

    ``ids`` is an array of int, or with ``as_text`` the decimal ids with spaces between.

    Map-only: no shuffle, and a worker holds one chunk of texts and a bounded store of words. Null
    texts count as empty (no ids, decoded text empty); rows that repeat are encoded each; null keys
    pass through; other columns, whatever their names, are left out.
    """
    schema = df.select(key).schema.add("n_tokens", "long").add("ids", StringType() if as_text else ArrayType(IntegerType()))
    if decode:
        schema = schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in chunks(batches, text="__text"):
            ids = bpe.encode(texts_of(batch, "__text"))
            columns = [batch.column(0), pa.array(map(len, ids), pa.int64())]
            columns.append(pa.array([" ".join(map(bpe.decimals.__getitem__, x.tolist())) for x in ids], pa.string()) if as_text else pa.array(ids, pa.list_(pa.int32())))
            if decode:
                columns.append(pa.array(list(map(bpe.decode, ids)), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.select(key, F.col(text).alias("__text")).mapInArrow(run, schema)


def decode_documents(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and the ``decoded`` text of arrays of ids; null arrays count as empty."""
    schema = df.select(key).schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = codec(path).labels
        for batch in batches:
            texts = [" ".join(map(labels.__getitem__, x or ())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema.names)

    return df.select(key, ids).mapInArrow(run, schema)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 10: sizes and digests of each document's ids and decoded text."""
    coded = encode_documents(documents(spark, sf_dir), vocabulary(), decode=True, as_text=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
