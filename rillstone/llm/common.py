"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize, new_folder, release, shared_dir  # noqa: F401

#: Columns that a pipeline stage hands on.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Characters of text that Python code unpacks at once, whatever the size of an Arrow batch.
CHUNK_CHARS = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``chars`` characters of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(name).to_pylist()]
