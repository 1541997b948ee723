"""Labelled texts for the two classifiers: a bounded sample, and scoring of whole tables in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._io import arrow_limits, free, spread


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key is in no fold."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(n))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_rows: int, max_chars: int) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of at most max_rows labelled documents of at most max_chars characters each, chosen in a fixed pseudo-random order.

    Only the chosen ids (at most max_rows) are broadcast. A chosen id gives one text, the smallest if several rows have it,
    so the driver holds max_rows * max_chars characters at most, however often an id recurs.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & learn)
        .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    rows = (
        docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
        .join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).collect()
    )
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return [r.text for r in rows], np.array([r.y for r in rows], np.int64)


def scored(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], name: str, text: str = "text") -> DataFrame:
    """docs, all columns kept, with the score of each row's whole text as last column `name` (with underscores behind it where docs have that name already)."""
    arrow_limits(docs.sparkSession)
    (name,) = free(docs, name)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(batch.column(at)), pa.float64())], [*batch.schema.names, name])

    return spread(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def accepted(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], least: float, text: str = "text") -> DataFrame:
    """The rows of docs, unchanged, whose score is at least `least`."""
    arrow_limits(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(at)) >= least))

    return spread(docs).mapInArrow(run, docs.schema)
