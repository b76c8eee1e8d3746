"""Readers for text corpora and prepared term counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions.text import split_lines, trim_control
from themeloom.plans.numbering import dense_index
from themeloom.plans.scratch import Scratch
from themeloom.sources.listing import file_uri, list_files


def read_corpus(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One document per file, trimmed: (path, text). ``paths`` may hold globs.

    Spark packs many small files into one partition up to
    ``spark.sql.files.maxPartitionBytes``.
    """
    return whole_files(spark, paths).select("path", trim_control(F.col("text")).alias("text"))


def whole_files(spark: SparkSession, paths: str | list[str], empty: bool = True) -> DataFrame:
    """One row per file, untouched: (path, text).

    Spark's readers pass over empty files. An empty file is a document too, so their
    names are taken from a listing that executors make; ``empty=False`` spares it, for
    stores that pyarrow cannot open.
    """
    paths = [paths] if isinstance(paths, str) else paths
    files = spark.read.text(paths, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if not empty:
        return rows
    none = list_files(spark, paths).filter("size = 0").select("path").distinct().mapInArrow(as_uris, "path STRING")
    return rows.unionAll(none.select("path", F.lit("").alias("text")))


def as_uris(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = pa.array([file_uri(path) for path in batch.column(0).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([names], names=["path"])


def corpus_from_table(table: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents of a table, trimmed: (doc_id, text)."""
    _require(table, doc_id, text)
    return table.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), trim_control(F.col(text)).alias("text")
    )


def read_token_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One token per line, order kept: (doc_id, pos, term)."""
    return explode_words(line_words(docs, doc_id, text))


def line_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of each document as an array: (doc_id, words)."""
    return docs.select(F.col(doc_id).alias("doc_id"), split_lines(F.col(text)).alias("words"))


def explode_words(words: DataFrame) -> DataFrame:
    """Long form of an array of words: (doc_id, pos, term).

    The outer form keeps the optimizer from testing the array's size in front
    of the explode, which would split every text again.
    """
    rows = words.select("doc_id", F.posexplode_outer("words").alias("pos", "term"))
    return rows.filter(F.col("term").isNotNull())


def assign_doc_ids(
    docs: DataFrame, order: Sequence[str | Column], scratch: Scratch
) -> DataFrame:
    """Adds a dense 0-based ``doc_id`` in the given order, for sources without a key."""
    return dense_index(docs, order, "doc_id", scratch, "documents")


def bag_from_counts(
    counts: DataFrame, doc: str, term: str, count: str, grouped: bool = False
) -> DataFrame:
    """Term counts prepared by the user: (doc_id, term_id, cnt).

    Each count is truncated to an integer and dropped unless positive. With
    ``grouped=False`` several rows of one (document, term) are added up first.
    """
    _require(counts, doc, term, count)
    rows = counts.select(
        F.col(doc).cast("bigint").alias("doc_id"),
        F.col(term).cast("bigint").alias("term_id"),
        F.col(count).alias("cnt"),
    )
    if not grouped:
        rows = rows.groupBy("doc_id", "term_id").agg(F.sum("cnt").alias("cnt"))
    return rows.withColumn("cnt", F.col("cnt").cast("bigint")).filter("cnt > 0")


def _require(table: DataFrame, *columns: str) -> None:
    missing = [name for name in columns if name not in table.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {table.columns}")
