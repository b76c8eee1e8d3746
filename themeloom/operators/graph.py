"""The bag of words seen as a bipartite edge list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term_vertex(doc_id: Column, term_id: Column, vocab_size: int) -> Column:
    """Negative vertex id of a term inside a document."""
    return -(F.lit(1) + term_id.cast("bigint") + doc_id * F.lit(vocab_size).cast("bigint"))


def is_document(vertex: Column) -> Column:
    return vertex >= 0


def is_term(vertex: Column) -> Column:
    return vertex < 0


def vertex_document(vertex: Column, vocab_size: int) -> Column:
    """Document that owns a term vertex."""
    return F.call_function("div", -vertex - 1, F.lit(vocab_size).cast("bigint"))


def vertex_term(vertex: Column, vocab_size: int) -> Column:
    """Term id of a term vertex."""
    return ((-vertex - 1) % F.lit(vocab_size).cast("bigint")).cast("bigint")


def doc_term_edges(bag: DataFrame, vocab_size: int) -> DataFrame:
    """One edge per (document, term): (src_id, dst_id, cnt)."""
    return bag.select(
        F.col("doc_id").alias("src_id"),
        term_vertex(F.col("doc_id"), F.col("term_id"), vocab_size).alias("dst_id"),
        "cnt",
    )


def decode_edges(edges: DataFrame, vocab_size: int) -> DataFrame:
    """Back from edges to the bag: (doc_id, term_id, cnt)."""
    dst = F.col("dst_id")
    return edges.filter(is_document(F.col("src_id")) & is_term(dst)).select(
        vertex_document(dst, vocab_size).alias("doc_id"),
        vertex_term(dst, vocab_size).alias("term_id"),
        "cnt",
    )


def graph_counts(edges: DataFrame) -> DataFrame:
    """One row: document vertices, term vertices, edges.

    A term vertex belongs to one document, so distinct targets are counted
    inside each (source, target) group and added up, without a distinct over
    the whole list.
    """
    targets = edges.groupBy("src_id", "dst_id").agg(F.count("*").alias("edges"))
    sources = targets.groupBy("src_id").agg(
        F.count("*").alias("targets"), F.sum("edges").alias("edges")
    )
    zero = F.lit(0)
    return sources.agg(
        F.count("*").alias("document_vertices"),
        F.coalesce(F.sum("targets"), zero).cast("bigint").alias("term_vertices"),
        F.coalesce(F.sum("edges"), zero).cast("bigint").alias("edges"),
    )
