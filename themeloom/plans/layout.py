"""How the tokens of a corpus are laid out over buckets."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.operators.packed import one_by_one, token_rows

# Memory of the rows of a bucket aimed at, which a task holds at once.
BUCKET_BYTES = 64 * 1024 * 1024
# Memory of a token; of an (document, term) cell that is and 16 bytes a topic.
TOKEN_BYTES = 80
# Documents below this many tokens are never split.
SPLIT_TOKENS = 1 << 16
# Candidates looked through for each name of a bucket.
CANDIDATES = 32


@dataclass(frozen=True)
class Layout:
    """Buckets by document; a document above a bucket's share is cut in chunks."""

    buckets: int
    share: int
    split: bool
    tokens: int
    documents: int

    @property
    def doc_keys(self) -> list[str]:
        """What the rows of a document have in common; with the bucket in it, grouping
        by them needs no shuffle."""
        return ["doc_id"] if self.split else ["bucket", "doc_id"]


def plan_layout(
    spark: SparkSession,
    lengths: DataFrame,
    row_bytes: int = TOKEN_BYTES,
    bucket_tokens: int | None = None,
    split_tokens: int = SPLIT_TOKENS,
) -> Layout:
    """Layout for documents with lengths (doc_id, n)."""
    tokens, documents, longest = lengths.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max("n"), F.lit(0))
    ).first()
    tokens, longest = int(tokens), int(longest)
    per_bucket = bucket_tokens or max(1, BUCKET_BYTES // row_bytes)
    buckets = max(spark.sparkContext.defaultParallelism, math.ceil(tokens / per_bucket))
    share = max(math.ceil(tokens / buckets), split_tokens)
    return Layout(
        buckets=buckets, share=share, split=longest > share, tokens=tokens, documents=documents
    )


def bucket_names(spark: SparkSession, buckets: int) -> DataFrame:
    """(_slot, bucket) for each slot: a number that Spark's partitioning by hash puts
    there, so every partition of a bucketed table is one bucket."""
    numbers = spark.range(CANDIDATES * buckets + 64)
    slot = F.pmod(F.hash("id"), F.lit(buckets)).alias("_slot")
    return numbers.groupBy(slot).agg(F.min("id").alias("bucket"))


def place(tokens: DataFrame, lengths: DataFrame, layout: Layout, by: list[str]) -> DataFrame:
    """Adds ``chunk`` and ``bucket``, and brings the tokens to their buckets.

    Only documents above a bucket's share are cut, by a hash of ``by``. There
    are fewer of them than buckets, so their list can be broadcast, as can the list
    of the buckets.
    """
    if not layout.split:
        chunked = tokens.withColumn("chunk", F.lit(0))
    else:
        long_docs = lengths.filter(F.col("n") > layout.share).select(
            "doc_id", F.ceil(F.col("n") / layout.share).alias("_chunks")
        )
        chunked = (
            tokens.join(F.broadcast(long_docs), "doc_id", "left")
            .withColumn(
                "chunk",
                F.when(F.col("_chunks").isNull(), 0).otherwise(
                    F.pmod(F.xxhash64(*by), F.col("_chunks")).cast("int")
                ),
            )
            .drop("_chunks")
        )
    return in_buckets(chunked, layout)


def place_packed(packed: DataFrame, lengths: DataFrame, layout: Layout, by: list[str]) -> DataFrame:
    """``place`` for rows that hold arrays of tokens or cells; those of documents that are cut are
    taken apart first."""
    if not layout.split:
        return in_buckets(packed.withColumn("chunk", F.lit(0)), layout)
    long_docs = lengths.filter(F.col("n") > layout.share).select(
        "doc_id", F.ceil(F.col("n") / layout.share).alias("_chunks")
    )
    told = packed.join(F.broadcast(long_docs), "doc_id", "left")
    short = told.filter(F.col("_chunks").isNull()).drop("_chunks").withColumn("chunk", F.lit(0))
    cut = token_rows(told.filter(F.col("_chunks").isNotNull()))
    chunk = F.pmod(F.xxhash64(*by), F.col("_chunks")).cast("int")
    return in_buckets(short.unionByName(one_by_one(cut.withColumn("chunk", chunk).drop("_chunks"))), layout)


def in_buckets(chunked: DataFrame, layout: Layout) -> DataFrame:
    """Adds ``bucket`` and brings the rows there."""
    slot = F.pmod(F.xxhash64("doc_id", "chunk"), F.lit(layout.buckets)).cast("int")
    names = bucket_names(chunked.sparkSession, layout.buckets)
    placed = chunked.withColumn("_slot", slot).join(F.broadcast(names), "_slot").drop("_slot")
    return placed.repartition(layout.buckets, "bucket")
