"""Probabilities estimated from topic counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators.counts import grain_keys, spread, vector_sum, zeros


def theta(docs: DataFrame, k: int, alpha: float, all_docs: DataFrame | None = None) -> DataFrame:
    """Document-topic probabilities, K rows per document: (doc_id, topic, theta).

    ``docs`` holds (doc_id, n ARRAY). Documents of ``all_docs`` without tokens
    get the uniform 1 / K.
    """
    return spread(theta_vectors(docs, k, alpha, all_docs), "theta")


def theta_vectors(
    docs: DataFrame, k: int, alpha: float, all_docs: DataFrame | None = None
) -> DataFrame:
    """One row per document: (doc_id, theta ARRAY<DOUBLE>)."""
    if all_docs is not None:
        docs = (
            all_docs.select("doc_id")
            .join(docs, "doc_id", "left")
            .select("doc_id", F.coalesce("n", zeros(k)).alias("n"))
        )
    length = vector_sum("n")
    measured = docs.select("doc_id", "n", (length + F.lit(k * alpha)).alias("_mass"))
    return measured.select(
        "doc_id",
        F.transform("n", lambda n: (n + F.lit(alpha)) / F.col("_mass")).alias("theta"),
    )


def phi(
    words: DataFrame,
    totals: Sequence[int],
    eta: float,
    vocab_size: int,
    vocab: DataFrame | None = None,
    grain: str = "term",
) -> DataFrame:
    """Topic-word probabilities, K rows per term: (topic, term_id, phi).

    ``words`` holds the keys of the grain and n ARRAY. Terms of ``vocab``
    without tokens are included at grain ``term``.
    """
    keys = grain_keys(grain)
    return spread(phi_vectors(words, totals, eta, vocab_size, vocab, grain), "phi").select(
        "topic", *keys, "phi"
    )


def phi_vectors(
    words: DataFrame,
    totals: Sequence[int],
    eta: float,
    vocab_size: int,
    vocab: DataFrame | None = None,
    grain: str = "term",
) -> DataFrame:
    """One row per term: (term_id, phi ARRAY<DOUBLE>)."""
    keys = grain_keys(grain)
    if vocab is not None and grain == "term":
        words = dense_words(words, vocab, len(totals))
    total = F.lit(list(totals)).cast("array<bigint>")
    mass = F.lit(vocab_size * eta)
    return words.select(
        *keys,
        F.transform(
            "n", lambda n, topic: (n + F.lit(eta)) / (F.get(total, topic) + mass)
        ).alias("phi"),
    )


def dense_words(words: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    """Every term of the vocabulary with its counts, zeros where it has none."""
    return (
        vocab.select("term_id")
        .join(words, "term_id", "left")
        .select("term_id", F.coalesce("n", zeros(k)).alias("n"))
    )


def topics_matrix(words: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    """Counts of each term in each topic, one row per term: (term_id, t0 .. tK-1)."""
    dense = dense_words(words, vocab, k)
    return dense.select("term_id", *[F.col("n")[topic].alias(f"t{topic}") for topic in range(k)])


def topic_distributions(docs: DataFrame, normalize: bool = False) -> DataFrame:
    """One row per (document, topic): token counts, or shares of the document."""
    if not normalize:
        return spread(docs).withColumnRenamed("n", "weight")
    length = vector_sum("n")
    measured = docs.select("doc_id", "n", length.alias("_length"))
    shares = measured.select(
        "doc_id",
        F.transform(
            "n",
            lambda n: F.when(F.col("_length") == 0, 0.0).otherwise(n / F.col("_length")),
        ).alias("weight"),
    )
    return spread(shares, "weight")
