"""How well a model describes its corpus."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.operators.buckets import Bucket, blocks_of, by_bucket
from themeloom.operators.counts import grain_keys, vector_sum
from themeloom.plans.joins import lookup

SMOOTHINGS = ("mean", "map")


def log_or_nan(x: Column) -> Column:
    """Natural logarithm as the JVM defines it: -infinity at 0, NaN below."""
    return (
        F.when(x > 0, F.ln(x))
        .when(x == 0, F.lit(float("-inf")))
        .otherwise(F.lit(float("nan")))
    )


def log_likelihood(
    cells: DataFrame,
    words: DataFrame,
    docs: DataFrame | None,
    totals: Sequence[int],
    *,
    alpha: float,
    eta: float,
    vocab_size: int,
    smoothing: str = "mean",
    grain: str = "term",
    doc_keys: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """One row: (log_likelihood, tokens), the sum over cells of cnt * ln(phi . theta).

    ``mean`` smooths with (n + eta) / (N_k + V eta) and (n + alpha) / (n_d + K
    alpha). ``map`` takes one off each count in the numerators and norms theta
    to one. Without ``docs``, ``cells`` have ``nd``, the counts of their document.
    """
    if smoothing not in SMOOTHINGS:
        raise ValueError(f"smoothing must be one of {SMOOTHINGS}, not {smoothing!r}")
    k = len(totals)
    less = 1.0 if smoothing == "map" else 0.0
    mass = float(vocab_size * eta)
    near = cells if docs is None else cells.join(docs.withColumnRenamed("n", "nd"), list(doc_keys))
    theta = F.transform("nd", lambda n: n + F.lit(alpha) - F.lit(less))
    summed = F.aggregate("_theta", F.lit(0.0), lambda s, x: s + F.abs(x))
    kept = [*doc_keys, "term_id", "cnt", *(["n"] if grain == "doc_term" else [])]
    near = near.select(*kept, theta.alias("_theta")).withColumn("_norm", summed)
    total = F.lit(list(totals)).cast("array<bigint>")
    phi = F.transform(
        "n", lambda n, t: (n + F.lit(eta) - F.lit(less)) / (F.get(total, t) + F.lit(mass))
    )
    if grain_keys(grain) == ["term_id"]:
        count = vector_sum("n")
        phis = words.select("term_id", phi.alias("_phi"), count.alias("_tokens"))
        near = lookup(
            near,
            phis,
            "term_id",
            weight="_tokens",
            spread_by=["doc_id"],
            table_bytes=vocab_size * (8 * k + 96),
        )
    else:
        near = near.withColumn("_phi", phi)
    dot = F.aggregate(
        F.zip_with("_phi", "_theta", lambda p, t: p * t), F.lit(0.0), lambda s, x: s + x
    )
    norm = F.when(F.col("_norm") == 0, 1.0).otherwise(F.col("_norm"))
    likely = near.select("cnt", (dot / norm).alias("_p"))
    return likely.agg(
        F.coalesce(F.sum(F.col("cnt") * log_or_nan(F.col("_p"))), F.lit(0.0)).alias(
            "log_likelihood"
        ),
        F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("tokens"),
    )


def bucket_likelihood(
    table: DataFrame,
    vectors: DataFrame,
    totals: Sequence[int],
    *,
    alpha: float,
    eta: float,
    vocab_size: int,
    smoothing: str = "mean",
) -> DataFrame:
    """``log_likelihood`` with counts of terms over all documents, of a state bucketed by
    ``bucket`` that never moves: each bucket adds up its own part."""
    if smoothing not in SMOOTHINGS:
        raise ValueError(f"smoothing must be one of {SMOOTHINGS}, not {smoothing!r}")
    k, less = len(totals), 1.0 if smoothing == "map" else 0.0
    total, mass = np.array(totals, np.int64), float(vocab_size * eta)

    def work(bucket: Bucket) -> pa.Table:
        if "cnt" in bucket.rows.column_names:
            of = bucket.cells()
            docs, terms, count = of.docs, of.terms, of.count
        else:
            docs, terms = (bucket.values(name) for name in ("doc_id", "term_id"))
            count = np.ones(len(docs), np.int64)
        of_terms, of_docs, found = bucket.terms(), bucket.documents(), 0.0
        for part in blocks_of(len(docs), k):
            _, nw, term = of_terms.rows(terms[part])
            _, nd, doc = of_docs.rows(docs[part])
            # One product for each pair of a document and a term.
            pair, at = np.unique(doc * len(nw) + term, return_inverse=True)
            theta, phi = nd + alpha - less, (nw + eta - less) / (total + mass)
            norm = np.abs(theta).sum(axis=1)
            doc, term = pair // len(nw), pair % len(nw)
            dot = (phi[term] * theta[doc]).sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                logs = np.log(dot / np.where(norm == 0, 1.0, norm)[doc])
            times = np.bincount(at, weights=count[part], minlength=len(pair))
            found += float((times * logs).sum())
        return pa.table({"log_likelihood": [found], "tokens": [int(count.sum())]})

    parts = by_bucket(table, vectors, k, work, "log_likelihood DOUBLE, tokens BIGINT")
    return parts.agg(
        F.coalesce(F.sum("log_likelihood"), F.lit(0.0)).alias("log_likelihood"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"),
    )


def perplexity(likelihood: DataFrame, tokens: int | None = None) -> DataFrame:
    """One row: exp(-log likelihood / tokens); NULL for no tokens."""
    count = F.col("tokens") if tokens is None else F.lit(tokens)
    return likelihood.select(
        F.when(count > 0, F.exp(-F.col("log_likelihood") / count)).alias("perplexity")
    )


def log_prior(
    words: DataFrame,
    docs: DataFrame,
    totals: Sequence[int],
    *,
    alpha: float,
    eta: float,
    vocab_size: int,
) -> DataFrame:
    """One row: log probability of the topics under the priors (alpha, eta > 1).

    ``words`` should hold every term that counts as a topic entry, zeros included.
    """
    if alpha <= 1 or eta <= 1:
        raise ValueError("the log prior needs alpha > 1 and eta > 1")
    total = F.lit(list(totals)).cast("array<bigint>")
    mass = float(vocab_size * (eta - 1.0))
    of_terms = words.select(
        F.aggregate(
            F.transform(
                "n",
                lambda n, t: log_or_nan((n + F.lit(eta - 1.0)) / (F.get(total, t) + F.lit(mass))),
            ),
            F.lit(0.0),
            lambda s, x: s + x,
        ).alias("part")
    ).select((F.lit(eta - 1.0) * F.col("part")).alias("part"))
    shifted = docs.select(F.transform("n", lambda n: n + F.lit(alpha - 1.0)).alias("_x")).select(
        "_x", F.aggregate("_x", F.lit(0.0), lambda s, x: s + F.abs(x)).alias("_norm")
    )
    of_docs = shifted.select(
        F.aggregate(
            F.transform("_x", lambda x: log_or_nan(x / F.col("_norm"))),
            F.lit(0.0),
            lambda s, x: s + x,
        ).alias("part")
    ).select((F.lit(alpha - 1.0) * F.col("part")).alias("part"))
    return of_terms.unionAll(of_docs).agg(
        F.coalesce(F.sum("part"), F.lit(0.0)).alias("log_prior")
    )
