"""Topic weights and the draw of a topic for every token."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.functions.uniform import document_keys, uniforms
from themeloom.operators.buckets import BLOCK_CELLS, Bucket, by_bucket, copies, table_like
from themeloom.operators.counts import COUNTED, vector_sum
from themeloom.operators.packed import lists
from themeloom.plans.joins import lookup

# SQL of the weight of one topic, given the name of the variable that holds it.
Weight = Callable[[str], str]


def double(value: float) -> str:
    """Exact DOUBLE literal."""
    return f"{float(value)!r}D"


def smoothed(counts: DataFrame, totals: Sequence[int], eta: float, vocab_size: int) -> DataFrame:
    """Term factors of the collapsed weight from ``n`` ARRAY<BIGINT>.

    ``free`` holds (n + eta) / (total + V eta) and ``own`` the same without one
    token, for the topic the token sits in.
    """
    total = F.lit(list(totals)).cast("array<bigint>")
    mass = F.lit(vocab_size * eta)

    def factor(less: int) -> Column:
        return F.transform(
            "n",
            lambda n, topic: (n - less + F.lit(eta)) / (F.get(total, topic) - less + mass),
        )

    return counts.select("*", factor(0).alias("free"), factor(1).alias("own")).drop("n")


def collapsed_weight(alpha: float) -> Weight:
    """Weight without the token itself; needs topic, free, own and nd.

    (n_wk - e + eta) / (n_k - e + V eta) * (n_dk - e + alpha), e = 1 for the
    token's topic and 0 elsewhere.
    """
    return lambda topic: (
        f"CASE WHEN topic = {topic} THEN get(own, {topic}) * (get(nd, {topic}) - 1 + {double(alpha)})"
        f" ELSE get(free, {topic}) * (get(nd, {topic}) + {double(alpha)}) END"
    )


def edge_weight(eta: float) -> Weight:
    """(N_wk - 1 + eta) times the document's factor; needs n and factor."""
    return lambda topic: f"(get(n, {topic}) - 1 + {double(eta)}) * get(factor, {topic})"


def edge_factor(name: str, totals: Sequence[int], alpha: float, eta: float, vocab_size: int) -> Column:
    """Document factors of the edge weight from counts of the document, ARRAY<BIGINT>:
    (N_dk - 1 + alpha) / (N_k - 1 + V eta)."""
    total = F.lit(list(totals)).cast("array<bigint>")
    mass = F.lit(vocab_size * eta)
    return F.transform(
        name, lambda n, topic: (n - 1 + F.lit(alpha)) / (F.get(total, topic) - 1 + mass)
    )


def weight_array(weight: Weight, k: int) -> Column:
    """All k weights of a row as an array."""
    return F.expr(f"transform(sequence(0, {k - 1}), k -> {weight('k')})")


def join_counts(
    state: DataFrame,
    words: DataFrame,
    docs: DataFrame | None,
    totals: Sequence[int],
    *,
    eta: float,
    vocab_size: int,
    doc_keys: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Puts the counts every weight needs next to the tokens: free, own, nd.

    Terms come by broadcast while vocabulary times topics is small enough; beyond
    that the tokens are shuffled by term, frequent terms spread over salts. Sweeps
    do without this join, see ``gibbs_sweep``. Without ``docs``, ``state`` has nd.
    """
    k = len(totals)
    near = state if docs is None else state.join(docs.withColumnRenamed("n", "nd"), list(doc_keys))
    counted = words.withColumn("_tokens", vector_sum("n"))
    return lookup(
        near,
        smoothed(counted, totals, eta, vocab_size),
        "term_id",
        weight="_tokens",
        spread_by=["doc_id", "pos"],
        # Two doubles per topic, and the row.
        table_bytes=vocab_size * (16 * k + 96),
    )


def first_above(sums: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Of running sums (row, topic), the first topic above u times the whole sum; the
    last one if there is none."""
    mark = u * sums[:, -1]
    return np.minimum((sums <= mark[:, None]).sum(axis=1), sums.shape[1] - 1)


def log_shares(
    nw: np.ndarray, nd: np.ndarray, total: np.ndarray, alpha: float, eta: float, mass: float
) -> np.ndarray:
    """Log probability of a token of each row under the smoothed counts of its term and
    document."""
    theta = nd + alpha
    phi = (nw + eta) / (total + mass)
    return np.log((phi * theta).sum(axis=1) / theta.sum(axis=1))


def schema_with(rows: DataFrame, keep: Sequence[str], **more: T.DataType) -> T.StructType:
    kept = [rows.schema[name] for name in keep]
    return T.StructType([*kept, *[T.StructField(name, kind) for name, kind in more.items()]])


def gibbs_sweep(
    state: DataFrame,
    vectors: DataFrame,
    totals: Sequence[int],
    *,
    alpha: float,
    eta: float,
    vocab_size: int,
    seed: int,
    iteration: int,
    likelihood: bool = False,
) -> DataFrame:
    """New topic for every token, all drawn from the counts before the sweep minus the
    token itself.

    ``state`` is a table bucketed by ``bucket``, ``vectors`` what ``term_vectors`` makes
    of its counts, with those of split documents. A row of it is a token, or holds arrays
    of tokens. Keeps the columns of ``state``; ``_moved`` counts the tokens of a row whose
    topic changed. With ``likelihood``, ``_log`` holds the log probability of the tokens of
    a row under the counts before the sweep.

    Sums of weights run from left to right, and the smallest topic whose sum is above u
    times the whole sum is drawn.
    """
    k = len(totals)
    keep = [name for name in state.columns if name != "topic"]
    more = {"topic": state.schema["topic"].dataType, "_moved": T.LongType()}
    if likelihood:
        more["_log"] = T.DoubleType()
    total, mass = np.array(totals, np.int64), vocab_size * eta

    def work(bucket: Bucket) -> pa.Table:
        docs, terms, pos = (bucket.values(name) for name in ("doc_id", "term_id", "pos"))
        was = bucket.values("topic").astype(np.int64)
        of_terms, of_docs = bucket.terms(), bucket.documents()
        new, logs = np.empty(len(was), np.int32), np.empty(len(was) if likelihood else 0)
        for part in bucket.blocks():
            _, nw, term = of_terms.rows(terms[part])
            names, nd, doc = of_docs.rows(docs[part])
            own, at = was[part], np.arange(len(was[part]))
            weights = ((nw + eta) / (total + mass))[term] * (nd + alpha)[doc]
            weights[at, own] = (
                (nw[term, own] - 1 + eta) / (total[own] - 1 + mass) * (nd[doc, own] - 1 + alpha)
            )
            u = uniforms(document_keys(seed, iteration, names)[doc], terms[part], pos[part])
            new[part] = first_above(np.cumsum(weights, axis=1), u)
            if likelihood:
                logs[part] = log_shares(nw[term], nd[doc], total, alpha, eta, mass)
        found = {"topic": bucket.as_rows(new), "_moved": bucket.sums((new != was).astype(np.int64))}
        if likelihood:
            found["_log"] = bucket.sums(logs)
        return table_like(bucket.rows, keep, **found)

    return by_bucket(state, vectors, k, work, schema_with(state, keep, **more))


def edge_sweep(
    cells: DataFrame,
    vectors: DataFrame,
    totals: Sequence[int],
    *,
    alpha: float,
    eta: float,
    vocab_size: int,
    seed: int,
    iteration: int,
    likelihood: bool = False,
) -> DataFrame:
    """New topic counts for every (document, term) cell.

    A row of ``cells`` is a cell with its counts ``n``, or holds arrays of entries. All tokens of a cell are drawn from the same weights, so its thresholds are made
    once and all its uniform numbers are held against them; copies are never rows, and
    no more than a block of them is in memory. ``_moved`` counts the tokens by which
    the new counts of a row differ from the old. ``vectors`` are those of split documents,
    and, for ``likelihood``, of terms: ``_log`` then is the log probability of the row's
    tokens under the counts before the sweep.
    """
    if alpha <= 1 or eta <= 1:
        raise ValueError("edge sampling needs alpha > 1 and eta > 1")
    k = len(totals)
    entries = "topic" in cells.columns
    drawn = ["term_id", "topic", "cnt"] if entries else ["n"]
    keep = [name for name in cells.columns if name not in drawn]
    more = {name: cells.schema[name].dataType for name in drawn} | {"_moved": T.LongType()}
    if likelihood:
        more["_log"] = T.DoubleType()
    total, mass = np.array(totals, np.int64), vocab_size * eta

    def work(bucket: Bucket) -> pa.Table:
        of, of_docs = bucket.cells(), bucket.documents()
        size = bucket.rows.num_rows
        moved, logs = np.zeros(size, np.int64), np.zeros(size if likelihood else 0)
        # Of the new counts: the cell, the topic, the tokens.
        found = [[np.zeros(0, np.int64)] for _ in range(3)]
        for part in of.blocks():
            names, nd, doc = of_docs.rows(of.docs[part])
            old, count, row = of.dense(part), of.count[part], of.row[part]
            factor = (nd - 1 + alpha) / (total - 1 + mass)
            sums = np.cumsum((old - 1 + eta) * factor[doc], axis=1)
            keys = document_keys(seed, iteration, names)[doc]
            new = drawn_copies(sums, keys, of.terms[part], count)
            cell, topic = np.nonzero(new)
            for column, values in zip(found, (cell + part.start, topic, new[cell, topic]), strict=True):
                column.append(values)
            np.add.at(moved, row, np.maximum(new - old, 0).sum(axis=1))
            if likelihood:
                _, nw, term = bucket.terms().rows(of.terms[part])
                np.add.at(logs, row, count * log_shares(nw[term], nd[doc], total, alpha, eta, mass))
        cell, topic, n = (np.concatenate(column) for column in found)
        if entries:
            held = np.bincount(of.row[cell], minlength=size)
            values = (of.terms[cell], topic.astype(np.int32), n)
            columns = {name: lists(held, value) for name, value in zip(drawn, values, strict=True)}
        else:
            new = np.zeros((size, k), np.int64)
            new[cell, topic] = n
            columns = {"n": lists(np.full(size, k), new.ravel())}
        columns["_moved"] = pa.array(moved)
        if likelihood:
            columns["_log"] = pa.array(logs)
        return table_like(bucket.rows, keep, **columns)

    return by_bucket(cells, vectors, k, work, schema_with(cells, keep, **more))


def drawn_copies(sums: np.ndarray, keys: np.ndarray, terms: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Counts by topic of the copies 0 .. count - 1 of cells with running sums of weights."""
    k = sums.shape[1]
    found = np.zeros(len(count) * k, np.int64)
    for cell, copy in copies(count, max(64, BLOCK_CELLS // k)):
        topic = first_above(sums[cell], uniforms(keys[cell], terms[cell], copy))
        found += np.bincount(cell * k + topic, minlength=len(found))
    return found.reshape(-1, k)


def topic_weights(
    rows: DataFrame, weight: Weight, k: int, keys: Sequence[str], normalize: bool = False
) -> DataFrame:
    """Weights in long form: keys, topic, weight. Unnormalised, or adding up to one."""
    if k <= COUNTED:
        # Compiled, which a lambda is not.
        weighted = rows.select(*keys, *[F.expr(weight(str(topic))).alias(f"_w{topic}") for topic in range(k)])
        values = [F.col(f"_w{topic}") for topic in range(k)]
        if normalize:
            weighted = weighted.select("*", sum(values, F.lit(0.0)).alias("_total"))
            values = [value / F.col("_total") for value in values]
        return weighted.select(*keys, F.posexplode(F.array(*values)).alias("topic", "weight"))
    weighted = rows.select(*keys, weight_array(weight, k).alias("_w"))
    if normalize:
        total = F.aggregate("_w", F.lit(0.0), lambda total, w: total + w)
        weighted = weighted.withColumn("_total", total).select(
            *keys, F.transform("_w", lambda w: w / F.col("_total")).alias("_w")
        )
    return weighted.select(*keys, F.posexplode("_w").alias("topic", "weight"))
