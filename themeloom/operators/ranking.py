"""Top words, documents and topics."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.operators.buckets import Bucket, blocks_of, by_bucket
from themeloom.operators.counts import spread, vector_sum
from themeloom.operators.estimates import dense_words
from themeloom.plans.joins import lookup
from themeloom.plans.numbering import dense_index
from themeloom.plans.scratch import Scratch

# Fixed value: up to this rank Spark drops the other rows of a window before the
# shuffle; longer lists are numbered by a distributed sort instead.
WINDOW_ROWS = 1000
# Terms in one part of the arrays of a document.
PART_TERMS = 1024


def describe_topics(
    words: DataFrame,
    vocab: DataFrame,
    totals: Sequence[int],
    eta: float,
    vocab_size: int,
    scratch: Scratch,
    terms: int | None = None,
) -> DataFrame:
    """The most probable words of each topic: (topic, rank, term_id, term, phi).

    Order: probability descending, then term id; without ``terms`` all words.
    Within a topic the probability grows with the count, so counts are ranked
    and only the rows that stay are turned into probabilities and words.
    """
    k = len(totals)
    wanted = vocab_size if terms is None else min(terms, vocab_size)
    dense = spread(dense_words(words, vocab, k))
    order = [F.desc("n"), F.asc("term_id")]
    if wanted <= WINDOW_ROWS:
        rank = F.row_number().over(Window.partitionBy("topic").orderBy(*order))
        ranked = dense.withColumn("rank", rank).filter(F.col("rank") <= wanted)
    else:
        # Every topic has vocab_size rows, so its first place in the whole
        # order is known.
        placed = dense_index(dense, [F.asc("topic"), *order], "_place", scratch, "topic-words")
        offset = F.col("topic").cast("bigint") * F.lit(vocab_size)
        ranked = placed.withColumn("rank", (F.col("_place") - offset + 1).cast("int")).filter(
            F.col("rank") <= wanted
        )
    total = F.lit(list(totals)).cast("array<bigint>")
    share = (F.col("n") + F.lit(eta)) / (F.get(total, F.col("topic")) + F.lit(vocab_size * eta))
    return ranked.join(vocab.select("term_id", "term"), "term_id").select(
        "topic", "rank", "term_id", "term", share.alias("phi")
    )


def top_documents_per_topic(
    docs: DataFrame, documents: int, scratch: Scratch | None = None
) -> DataFrame:
    """Documents with most tokens of each topic: (topic, rank, doc_id, weight).

    Equal weights: the larger document id first. Documents without tokens of
    the topic take part with weight 0. Lists above WINDOW_ROWS need ``scratch``.
    """
    if documents > WINDOW_ROWS:
        if scratch is None:
            raise ValueError(f"more than {WINDOW_ROWS} documents of a topic need a scratch folder")
        docs = scratch.keep(docs, "topic-document-counts")
        order = [F.asc("topic"), F.desc("n"), F.desc("doc_id")]
        placed = dense_index(spread(docs), order, "_place", scratch, "topic-documents")
        # Every topic has one row for each document.
        rank = F.col("_place") - F.col("topic").cast("bigint") * F.lit(docs.count()) + 1
        return (
            placed.withColumn("rank", rank.cast("int"))
            .filter(F.col("rank") <= documents)
            .select("topic", "rank", "doc_id", F.col("n").alias("weight"))
        )
    best = Window.partitionBy("topic").orderBy(F.desc("n"), F.desc("doc_id"))
    return (
        spread(docs)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= documents)
        .select("topic", "rank", "doc_id", F.col("n").alias("weight"))
    )


def top_topics_per_document(docs: DataFrame, topics: int) -> DataFrame:
    """Topics with the largest share of each document: (doc_id, rank, topic, weight).

    A document's counts are one array, so they are sorted in their row; equal
    counts: the smaller topic first.
    """
    length = vector_sum("n")
    ordered = F.sort_array(
        F.transform("n", lambda n, topic: F.struct((-n).alias("less"), topic.alias("topic")))
    )
    best = docs.select(
        "doc_id",
        length.alias("_length"),
        F.posexplode(F.slice(ordered, 1, max(topics, 0))).alias("_at", "_best"),
    )
    weight = F.when(F.col("_length") == 0, 0.0).otherwise(-F.col("_best.less") / F.col("_length"))
    return best.select(
        "doc_id", (F.col("_at") + 1).alias("rank"), "_best.topic", weight.alias("weight")
    )


def topic_assignments(
    table: DataFrame,
    vectors: DataFrame,
    totals: Sequence[int],
    *,
    alpha: float,
    eta: float,
    vocab_size: int,
) -> DataFrame:
    """Most likely topic of each (document, term), the lowest one on ties:
    (doc_id, term_id, topic).

    ``table`` is a state bucketed by ``bucket``. Of tokens the weight is that of the term
    in all documents times that of the document; of cells, as rows or entries, that of
    the cell. Tokens of a term in several buckets give a row in each.
    """
    k = len(totals)
    total, mass = np.array(totals, np.int64), vocab_size * eta
    cells = "pos" not in table.columns

    def work(bucket: Bucket) -> pa.Table:
        if cells:
            of = bucket.cells()
            docs, terms = of.docs, of.terms
        else:
            docs, terms = (bucket.values(name) for name in ("doc_id", "term_id"))
            pairs = np.unique(np.stack([docs, terms.astype(np.int64)]), axis=1)
            docs, terms = pairs[0], pairs[1].astype(terms.dtype)
        of_docs, best = bucket.documents(), np.empty(len(docs), np.int32)
        for part in blocks_of(len(docs), k):
            _, nd, doc = of_docs.rows(docs[part])
            if cells:
                weights = (of.dense(part) - 1 + eta) * ((nd - 1 + alpha) / (total - 1 + mass))[doc]
            else:
                _, nw, term = bucket.terms().rows(terms[part])
                weights = ((nw + eta) / (total + mass))[term] * (nd + alpha)[doc]
            best[part] = weights.argmax(axis=1)
        return pa.table({"doc_id": docs, "term_id": terms, "topic": best})

    kind = table.schema["term_id"].dataType
    kind = getattr(kind, "elementType", kind).simpleString()
    return by_bucket(table, vectors, k, work, f"doc_id BIGINT, term_id {kind}, topic INT")


def assignment_arrays(assignments: DataFrame, scratch: Scratch) -> DataFrame:
    """Assignments as two arrays per document and part, by term id:
    (doc_id, part, term_ids, topics), PART_TERMS terms in every part but the last of a
    document. Long documents are parted before anything is gathered."""
    placed = dense_index(
        assignments, ["doc_id", "term_id"], "_place", scratch, f"assignments-{uuid.uuid4().hex[:8]}"
    )
    placed = scratch.keep(placed, f"placed-assignments-{uuid.uuid4().hex[:8]}")
    firsts = placed.groupBy("doc_id").agg(F.min("_place").alias("_first"), F.count("*").alias("_terms"))
    near = lookup(placed, firsts, "doc_id", weight="_terms", spread_by=["term_id"])
    part = F.floor((F.col("_place") - F.col("_first")) / PART_TERMS).alias("part")
    pairs = F.sort_array(F.collect_list(F.struct(F.col("term_id").cast("bigint").alias("term_id"), "topic")))
    return near.groupBy("doc_id", part).agg(pairs.alias("_pairs")).select(
        "doc_id", "part", F.col("_pairs.term_id").alias("term_ids"), F.col("_pairs.topic").alias("topics")
    )
