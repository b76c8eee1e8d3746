"""Tokens, vocabularies and bags of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.functions.text import split_words
from themeloom.operators.packed import lists, one_by_one, token_rows, whole
from themeloom.plans.joins import can_broadcast, frequent_from, lookup
from themeloom.plans.numbering import dense_index
from themeloom.plans.scratch import Scratch
from themeloom.sources.text import explode_words

# Words of documents looked at together, and characters of texts that are still whole,
# unless one document has more.
WORDS_AT_ONCE = 1 << 22
BYTES_AT_ONCE = 1 << 25


def document_words(docs: DataFrame, **options) -> DataFrame:
    """Tokens of each document as an array: (doc_id, words)."""
    return docs.select("doc_id", split_words(F.col("text"), **options).alias("words"))


def running_words(docs: DataFrame, **options) -> DataFrame:
    """``document_words``, but words between white space stay one lower-cased string,
    which a task splits for many documents at once: (doc_id, words)."""
    if options:
        return document_words(docs, **options)
    return docs.select("doc_id", F.lower("text").alias("words"))


def tokenize(docs: DataFrame, **options) -> DataFrame:
    """Lower-cased tokens between white space: (doc_id, pos, term)."""
    return explode_words(document_words(docs, **options))


def term_counts(words: DataFrame) -> DataFrame:
    """(term, n_tokens, n_docs) over the words of documents, arrays or ``running_words``.

    Tasks count the words of many documents at once; only their counts are shuffled,
    and no (document, term) pairs.
    """
    parts = words.select("words").mapInArrow(counted_words, "term STRING, n_tokens BIGINT, n_docs BIGINT")
    return parts.groupBy("term").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_docs").alias("n_docs"))


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and documents of the words of each batch."""
    for batch in batches:
        for rows in word_slices(batch, "words"):
            coded, lengths = coded_words(rows.column("words"))
            size, codes = len(coded.dictionary), coded.indices.to_numpy()
            row = np.repeat(np.arange(len(lengths)), lengths)
            pairs = np.sort(row * size + codes)
            firsts = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
            yield pa.RecordBatch.from_arrays(
                [
                    coded.dictionary,
                    pa.array(np.bincount(codes, minlength=size)),
                    pa.array(np.bincount(firsts % max(size, 1), minlength=size)),
                ],
                names=["term", "n_tokens", "n_docs"],
            )


def word_slices(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about ``WORDS_AT_ONCE`` words of arrays or ``BYTES_AT_ONCE`` of
    texts at a time."""
    words = batch.column(name)
    arrays = pa.types.is_list(words.type)
    ends = np.cumsum(filled(words.value_lengths() if arrays else pc.binary_length(words)))
    most, start = WORDS_AT_ONCE if arrays else BYTES_AT_ONCE, 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def coded_words(words: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all rows, one behind the other, and the number of them in each."""
    if pa.types.is_list(words.type):
        return words.flatten().dictionary_encode(), filled(words.value_lengths())
    # The white space of ASCII is that of \s in the JVM.
    split = pc.ascii_split_whitespace(words)
    lengths, parts = filled(split.value_lengths()), split.flatten()
    empty = np.flatnonzero(pc.equal(parts, "").to_numpy(zero_copy_only=False))
    if len(empty):
        row = np.searchsorted(np.cumsum(lengths), empty, side="right")
        lengths = lengths - np.bincount(row, minlength=len(lengths))
        parts = parts.filter(pc.not_equal(parts, ""))
    return parts.dictionary_encode(), lengths


def filled(lengths: pa.Array) -> np.ndarray:
    return lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def fit_vocabulary(
    words: DataFrame,
    scratch: Scratch,
    vocab_size: int | None = None,
    min_df: float = 1.0,
) -> DataFrame:
    """All terms, or the ``vocab_size`` most frequent: (term_id, term, n_tokens, n_docs).

    ``term_id`` is the rank by tokens descending, then term ascending. From
    ``min_df`` documents on a term counts; below 1.0 it is a share of documents.
    """
    if vocab_size is not None and vocab_size <= 0:
        raise ValueError("vocab_size must be positive")
    counts = term_counts(words)
    if min_df < 1.0:
        needed = words.agg(F.count("*") * F.lit(min_df)).scalar()
        counts = counts.filter(F.col("n_docs") >= needed)
    elif min_df > 1.0:
        counts = counts.filter(F.col("n_docs") >= min_df)
    counts = scratch.keep(counts, "term-counts")
    if vocab_size is not None and counts.count() > vocab_size:
        counts = counts.filter(F.col("n_tokens") >= _cut(counts, vocab_size))
    ranked = dense_index(counts, [F.desc("n_tokens"), F.asc("term")], "_rank", scratch, "terms")
    kept = ranked if vocab_size is None else ranked.filter(F.col("_rank") < vocab_size)
    return kept.select(F.col("_rank").alias("term_id"), "term", "n_tokens", "n_docs")


def _cut(counts: DataFrame, vocab_size: int) -> int:
    """Token count of the last term that fits.

    The window sees one row per distinct count; n tokens have fewer than
    sqrt(2n) distinct counts.
    """
    by_count = Window.orderBy(F.desc("n_tokens"))
    histogram = counts.groupBy("n_tokens").agg(F.count("*").alias("terms"))
    reached = histogram.withColumn("reached", F.sum("terms").over(by_count))
    return reached.filter(F.col("reached") >= vocab_size).agg(F.max("n_tokens")).first()[0]


def distinct_vocabulary(words: DataFrame, scratch: Scratch) -> DataFrame:
    """All distinct terms in ascending order: (term_id, term, n_tokens, n_docs)."""
    ranked = dense_index(term_counts(words), ["term"], "term_id", scratch, "terms")
    return ranked.select("term_id", "term", "n_tokens", "n_docs")


def vocabulary_bytes(vocab: DataFrame) -> int:
    """Upper estimate of the memory a broadcast of term and id takes."""
    size = vocab.agg(F.sum(F.octet_length("term") + 64)).first()[0]
    return int(size or 0)


def encode_tokens(
    tokens: DataFrame, vocab: DataFrame, vocab_bytes: int | None = None
) -> DataFrame:
    """Terms to ids: (doc_id, pos, term_id). Tokens outside the vocabulary are dropped."""
    table = vocab.select("term", "term_id", "n_tokens")
    joined = lookup(
        tokens,
        table,
        "term",
        weight="n_tokens",
        spread_by=["doc_id", "pos"],
        table_bytes=vocab_bytes,
    )
    return joined.select("doc_id", "pos", "term_id")


def keep_encoded(words: DataFrame, vocab: DataFrame, vocab_bytes: int, scratch: Scratch) -> DataFrame:
    """Tokens of words: (doc_id, pos, term_id), from what ``keep_packed`` stores."""
    return token_rows(keep_packed(words, vocab, vocab_bytes, scratch))


def keep_packed(words: DataFrame, vocab: DataFrame, vocab_bytes: int, scratch: Scratch) -> DataFrame:
    """Stored tokens of words, arrays or ``running_words``: (doc_id, pos, term_id), arrays too.

    The frequent terms of a large vocabulary, or all of a small one, are met where the
    words are split; words are stored as such, and shuffled, only where their term is rare.
    Rare words are rows of one token beside the row of their document. Texts are split once.
    """
    kind = vocab.schema["term_id"].dataType.simpleString()
    least = 0 if can_broadcast(vocab_bytes) else frequent_from(vocab, "n_tokens", vocab_bytes)
    if least is None:
        tokens = explode_words(words.withColumn("words", as_arrays(words)))
        rare = scratch.keep(encode_tokens(tokens, vocab, vocab_bytes), "tokens")
        return one_by_one(rare)
    often = vocab.filter(F.col("n_tokens") >= least).select("term", "term_id").toArrow().combine_chunks()
    sent = words.sparkSession.sparkContext.broadcast(often)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        terms, ids = (whole(table.column(name)) for name in ("term", "term_id"))
        for batch in batches:
            for rows in word_slices(batch, "words"):
                yield met_words(rows, terms, ids, least > 0)

    name = "doc_id " + words.schema["doc_id"].dataType.simpleString()
    found = words.select("doc_id", "words").mapInArrow(
        met, f"{name}, pos ARRAY<INT>, term_id ARRAY<{kind}>, at ARRAY<INT>, words ARRAY<STRING>"
    )
    if least == 0:
        return scratch.keep(found.drop("at", "words"), "tokens", compression="zstd")
    found = scratch.keep(found, "met", compression="zstd")
    left = found.select("doc_id", F.inline(F.arrays_zip("at", "words"))).toDF("doc_id", "pos", "term")
    others = vocab.filter(F.col("n_tokens") < least)
    rare = scratch.keep(encode_tokens(left, others), "tokens")
    return found.drop("at", "words").unionByName(one_by_one(rare))


def as_arrays(words: DataFrame) -> Column:
    """The words of ``running_words`` as arrays."""
    whole_text = isinstance(words.schema["words"].dataType, T.StringType)
    return split_words(F.col("words"), to_lowercase=False) if whole_text else F.col("words")


def met_words(rows: pa.RecordBatch, terms: pa.Array, ids: pa.Array, rest: bool) -> pa.RecordBatch:
    """The ids of the words that are among ``terms``, with their places; if asked for, the
    other words, with theirs."""
    coded, lengths = coded_words(rows.column("words"))
    codes = coded.indices.to_numpy()
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = pc.index_in(coded.dictionary, value_set=terms).fill_null(-1).to_numpy()[codes]

    def packed(chosen: np.ndarray, values: pa.Array) -> list[pa.Array]:
        held = np.bincount(row[chosen], minlength=len(lengths))
        return [lists(held, place[chosen].astype(np.int32)), lists(held, values)]

    known, other = np.flatnonzero(at >= 0), np.flatnonzero(at < 0) if rest else np.zeros(0, int)
    found = packed(known, ids.take(pa.array(at[known])))
    left = packed(other, coded.dictionary.take(pa.array(codes[other])))
    return pa.RecordBatch.from_arrays(
        [rows.column("doc_id"), *found, *left], names=["doc_id", "pos", "term_id", "at", "words"]
    )


def decode_terms(
    rows: DataFrame, vocab: DataFrame, vocab_bytes: int | None = None
) -> DataFrame:
    """Adds the ``term`` of each ``term_id``."""
    table = vocab.select("term_id", "term", "n_tokens")
    return lookup(
        rows,
        table,
        "term_id",
        weight="n_tokens",
        spread_by=rows.columns,
        table_bytes=vocab_bytes,
    )


def count_vectorize(tokens: DataFrame, binary: bool = False, min_tf: float = 1.0) -> DataFrame:
    """Sparse bag of words: (doc_id, term_id, cnt).

    Terms with fewer than ``min_tf`` tokens in a document are left out; below
    1.0 it is a share of the document's tokens. ``binary`` sets counts to 1.
    """
    bag = tokens.groupBy("doc_id", "term_id").agg(F.count("*").alias("cnt"))
    if min_tf < 1.0:
        lengths = bag.groupBy("doc_id").agg(
            F.sum("cnt").alias("_length"), F.count("*").alias("_terms")
        )
        bag = lookup(bag, lengths, "doc_id", weight="_terms", spread_by=["term_id"])
        bag = bag.filter(F.col("cnt") >= F.col("_length") * F.lit(min_tf))
    elif min_tf > 1.0:
        bag = bag.filter(F.col("cnt") >= min_tf)
    count = F.lit(1).cast("bigint") if binary else F.col("cnt")
    return bag.select("doc_id", "term_id", count.alias("cnt"))


def corpus_summary(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: documents, vocabulary size, tokens inside the vocabulary."""
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    rows = docs.select(one.alias("d"), zero.alias("v"), zero.alias("t")).unionAll(
        vocab.select(zero.alias("d"), one.alias("v"), F.col("n_tokens").alias("t"))
    )
    return rows.agg(
        *[
            F.coalesce(F.sum(column), F.lit(0)).cast("bigint").alias(name)
            for column, name in (("d", "documents"), ("v", "vocabulary"), ("t", "tokens"))
        ]
    )
