"""Preparation of a corpus: words, vocabulary, encoded tokens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from themeloom.operators.packed import token_rows
from themeloom.operators.vocabulary import (
    corpus_summary,
    count_vectorize,
    distinct_vocabulary,
    fit_vocabulary,
    keep_packed,
    running_words,
    vocabulary_bytes,
)
from themeloom.plans.scratch import Scratch
from themeloom.sources.text import line_words


@dataclass
class Corpus:
    """A tokenised corpus; ``packed`` and ``vocab`` read stored tables. ``packed`` holds
    the tokens of documents as arrays, (doc_id, pos, term_id)."""

    docs: DataFrame
    vocab: DataFrame
    vocab_bytes: int
    packed: DataFrame
    scratch: Scratch

    @property
    def tokens(self) -> DataFrame:
        """One row for each token: (doc_id, pos, term_id)."""
        return token_rows(self.packed)

    @property
    def bag(self) -> DataFrame:
        return count_vectorize(self.tokens)

    def summary(self) -> DataFrame:
        return corpus_summary(self.docs, self.vocab)

    def release(self) -> None:
        """Delete the tables of the preparation; the corpus cannot be used afterwards."""
        self.scratch.release()


def prepare_corpus(
    docs: DataFrame,
    scratch: Scratch,
    vocab_size: int | None = None,
    min_df: float = 1.0,
    **tokenizer,
) -> Corpus:
    """Free text (doc_id, text): words between white space; all terms, or the
    ``vocab_size`` most frequent."""
    words = running_words(spread_documents(docs), **tokenizer)
    vocab = fit_vocabulary(words, scratch, vocab_size, min_df)
    return _encode(docs, words, vocab, scratch)


def prepare_lines(docs: DataFrame, scratch: Scratch) -> Corpus:
    """One token per line (doc_id, text): every distinct term is in the vocabulary."""
    words = line_words(spread_documents(docs))
    return _encode(docs, words, distinct_vocabulary(words, scratch), scratch)


def spread_documents(docs: DataFrame) -> DataFrame:
    """Deal documents out when they are read in fewer partitions than there are cores.

    A small table is read by one task. Large files are cut by size and need no
    shuffle, however few they are.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition("doc_id") if docs.rdd.getNumPartitions() < cores else docs


def _encode(docs: DataFrame, words: DataFrame, vocab: DataFrame, scratch: Scratch) -> Corpus:
    vocab = scratch.keep(vocab, "vocabulary")
    for made_of in ("term-counts", "terms"):
        scratch.drop(made_of)
    size = vocabulary_bytes(vocab)
    packed = keep_packed(words, vocab, size, scratch)
    return Corpus(docs=docs, vocab=vocab, vocab_bytes=size, packed=packed, scratch=scratch)
