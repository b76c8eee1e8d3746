"""Tokens held as arrays, a row for each document."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from themeloom import LDA, Scratch, prepare_corpus
from themeloom.operators import packed, vocabulary
from themeloom.plans import joins

TEXTS = [(0, "a b a"), (1, ""), (2, None), (3, " \tB\x0bc\x0c d\r\n\x1cx\x85y "), (3, "c c"), (None, "e a")]


@pytest.fixture(scope="module")
def odd(spark):
    """Blanks of all kinds, no text, a document in two rows, one without a name."""
    return spark.createDataFrame(TEXTS, "doc_id BIGINT, text STRING")


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_running_words_are_the_words(spark, odd):
    arrays, running = vocabulary.document_words(odd), vocabulary.running_words(odd)
    assert running.schema["words"].dataType.simpleString() == "string"
    assert rows_of(vocabulary.term_counts(running)) == rows_of(vocabulary.term_counts(arrays))
    told = {r.term: (r.n_tokens, r.n_docs) for r in vocabulary.term_counts(running).collect()}
    assert told["a"] == (3, 2) and told["c"] == (3, 2) and told["\x1cx\x85y"] == (1, 1)


@pytest.mark.parametrize("at_once", [1, 3, 1 << 20])
def test_words_are_counted_in_slices_of_any_size(monkeypatch, at_once):
    for name in ("WORDS_AT_ONCE", "BYTES_AT_ONCE"):
        monkeypatch.setattr(vocabulary, name, at_once)
    words = [["a", "b", "a"], [], None, ["b"], ["c"]]
    for column in (pa.array(words), pa.array([None if w is None else " ".join(w) for w in words], pa.string())):
        told = {}
        for found in vocabulary.counted_words(iter([pa.RecordBatch.from_arrays([column], names=["words"])])):
            for row in found.to_pylist():
                n, docs = told.get(row["term"], (0, 0))
                told[row["term"]] = (n + row["n_tokens"], docs + row["n_docs"])
        assert told == {"a": (2, 1), "b": (2, 2), "c": (1, 1)}


@pytest.mark.parametrize("limit", [None, 140, 0])
def test_packed_tokens_are_the_tokens(spark, odd, limit, monkeypatch):
    scratch = Scratch(spark)
    words = vocabulary.running_words(odd)
    vocab = scratch.keep(vocabulary.fit_vocabulary(words, scratch), "vocabulary")
    expected = rows_of(
        vocabulary.tokenize(odd).join(vocab, "term").select("doc_id", "pos", "term_id")
    )
    if limit is not None:
        monkeypatch.setattr(joins, "BROADCAST_LIMIT", limit)
    size = vocabulary.vocabulary_bytes(vocab)
    kept = vocabulary.keep_packed(words, vocab, size, scratch)
    assert rows_of(packed.token_rows(kept)) == expected
    if limit is None:
        assert kept.count() == len(TEXTS)


@pytest.mark.parametrize("split", [10, 1 << 16])
def test_state_is_a_row_for_each_document(spark, words_corpus, split):
    corpus = prepare_corpus(words_corpus, Scratch(spark))
    lda = LDA(k=4, iterations=2, alpha=0.3, beta=0.5, seed=1, split_tokens=split)
    model = lda.fit_packed(corpus.packed, corpus.vocab)
    stored = model.stored.groupBy("doc_id", "chunk").count()
    assert stored.filter("count > 1").count() == 0
    if split > 10:
        assert model.stored.count() == words_corpus.count()
    # Neither the rows of tokens nor what fit makes of them differs.
    assert rows_of(model.state) == rows_of(lda.fit(corpus.tokens, corpus.vocab).state)
    assert rows_of(model.state) == rows_of(model.table.drop("bucket", "chunk"))
    n = {r.doc_id: sum(r.n) for r in model.docs.collect()}
    assert n == {r.doc_id: r.n for r in packed.packed_lengths(corpus.packed).collect()}


def test_counts_of_packed_tokens(spark):
    rows = [(7, 1, [3, 5, 3], [0, 1, 0]), (7, 2, [5], [1]), (9, 3, [3], [1])]
    frame = spark.createDataFrame(rows, "bucket BIGINT, doc_id BIGINT, term_id ARRAY<BIGINT>, topic ARRAY<INT>")
    told = packed.term_topics(frame.coalesce(1), 2).groupBy("term_id", "topic").agg(F.sum("n"))
    assert rows_of(told) == [(3, 0, 2), (3, 1, 1), (5, 1, 2)]
    assert rows_of(packed.held_terms(frame).distinct()) == [(7, 3), (7, 5), (9, 3)]
    assert sorted((r.doc_id, r.n) for r in packed.document_topics(frame, 2).collect()) == [
        (1, [2, 1]), (2, [0, 1]), (3, [0, 1])
    ]
    codes, n = packed.counted(np.zeros(0, np.int64))
    assert len(codes) == len(n) == 0


@pytest.mark.parametrize("split", [10, 1 << 16])
def test_edge_cells_of_packed_tokens(spark, words_corpus, split):
    """The first cells are those of a bag of counts, and no bag is stored for them."""
    corpus = prepare_corpus(words_corpus, Scratch(spark))
    lda = LDA(k=4, iterations=1, alpha=1.3, beta=1.5, seed=1, mode="edge", split_tokens=split)
    model, bag = lda.fit_packed(corpus.packed, corpus.vocab), lda.fit_bag(corpus.bag, corpus.vocab)
    assert rows_of(model.cells) == rows_of(bag.cells)
    assert model.totals == bag.totals and model.layout == bag.layout
    assert not os.path.exists(f"{model.scratch.root}/bag")


def test_cells_of_documents_in_several_rows(spark, odd):
    scratch = Scratch(spark)
    corpus = prepare_corpus(odd, scratch)
    lda = LDA(k=3, iterations=1, alpha=1.3, beta=1.5, seed=1, mode="edge")
    model = lda.fit_packed(corpus.packed, corpus.vocab)
    assert rows_of(model.state.select("doc_id", "term_id", "cnt")) == rows_of(corpus.bag)


@pytest.mark.parametrize("split", [10, 1 << 16])
def test_edge_state_is_a_row_for_each_document_and_holds_no_zeros(spark, words_corpus, split):
    corpus = prepare_corpus(words_corpus, Scratch(spark))
    lda = LDA(k=64, iterations=1, alpha=1.3, beta=1.5, seed=1, mode="edge", split_tokens=split)
    model = lda.fit_packed(corpus.packed, corpus.vocab)
    rows = model.stored.collect()
    if split > 10:
        assert len(rows) == words_corpus.count()
    entries = [(r.doc_id, *e) for r in rows for e in zip(r.term_id, r.topic, r.cnt, strict=True)]
    assert all(e[3] > 0 for e in entries) and len(entries) <= corpus.tokens.count()
    told = [(r.doc_id, r.term_id, k, n) for r in model.cells.collect() for k, n in enumerate(r.n) if n]
    assert sorted(entries) == sorted(told)
    assert sorted(told, key=str) == rows_of(model.word_topic_counts("doc_term"))
    # A bucket holds as many tokens as in the other mode, however many topics there are.
    few = LDA(k=2, iterations=0, seed=1, split_tokens=split).fit_packed(corpus.packed, corpus.vocab)
    assert model.layout == few.layout


def test_rows_are_packed_again(spark):
    rows = [(7, 1, 0, 5, 1, 2), (7, 1, 0, 3, 1, 4), (7, 1, 0, 3, 0, 1), (7, 1, 1, 9, 0, 1), (7, None, 0, 2, 1, 1)]
    names = "bucket BIGINT, doc_id BIGINT, chunk INT, term_id BIGINT, topic INT, cnt BIGINT"
    frame = spark.createDataFrame(rows, names)
    found = packed.pack(frame)
    assert rows_of(found) == [
        (7, 1, 0, [3, 3, 5], [0, 1, 1], [1, 4, 2]), (7, 1, 1, [9], [0], [1]), (7, None, 0, [2], [1], [1])
    ]
    assert rows_of(packed.token_rows(found)) == rows_of(frame)
    assert rows_of(packed.cell_rows(found, 2)) == [
        (7, 1, 0, 3, 5, [1, 4]), (7, 1, 0, 5, 2, [0, 2]), (7, 1, 1, 9, 1, [1, 0]), (7, None, 0, 2, 1, [0, 1])
    ]
