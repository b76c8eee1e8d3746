import random

import pytest

from conftest import docs_frame
from themeloom import prepare_corpus, prepare_lines
from themeloom.operators import graph, vocabulary
from themeloom.plans import joins
from themeloom.plans.numbering import dense_index


def vocab_rows(vocab):
    return [tuple(r) for r in vocab.orderBy("term_id").collect()]


def test_tiny_vocabulary(spark, scratch, tiny):
    corpus = prepare_corpus(tiny, scratch)
    assert vocab_rows(corpus.vocab) == [
        (0, "c", 4, 2), (1, "a", 2, 1), (2, "b", 2, 2), (3, "d", 1, 1)
    ]
    assert corpus.summary().first() == (3, 4, 9)
    bag = sorted(map(tuple, corpus.bag.collect()))
    assert bag == [(0, 1, 2), (0, 2, 1), (1, 0, 1), (1, 2, 1), (2, 0, 3), (2, 3, 1)]


def test_ties_are_broken_bytewise(spark, scratch):
    words = "b Z a é z \U0001f600 ￮".split()
    docs = docs_frame(spark, [" ".join(words)])
    corpus = prepare_corpus(docs, scratch, to_lowercase=False)
    assert [r[1] for r in vocab_rows(corpus.vocab)] == sorted(words, key=lambda w: w.encode())


@pytest.mark.parametrize("size", [1, 3, 4, 9, 10, 50])
def test_cap_keeps_the_most_frequent(spark, scratch, size):
    counts = {f"t{i}": 1 + i // 3 for i in range(10)}
    docs = docs_frame(spark, [" ".join(t for t, n in counts.items() for _ in range(n))])
    words = vocabulary.document_words(docs)
    got = vocab_rows(vocabulary.fit_vocabulary(words, scratch, vocab_size=size))
    expected = sorted(counts.items(), key=lambda item: (-item[1], item[0]))[:size]
    assert [(r[1], r[2]) for r in got] == expected
    assert [r[0] for r in got] == list(range(len(expected)))


def test_words_outside_the_vocabulary_leave_gaps(spark, scratch):
    corpus = prepare_corpus(docs_frame(spark, ["x a a y b b"]), scratch, vocab_size=2)
    rows = sorted(map(tuple, corpus.tokens.collect()))
    assert rows == [(0, 1, 0), (0, 2, 0), (0, 4, 1), (0, 5, 1)]
    assert corpus.summary().first() == (1, 2, 4)


def test_min_df(spark, scratch, tiny):
    words = vocabulary.document_words(tiny)
    for min_df in (2, 0.6):
        vocab = vocabulary.fit_vocabulary(words, scratch, min_df=min_df)
        assert [r[1] for r in vocab_rows(vocab)] == ["c", "b"]


def test_min_tf_and_binary(spark, scratch, tiny):
    tokens = prepare_corpus(tiny, scratch).tokens

    def bag(**options):
        return sorted(map(tuple, vocabulary.count_vectorize(tokens, **options).collect()))

    assert bag(min_tf=2) == [(0, 1, 2), (2, 0, 3)]
    assert bag(min_tf=0.5) == [(0, 1, 2), (1, 0, 1), (1, 2, 1), (2, 0, 3)]
    assert [row[2] for row in bag(binary=True)] == [1] * 6


def test_lines_corpus_has_every_line(spark, scratch):
    corpus = prepare_lines(docs_frame(spark, ["b\na\n\nb", "A"]), scratch)
    assert vocab_rows(corpus.vocab) == [(0, "", 1, 1), (1, "A", 1, 1), (2, "a", 1, 1), (3, "b", 2, 1)]


def test_salted_join_equals_broadcast_join(spark, scratch, words_corpus, monkeypatch):
    words = vocabulary.document_words(words_corpus)
    vocab = vocabulary.fit_vocabulary(words, scratch)
    tokens = vocabulary.tokenize(words_corpus)
    small = vocabulary.encode_tokens(tokens, vocab, vocabulary.vocabulary_bytes(vocab))
    salted = vocabulary.encode_tokens(tokens, vocab)
    assert sorted(small.collect()) == sorted(salted.collect())
    back = vocabulary.decode_terms(salted, vocab)
    assert sorted(map(tuple, back.select("doc_id", "pos", "term").collect())) == sorted(
        map(tuple, tokens.collect())
    )


def test_salts_only_for_heavy_keys(spark):
    rows = spark.createDataFrame([(7, i) for i in range(90)] + [(k, k) for k in range(5)], "k INT, i INT")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n").persist()
    joined = joins.lookup(rows, table, "k", weight="n", spread_by=["i"])
    assert joined.count() == 95
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "Cross" not in plan


def test_dense_index_over_many_partitions(spark, scratch):
    rng = random.Random(1)
    values = [(rng.randint(0, 50), i) for i in range(2000)]
    rng.shuffle(values)
    rows = spark.createDataFrame(values, "a INT, b INT").repartition(16)
    indexed = dense_index(rows, ["a", "b"], "at", scratch, "numbers").collect()
    assert [(r.a, r.b) for r in sorted(indexed, key=lambda r: r["at"])] == sorted(values)
    assert sorted(r["at"] for r in indexed) == list(range(2000))


def test_edges_round_trip(spark, scratch, tiny):
    bag = prepare_corpus(tiny, scratch).bag
    edges = graph.doc_term_edges(bag, 4)
    assert edges.filter("dst_id >= 0 OR src_id < 0").count() == 0
    assert sorted(map(tuple, graph.decode_edges(edges, 4).collect())) == sorted(
        map(tuple, bag.collect())
    )
    assert graph.graph_counts(edges).first() == (3, 6, 6)
    assert graph.graph_counts(edges.limit(0)).first() == (0, 0, 0)


def test_frequent_terms_of_a_large_vocabulary_are_met_where_words_are_split(spark, scratch, words_corpus, monkeypatch):
    words = vocabulary.document_words(words_corpus)
    vocab = vocabulary.fit_vocabulary(words, scratch)
    size = vocabulary.vocabulary_bytes(vocab)
    expected = sorted(map(tuple, vocabulary.encode_tokens(vocabulary.tokenize(words_corpus), vocab, size).collect()))
    monkeypatch.setattr(joins, "BROADCAST_LIMIT", size // 2)
    least = joins.frequent_from(vocab, "n_tokens", size)
    assert 0 < vocab.filter(vocab.n_tokens >= least).count() <= vocab.count() // 2
    stored = vocabulary.keep_encoded(words, vocab, size, scratch)
    assert sorted(map(tuple, stored.collect())) == expected
    shuffled = spark.read.parquet(f"{scratch.root}/tokens").count()
    assert 0 < shuffled < vocab.filter(vocab.n_tokens < least).agg({"n_tokens": "sum"}).first()[0] + 1
    back = vocabulary.decode_terms(stored, vocab, size)
    assert back.count() == len(expected)
    # No key at all fits.
    monkeypatch.setattr(joins, "BROADCAST_LIMIT", 0)
    assert joins.frequent_from(vocab, "n_tokens", size) is None
    assert sorted(map(tuple, vocabulary.keep_encoded(words, vocab, size, scratch).collect())) == expected
