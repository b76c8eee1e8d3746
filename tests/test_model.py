import math
from collections import Counter, defaultdict

import pytest

from conftest import docs_frame
from themeloom import LDA, prepare_corpus
from themeloom.operators import ranking
from themeloom.plans.scratch import Scratch

K, ALPHA, ETA = 4, 1.3, 1.5


@pytest.fixture(scope="module", params=["collapsed", "edge"])
def model(request, spark, words_corpus):
    corpus = prepare_corpus(words_corpus, Scratch(spark))
    lda = LDA(k=K, iterations=2, alpha=ALPHA, beta=ETA, seed=8, mode=request.param)
    return lda.fit(corpus.tokens, corpus.vocab)


class Plain:
    """The same counts as dictionaries."""

    def __init__(self, model):
        self.cell, self.nw, self.nd, self.nk = Counter(), Counter(), Counter(), Counter()
        for r in model.word_topic_counts("doc_term").collect():
            self.cell[r.doc_id, r.term_id, r.topic] += r.n
            self.nw[r.term_id, r.topic] += r.n
            self.nd[r.doc_id, r.topic] += r.n
            self.nk[r.topic] += r.n
        self.docs = sorted({d for d, _ in self.nd})
        self.terms = [r.term_id for r in model.vocab.orderBy("term_id").collect()]
        self.v = len(self.terms)
        self.pairs = sorted({(d, t) for d, t, _ in self.cell})

    def phi(self, t, k):
        return (self.nw[t, k] + ETA) / (self.nk[k] + self.v * ETA)

    def theta(self, d, k):
        length = sum(self.nd[d, j] for j in range(K))
        return (self.nd[d, k] + ALPHA) / (length + K * ALPHA)


@pytest.fixture(scope="module")
def plain(model):
    return Plain(model)


def test_counts(model, plain):
    assert {(r.term_id, r.topic): r.n for r in model.word_topic_counts().collect()} == +plain.nw
    assert {(r.doc_id, r.topic): r.n for r in model.doc_topic_counts().collect()} == +plain.nd
    assert {r.topic: r.n for r in model.topic_totals().collect()} == dict(plain.nk)
    matrix = {r.term_id: tuple(r)[1:] for r in model.topics_matrix().collect()}
    assert matrix == {t: tuple(plain.nw[t, k] for k in range(K)) for t in plain.terms}


def test_theta_and_phi(model, plain):
    theta = {(r.doc_id, r.topic): r.theta for r in model.theta().collect()}
    assert theta == pytest.approx({(d, k): plain.theta(d, k) for d in plain.docs for k in range(K)})
    phi = {(r.topic, r.term_id): r.phi for r in model.phi().collect()}
    assert phi == pytest.approx({(k, t): plain.phi(t, k) for t in plain.terms for k in range(K)})
    for k in range(K):
        assert sum(phi[k, t] for t in plain.terms) == pytest.approx(1)
    for d in plain.docs:
        assert sum(theta[d, k] for k in range(K)) == pytest.approx(1)
    fine = {(r.topic, r.doc_id, r.term_id): r.phi for r in model.phi("doc_term").collect()}
    assert fine == pytest.approx(
        {
            (k, d, t): (plain.cell[d, t, k] + ETA) / (plain.nk[k] + plain.v * ETA)
            for d, t in plain.pairs
            for k in range(K)
        }
    )
    with pytest.raises(ValueError):
        model.phi("topic")


def test_theta_of_documents_without_tokens(spark, model):
    every = docs_frame(spark, [""] * 42)
    rows = {(r.doc_id, r.topic): r.theta for r in model.theta(every).collect()}
    assert len(rows) == 42 * K and rows[41, 0] == pytest.approx(1 / K)


def test_distributions(model, plain):
    raw = {(r.doc_id, r.topic): r.weight for r in model.topic_distributions().collect()}
    assert raw == {(d, k): plain.nd[d, k] for d in plain.docs for k in range(K)}
    shares = defaultdict(float)
    for r in model.topic_distributions(normalize=True).collect():
        shares[r.doc_id] += r.weight
    assert dict(shares) == pytest.approx({d: 1.0 for d in plain.docs})


@pytest.mark.parametrize("wanted", [1, 7, 30, 99, None])
@pytest.mark.parametrize("window", [100_000, 0])
def test_top_words_equal_a_full_sort(model, plain, wanted, window, monkeypatch):
    monkeypatch.setattr(ranking, "WINDOW_ROWS", window)
    rows = model.describe_topics(wanted).orderBy("topic", "rank").collect()
    size = plain.v if wanted is None else min(wanted, plain.v)
    for k in range(K):
        expected = sorted(plain.terms, key=lambda t: (-plain.nw[t, k], t))[:size]
        got = [r for r in rows if r.topic == k]
        assert [r.term_id for r in got] == expected
        assert [r["rank"] for r in got] == list(range(1, size + 1))
        assert [r.phi for r in got] == pytest.approx([plain.phi(t, k) for t in expected])


def test_top_documents_equal_a_full_sort(model, plain):
    rows = model.top_documents_per_topic(15).orderBy("topic", "rank").collect()
    for k in range(K):
        expected = sorted(plain.docs, key=lambda d: (-plain.nd[d, k], -d))[:15]
        assert [(r.doc_id, r.weight) for r in rows if r.topic == k] == [
            (d, plain.nd[d, k]) for d in expected
        ]


@pytest.mark.parametrize("wanted", [0, 1, 3, K, K + 3])
def test_top_topics_equal_a_full_sort(model, plain, wanted):
    rows = model.top_topics_per_document(wanted).orderBy("doc_id", "rank").collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.topic, r.weight))
    for d in plain.docs:
        length = sum(plain.nd[d, k] for k in range(K))
        order = sorted(range(K), key=lambda k: (-plain.nd[d, k], k))[:wanted]
        assert [t for t, _ in got[d]] == order
        assert [w for _, w in got[d]] == pytest.approx([plain.nd[d, k] / length for k in order])


def test_assignments(model, plain):
    def weight(d, t, k):
        if model.mode == "edge":
            word, doc = plain.cell[d, t, k] - 1 + ETA, plain.nd[d, k] - 1 + ALPHA
            return word * doc / (plain.nk[k] - 1 + plain.v * ETA)
        return plain.phi(t, k) * (plain.nd[d, k] + ALPHA)

    expected = {
        (d, t): max(range(K), key=lambda k: (weight(d, t, k), -k)) for d, t in plain.pairs
    }
    assert {(r.doc_id, r.term_id): r.topic for r in model.topic_assignments().collect()} == expected
    for r in model.assignment_arrays().collect():
        assert list(r.term_ids) == sorted(r.term_ids)
        assert [expected[r.doc_id, t] for t in r.term_ids] == list(r.topics)


def test_likelihood_and_perplexity(model, plain):
    def likelihood(smoothing, grain):
        less = 1 if smoothing == "map" else 0
        total = 0.0
        for d, t in plain.pairs:
            thetas = [plain.nd[d, k] + ALPHA - less for k in range(K)]
            norm = sum(abs(x) for x in thetas)
            words = [plain.nw[t, k] if grain == "term" else plain.cell[d, t, k] for k in range(K)]
            p = sum(
                (words[k] + ETA - less) / (plain.nk[k] + plain.v * ETA) * thetas[k] / norm
                for k in range(K)
            )
            total += sum(plain.cell[d, t, k] for k in range(K)) * math.log(p)
        return total

    tokens = sum(plain.nk.values())
    for smoothing in ("mean", "map"):
        for grain in ("term", "doc_term"):
            expected = likelihood(smoothing, grain)
            assert model.log_likelihood(smoothing, grain).first()[0] == pytest.approx(expected)
            assert model.perplexity(smoothing, grain).first()[0] == pytest.approx(
                math.exp(-expected / tokens)
            )
    assert model.perplexity(tokens=2 * tokens).first()[0] == pytest.approx(
        math.exp(-likelihood("mean", "term") / tokens / 2)
    )
    with pytest.raises(ValueError):
        model.log_likelihood("none")


def test_log_prior(model, plain):
    total = 0.0
    for t in plain.terms:
        for k in range(K):
            phi = (plain.nw[t, k] + ETA - 1) / (plain.nk[k] + plain.v * (ETA - 1))
            total += (ETA - 1) * math.log(phi)
    for d in plain.docs:
        norm = sum(plain.nd[d, k] + ALPHA - 1 for k in range(K))
        for k in range(K):
            total += (ALPHA - 1) * math.log((plain.nd[d, k] + ALPHA - 1) / norm)
    assert model.log_prior().first()[0] == pytest.approx(total)


def test_a_logarithm_of_nothing_is_not_skipped(spark):
    from pyspark.sql import functions as F

    from themeloom.operators.diagnostics import log_or_nan

    rows = spark.createDataFrame([(1.0,), (0.0,), (-1.0,)], "x DOUBLE")
    got = [r[0] for r in rows.select(log_or_nan(F.col("x"))).collect()]
    assert got[:2] == [0.0, float("-inf")] and math.isnan(got[2])


def test_many_topics(spark, words_corpus):
    corpus = prepare_corpus(words_corpus, Scratch(spark))
    lda = LDA(k=40, iterations=1, alpha=0.1, beta=0.1, seed=2)
    model = lda.fit(corpus.tokens, corpus.vocab)
    assert sum(model.totals) == corpus.tokens.count()
    assert model.describe_topics(3).count() == 120
    assert model.topic_assignments().count() == corpus.bag.count()
    assert model.perplexity().first()[0] > 1


def test_long_lists_of_documents_are_sorted_apart(model, plain, monkeypatch):
    short = sorted(model.top_documents_per_topic(25).collect())
    monkeypatch.setattr(ranking, "WINDOW_ROWS", 5)
    assert sorted(model.top_documents_per_topic(25).collect()) == short
    assert model.top_documents_per_topic(10**6).count() == K * len(plain.docs)
    with pytest.raises(ValueError):
        ranking.top_documents_per_topic(model.docs, 25)


def test_log_prior_by_document_and_term(model, plain):
    expected = sum(
        (ETA - 1) * math.log((plain.cell[d, t, k] + ETA - 1) / (plain.nk[k] + plain.v * (ETA - 1)))
        for d, t in plain.pairs
        for k in range(K)
    )
    for d in plain.docs:
        norm = sum(plain.nd[d, k] + ALPHA - 1 for k in range(K))
        expected += sum((ALPHA - 1) * math.log((plain.nd[d, k] + ALPHA - 1) / norm) for k in range(K))
    assert model.log_prior("doc_term").first()[0] == pytest.approx(expected, rel=1e-9)


def test_normalised_weights_add_up(model):
    from themeloom.operators import sampling

    if model.mode == "edge":
        rows, weight, keys = model.edge_rows(), sampling.edge_weight(ETA), ["doc_id", "term_id"]
    else:
        rows = sampling.join_counts(
            model.state, model.words, model.docs, model.totals, eta=ETA, vocab_size=model.vocab_size
        )
        weight, keys = sampling.collapsed_weight(ALPHA), ["doc_id", "pos"]
    plain = {(*r[:2], r.topic): r.weight for r in sampling.topic_weights(rows, weight, K, keys).collect()}
    sums = defaultdict(float)
    for key, value in plain.items():
        sums[key[:2]] += value
    for r in sampling.topic_weights(rows, weight, K, keys, normalize=True).collect():
        assert r.weight == pytest.approx(plain[(*r[:2], r.topic)] / sums[tuple(r[:2])])


def test_tokens_are_those_of_the_cells(model, plain):
    found = Counter((r.doc_id, r.term_id, r.topic) for r in model.tokens.collect())
    assert found == +plain.cell
    rows = model.tokens.select("doc_id", "term_id", "pos")
    assert rows.distinct().count() == rows.count()
