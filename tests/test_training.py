import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import oracles
from conftest import docs_frame
from themeloom import LDA, prepare_corpus
from themeloom.functions.uniform import document_key, document_keys, uniform, uniforms
from themeloom.operators import buckets, counts, sampling, state
from themeloom.plans import joins, training
from themeloom.plans.layout import bucket_names
from themeloom.plans.scratch import Scratch


def tokens_of(model):
    return sorted(tuple(r) for r in model.state.select("doc_id", "pos", "term_id", "topic").collect())


def cells_of(model):
    return sorted((r.doc_id, r.term_id, tuple(r.n)) for r in model.cells.collect())


@pytest.fixture(scope="module")
def corpus(spark, words_corpus):
    return prepare_corpus(words_corpus, Scratch(spark))


@pytest.fixture(scope="module")
def two_sweeps(corpus):
    return LDA(k=4, iterations=2, alpha=0.3, beta=0.5, seed=1).fit(corpus.tokens, corpus.vocab)


@pytest.fixture(scope="module")
def two_edge_sweeps(corpus):
    lda = LDA(k=4, iterations=2, alpha=1.3, beta=1.5, seed=1, mode="edge")
    return lda.fit(corpus.tokens, corpus.vocab)


def python_uniform(seed, iteration, doc, term, pos):
    key = oracles.hash_step(iteration, oracles.hash_step(seed, oracles.START))
    key = oracles.hash_step(doc, oracles.hash_step(key, oracles.START))
    h = oracles.START
    for value in (key, term, pos):
        h = oracles.hash_step(value, h)
    return (h >> 11) / float(1 << 53)


def python_draw(weights, u):
    total, sums = 0.0, []
    for weight in weights:
        total += weight
        sums.append(total)
    return next((k for k, c in enumerate(sums) if c > u * sums[-1]), len(sums) - 1)


def python_collapsed(tokens, k, iterations, alpha, eta, vocab_size, seed):
    z = {t: int(python_uniform(seed, 0, *key(t)) * k) for t in tokens}
    for sweep in range(1, iterations + 1):
        nw, nd, nk = Counter(), Counter(), Counter()
        for (doc, pos, term), topic in z.items():
            nw[term, topic] += 1
            nd[doc, topic] += 1
            nk[topic] += 1
        new = {}
        for t, old in z.items():
            doc, pos, term = t
            weights = [
                (nw[term, j] - (j == old) + eta)
                / (nk[j] - (j == old) + vocab_size * eta)
                * (nd[doc, j] - (j == old) + alpha)
                for j in range(k)
            ]
            new[t] = python_draw(weights, python_uniform(seed, sweep, *key(t)))
        z = new
    return sorted((*t, topic) for t, topic in z.items())


def key(token):
    doc, pos, term = token
    return doc, term, pos


def python_edge(bag, k, iterations, alpha, eta, vocab_size, seed):
    z = {
        (d, t, i): int(python_uniform(seed, 0, d, t, i) * k) for d, t, n in bag for i in range(n)
    }
    for sweep in range(1, iterations + 1):
        cell, nd, nk = Counter(), Counter(), Counter()
        for (d, t, _), topic in z.items():
            cell[d, t, topic] += 1
            nd[d, topic] += 1
            nk[topic] += 1
        z = {
            (d, t, i): python_draw(
                [
                    (cell[d, t, j] - 1 + eta)
                    * ((nd[d, j] - 1 + alpha) / (nk[j] - 1 + vocab_size * eta))
                    for j in range(k)
                ],
                python_uniform(seed, sweep, d, t, i),
            )
            for (d, t, i) in z
        }
    found = {}
    for (d, t, _), topic in z.items():
        found.setdefault((d, t), [0] * k)[topic] += 1
    return sorted((d, t, tuple(n)) for (d, t), n in found.items())


def test_uniform_is_the_public_hash(spark):
    rows = [(d, t, p) for d in (0, 5, 1 << 40) for t in (0, 9) for p in (0, 1, 1 << 33)]
    frame = spark.createDataFrame(rows, "d BIGINT, t INT, p BIGINT")
    u = uniform(document_key(42, 3, F.col("d")), F.col("t"), F.col("p"))
    for r in frame.select("d", "t", "p", u.alias("u")).collect():
        assert r.u == python_uniform(42, 3, r.d, r.t, r.p)
        assert 0 <= r.u < 1


def test_collapsed_sweeps_against_plain_python(corpus, two_sweeps):
    tokens = [tuple(r) for r in corpus.tokens.select("doc_id", "pos", "term_id").collect()]
    expected = python_collapsed(tokens, 4, 2, 0.3, 0.5, corpus.vocab.count(), 1)
    assert tokens_of(two_sweeps) == expected


@pytest.mark.parametrize("k", [16, 17, 24, 32, 33, 64, 70])
def test_sweeps_of_many_topics_against_plain_python(corpus, k):
    size = corpus.vocab.count()
    tokens = [tuple(r) for r in corpus.tokens.select("doc_id", "pos", "term_id").collect()]
    model = LDA(k=k, iterations=1, alpha=0.3, beta=0.5, seed=1).fit(corpus.tokens, corpus.vocab)
    assert tokens_of(model) == python_collapsed(tokens, k, 1, 0.3, 0.5, size, 1)
    bag = [tuple(r) for r in corpus.bag.collect()]
    edge = LDA(k=k, iterations=1, alpha=1.3, beta=1.5, seed=1, mode="edge")
    model = edge.fit_bag(corpus.bag, corpus.vocab)
    assert cells_of(model) == python_edge(bag, k, 1, 1.3, 1.5, size, 1)


def test_edge_sweeps_against_plain_python(corpus, two_edge_sweeps):
    bag = [tuple(r) for r in corpus.bag.collect()]
    expected = python_edge(bag, 4, 2, 1.3, 1.5, corpus.vocab.count(), 1)
    assert cells_of(two_edge_sweeps) == expected


def test_split_documents_change_nothing(corpus, two_sweeps, two_edge_sweeps):
    split = LDA(k=4, iterations=2, alpha=0.3, beta=0.5, seed=1, split_tokens=10)
    model = split.fit(corpus.tokens, corpus.vocab)
    assert model.layout.split and model.table.select("chunk").distinct().count() > 1
    assert tokens_of(model) == tokens_of(two_sweeps)
    edge = LDA(k=4, iterations=2, alpha=1.3, beta=1.5, seed=1, mode="edge", split_tokens=10)
    model = edge.fit(corpus.tokens, corpus.vocab)
    assert model.layout.split
    assert cells_of(model) == cells_of(two_edge_sweeps)


def test_copies_are_drawn_in_blocks_of_any_size(monkeypatch):
    rng = np.random.default_rng(3)
    sums = np.cumsum(rng.random((40, 6)), axis=1)
    keys, terms = rng.integers(0, 1 << 63, 40).astype(np.uint64), rng.integers(0, 99, 40)
    count = np.where(np.arange(40) == 7, 5000, rng.integers(0, 9, 40))
    whole = sampling.drawn_copies(sums, keys, terms, count)
    assert (whole.sum(axis=1) == count).all()
    for cell in (0, 7, 39):
        u = [uniform_of(int(keys[cell]), int(terms[cell]), i) for i in range(count[cell])]
        told = Counter(python_draw(np.diff(np.append(0, sums[cell])), x) for x in u)
        assert whole[cell].tolist() == [told[t] for t in range(6)]
    monkeypatch.setattr(sampling, "BLOCK_CELLS", 1)
    assert (sampling.drawn_copies(sums, keys, terms, count) == whole).all()


def uniform_of(key, term, pos):
    h = oracles.START
    for value in (key, term, pos):
        h = oracles.hash_step(value, h)
    return (h >> 11) / float(1 << 53)


def test_uniform_numbers_of_numpy():
    docs = np.array([0, 5, 1 << 40, -3])
    keys = document_keys(42, 3, docs)
    places = np.array([0, 1, 1 << 33, 7])
    found = uniforms(keys, np.array([0, 9, 1 << 35, 2]), places)
    for i, term in enumerate((0, 9, 1 << 35, 2)):
        assert found[i] == python_uniform(42, 3, int(docs[i]) % (1 << 64), term, int(places[i]))


def test_sparse_counts():
    rng = np.random.default_rng(4)
    ids, topics = rng.integers(-5, 9, 300), rng.integers(0, 70, 300)
    told = Counter(zip(ids.tolist(), topics.tolist()))
    of_tokens = buckets.Counts.of_tokens(ids, topics, 70)
    names = rng.permutation(np.unique(ids))
    cells = [[n * 70 + t for (i, t), n in told.items() if i == name] for name in names]
    sent = buckets.Counts.of_cells(names, pa.array(cells, pa.list_(pa.int64())), 70)
    for found in (of_tokens, sent):
        some = np.array([names[3], names[0], names[3]])
        name, dense, row = found.rows(some)
        assert name[row].tolist() == some.tolist()
        assert {(int(name[i]), t): int(n) for (i, t), n in np.ndenumerate(dense) if n} == {
            key: n for key, n in told.items() if key[0] in some
        }
    none = buckets.Counts.of_cells(np.zeros(0, int), pa.array([], pa.list_(pa.int64())), 3)
    assert none.rows(np.zeros(0, int))[1].shape == (0, 3)


def test_salted_term_join_changes_nothing(corpus, two_sweeps, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_LIMIT", -1)
    model = LDA(k=4, iterations=2, alpha=0.3, beta=0.5, seed=1).fit(corpus.tokens, corpus.vocab)
    assert tokens_of(model) == tokens_of(two_sweeps)
    assert model.table.count() == corpus.tokens.count()
    # Tokens are back in their buckets: one file for each at most.
    assert len(model.table.inputFiles()) <= model.layout.buckets


def test_huge_cells_change_nothing(corpus, two_edge_sweeps, monkeypatch):
    for module in (state, training):
        monkeypatch.setattr(module, "BLOCK", 3)
    edge = LDA(k=4, iterations=2, alpha=1.3, beta=1.5, seed=1, mode="edge")
    assert cells_of(edge.fit(corpus.tokens, corpus.vocab)) == cells_of(two_edge_sweeps)


def test_partition_counts_change_nothing(spark, corpus, two_sweeps):
    for partitions in ("1", "32"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            lda = LDA(k=4, iterations=2, alpha=0.3, beta=0.5, seed=1, bucket_tokens=200)
            assert tokens_of(lda.fit(corpus.tokens.repartition(7), corpus.vocab)) == tokens_of(two_sweeps)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_bag_training_keeps_every_token(corpus):
    lda = LDA(k=3, iterations=1, alpha=0.3, beta=0.5, seed=1)
    model = lda.fit_bag(corpus.bag, corpus.vocab)
    again = sorted(map(tuple, model.state.groupBy("doc_id", "term_id").count().collect()))
    assert again == sorted(map(tuple, corpus.bag.collect()))
    split = LDA(k=3, iterations=1, alpha=0.3, beta=0.5, seed=1, split_tokens=10)
    assert tokens_of(split.fit_bag(corpus.bag, corpus.vocab)) == tokens_of(model)


def test_counts_stay_consistent_over_ten_sweeps(spark, corpus):
    lda = LDA(k=4, iterations=0, alpha=0.3, beta=0.5, seed=9)
    total = corpus.tokens.count()
    terms = {r.term_id: r.n_tokens for r in corpus.vocab.collect()}
    for iterations in (0, 1, 10):
        lda.iterations = iterations
        model = lda.fit(corpus.tokens, corpus.vocab)
        assert sum(model.totals) == total
        assert [r.n for r in model.topic_totals().orderBy("topic").collect()] == model.totals
        assert {r.term_id: sum(r.n) for r in model.words.collect()} == terms
        assert model.state.filter("topic < 0 OR topic >= 4").count() == 0
        lengths = {r.doc_id: r.n for r in counts.doc_lengths(corpus.tokens).collect()}
        assert {r.doc_id: sum(r.n) for r in model.docs.collect()} == lengths
        assert len(model.history) == iterations


def test_planted_topics_are_found(spark, scratch):
    rng = random.Random(3)
    texts = [
        " ".join(f"t{doc % 3}x{rng.randint(0, 19)}" for _ in range(50)) for doc in range(300)
    ]
    corpus = prepare_corpus(docs_frame(spark, texts), scratch)
    lda = LDA(k=3, iterations=0, alpha=0.1, beta=0.1, seed=4)
    before = lda.fit(corpus.tokens, corpus.vocab).perplexity().first()[0]
    lda.iterations = 30
    model = lda.fit(corpus.tokens, corpus.vocab)
    after = model.perplexity().first()[0]
    assert after < 25 < before
    tops = model.describe_topics(20).collect()
    sets = {t: {r.term[:2] for r in tops if r.topic == t} for t in range(3)}
    assert sorted(map(tuple, sets.values())) == [("t0",), ("t1",), ("t2",)]


def test_old_generations_are_removed(spark, corpus):
    last = {"state5", "state5-words"}
    for keep, expected in ((True, last | {"state4"}), (False, last)):
        lda = LDA(
            k=2, iterations=5, alpha=0.3, beta=0.5, seed=1,
            checkpoint_interval=2, keep_last_checkpoint=keep,
        )
        model = lda.fit(corpus.tokens, corpus.vocab)
        import os

        folders = {n for n in os.listdir(model.scratch.root) if n.startswith("state")}
        assert folders == expected
        model.release()
        assert not os.path.exists(model.scratch.root)


def test_plans_do_not_grow(corpus):
    lda = LDA(k=2, iterations=3, alpha=0.3, beta=0.5, seed=1)
    few = lda.fit(corpus.tokens, corpus.vocab)
    lda.iterations = 12
    many = lda.fit(corpus.tokens, corpus.vocab)

    def size(model):
        return len(model.table._jdf.queryExecution().logical().toString().splitlines())

    assert size(few) == size(many) == 1


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("k", [4, 40, 1000])
@pytest.mark.parametrize("vocab_size", [30, 10**9])
def test_tokens_never_move(spark, corpus, two_sweeps, two_edge_sweeps, k, vocab_size):
    """The side of the tokens has no exchange and no explode, whatever the sizes are."""
    routes = two_sweeps.routes
    words = spark.range(3).select(
        F.col("id").cast("int").alias("term_id"), F.array_repeat(F.lit(1).cast("bigint"), k).alias("n")
    )
    for model, sweep, vectors in (
        (two_sweeps, sampling.gibbs_sweep, buckets.term_vectors(words, routes, k)),
        (two_edge_sweeps, sampling.edge_sweep, buckets.no_vectors(routes)),
    ):
        plan = plan_of(
            sweep(
                model.table, vectors, [1] * k, alpha=1.3, eta=1.5, vocab_size=vocab_size, seed=1, iteration=3
            )
        )
        lines = plan.splitlines()
        scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "bucket#" in line and "doc_id" in line)
        group = max(i for i, line in enumerate(lines[:scan]) if "FlatMapCoGroupsInArrow" in line)
        assert "Bucketed: true" in lines[scan]
        for line in lines[group + 1 : scan]:
            assert "Exchange" not in line and "Generate" not in line and "Join" not in line
        for forbidden in ("Cartesian", "NestedLoop", "Window"):
            assert forbidden not in plan


def test_every_partition_is_one_bucket(spark, two_sweeps):
    for number in (1, 7, 100):
        names = bucket_names(spark, number).collect()
        assert sorted(r._slot for r in names) == list(range(number))
    table = two_sweeps.table
    found = table.select("bucket", F.spark_partition_id().alias("p"), F.input_file_name().alias("f")).distinct().collect()
    assert len({r.bucket for r in found}) == len({r.f for r in found}) == len(found)


@pytest.mark.parametrize("mode", ["collapsed", "edge"])
@pytest.mark.parametrize("split", [10, 1 << 16])
def test_metrics_of_every_sweep(corpus, mode, split):
    def fit(iterations):
        lda = LDA(
            k=4, iterations=iterations, alpha=1.3, beta=1.5, seed=1, mode=mode, split_tokens=split, likelihood=True
        )
        return lda.fit(corpus.tokens, corpus.vocab)

    three = fit(3)
    rows = three.iteration_metrics().orderBy("iteration").collect()
    assert [r.iteration for r in rows] == [1, 2, 3]
    for i, row in enumerate(rows):
        before, after = fit(i), fit(i + 1)
        assert row.log_likelihood == pytest.approx(before.log_likelihood().first()[0], rel=1e-9)
        if mode == "collapsed":
            old = {t[:3]: t[3] for t in tokens_of(before)}
            changed = sum(old[t[:3]] != t[3] for t in tokens_of(after))
        else:
            old = {c[:2]: c[2] for c in cells_of(before)}
            changed = sum(max(n - o, 0) for c in cells_of(after) for n, o in zip(c[2], old[c[:2]]))
        assert row.tokens_changed == changed > 0


def test_parameters_are_checked():
    for bad in (
        {"k": 0}, {"iterations": -1}, {"checkpoint_interval": 0}, {"checkpoint_interval": -2},
        {"k": 3, "alpha": [0.1, 0.2, 0.3]}, {"k": 3, "alpha": [0.1, 0.1]}, {"mode": "online"},
        {"mode": "edge", "alpha": 0.9, "beta": 1.5}, {"mode": "edge", "alpha": 1.5, "beta": 1.0},
    ):
        with pytest.raises(ValueError):
            LDA(**bad)
    assert LDA(k=3, alpha=[0.2, 0.2, 0.2]).alpha == 0.2
    auto = LDA(k=20, alpha=0, beta=-1)
    assert (auto.alpha, auto.eta) == (2.5, 1.1)
    assert (LDA().k, LDA().iterations, LDA().checkpoint_interval) == (10, 20, 10)


def test_one_topic(corpus):
    model = LDA(k=1, iterations=2, alpha=0.3, beta=0.5, seed=1).fit(corpus.tokens, corpus.vocab)
    assert model.totals == [corpus.tokens.count()]
    assert {r.theta for r in model.theta().collect()} == {1.0}
    assert [r.tokens_changed for r in model.iteration_metrics().collect()] == [0, 0]


def test_more_topics_than_words(spark, scratch):
    corpus = prepare_corpus(docs_frame(spark, ["a", "a a"]), scratch)
    model = LDA(k=7, iterations=2, alpha=0.3, beta=0.5, seed=1).fit(corpus.tokens, corpus.vocab)
    assert model.topic_totals().count() == 7 and sum(model.totals) == 3
    assert model.describe_topics(5).count() == 7


def test_empty_corpus(spark, scratch):
    for texts in ([], ["", " \n"]):
        corpus = prepare_corpus(docs_frame(spark, texts), scratch)
        assert corpus.summary().first() == (len(texts), 0, 0)
        for mode, a, b in (("collapsed", 0.3, 0.5), ("edge", 1.3, 1.5)):
            lda = LDA(k=3, iterations=1, alpha=a, beta=b, seed=1, mode=mode)
            model = lda.fit(corpus.tokens, corpus.vocab)
            assert model.totals == [0, 0, 0]
            for rows in (model.theta(), model.phi(), model.describe_topics(3), model.topic_assignments()):
                assert rows.count() == 0
            assert model.log_likelihood().first()[0] == 0.0
            assert model.perplexity().first()[0] is None
            assert not math.isnan(len(model.history))


def test_a_bucket_fits_in_a_worker_of_four(spark):
    """At most 64 MB of rows, which a task holds several times over."""
    from themeloom.plans.layout import TOKEN_BYTES, plan_layout

    lengths = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(20_000).cast("bigint").alias("n"))
    layout = plan_layout(spark, lengths)
    assert layout.tokens / layout.buckets * TOKEN_BYTES <= 64 << 20


def test_counts_of_documents_are_made_where_rows_lie(corpus):
    """Neither tokens nor cells are shuffled to stand beside the counts of their document."""
    for mode, least in (("collapsed", 0.3), ("edge", 1.3)):
        trained = LDA(k=3, iterations=0, alpha=least, beta=least, seed=1, mode=mode).fit(corpus.tokens, corpus.vocab)
        asked = [trained.placed_rows(), trained.placed_rows(cells=True), trained.edge_rows()]
        for rows in asked:
            assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        lengths = {r.doc_id: r.n for r in corpus.tokens.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
        assert {r.doc_id: sum(r.nd) for r in asked[0].collect()} == lengths


def test_weights_of_cells_need_no_window_and_are_compiled(spark, two_edge_sweeps):
    rows = two_edge_sweeps.edge_rows()
    assert "Window" not in plan_of(rows) and "Exchange" not in plan_of(rows)
    stored = spark.createDataFrame([(1, [3, 0], [0.5, 0.25])], "doc_id BIGINT, n ARRAY<BIGINT>, factor ARRAY<DOUBLE>")
    for normalize, expected in ((False, [1.75, 0.125]), (True, [1.75 / 1.875, 0.125 / 1.875])):
        found = sampling.topic_weights(stored, sampling.edge_weight(1.5), 2, ["doc_id"], normalize)
        assert "lambdafunction" not in plan_of(found)
        assert [tuple(r) for r in found.collect()] == [(1, 0, expected[0]), (1, 1, expected[1])]
