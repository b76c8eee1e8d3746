import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.llm import ngram_join, shingles

DOCS = "doc_id BIGINT, text STRING"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(UPPER)) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain_components(rows, percent=80):
    sets = {i: plain_set(text) for i, text in rows}
    root = {i: i for i in sets}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return sets, root


def near_copies(n=150, seed=3):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(n):
        if texts and i % 2:
            words = list(rng.choice(texts))
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        else:
            words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 3, 5, 6, 9, 15, 40, 120, 400]))]
            if i % 3 == 0:
                words += passage
        texts.append(words)
    return [(n - i, " ".join(words)) for i, words in enumerate(texts)]


def joined(spark, scratch, rows, **options):
    return ngram_join.ngram_components(spark.createDataFrame(rows, DOCS), scratch, **options).collect()


@pytest.mark.parametrize("costly", [1, 1e9])
def test_all_links_are_found(spark, scratch, monkeypatch, costly):
    # Costly chance matches make the allocation choose wide segments.
    monkeypatch.setattr(ngram_join, "PAIR_COST", costly)
    monkeypatch.setattr(ngram_join, "SAMPLED", 1)
    rows = near_copies()
    sets, root = plain_components(rows)
    found = {r.doc_id: r for r in joined(spark, scratch, rows)}
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items()} == {i: (len(sets[i]), root[i]) for i in sets}
    assert len(set(root.values())) < len(rows)


def random_pairs(rng, size):
    """Pairs of sets at the edge of the similarity, of a size and up to 1.25 times it."""
    common = -(-80 * (2 * size) // 180) if rng.random() < 0.5 else -(-80 * (size + size * 5 // 4) // 180)
    common = min(common, size)
    whole = rng.integers(0, 1 << 63, 3 * size + 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for other in (size, min(size * 5 // 4, size + size // 4)):
        a = np.unique(whole[:size])
        b = np.unique(np.concatenate([whole[size - common : size], whole[size : size + other - common]]))
        yield a, b


@pytest.mark.parametrize("costly", [1, 1e12])
def test_similar_sets_share_a_key_at_every_size(monkeypatch, costly):
    monkeypatch.setattr(ngram_join, "PAIR_COST", costly)
    rng = np.random.default_rng(1)
    starts = ngram_join.band_starts(5000, 80)
    bands = ngram_join.allocate(80, starts, np.ones(len(starts)), np.ones(len(starts)))
    tried = 0
    for size in [*range(1, 80), 100, 250, 999, 4000] * 3:
        for a, b in random_pairs(rng, size):
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                owner, key, bucket = ngram_join.segment_keys([a, b], bands)
                one, two = (set(zip(key[owner == i], bucket[owner == i], strict=True)) for i in (0, 1))
                assert one & two, (size, len(a), len(b))
                tried += 1
    assert tried > 100


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for size in (1, 5, 60, 700):
        for share in (0, 0.5, 0.9, 1):
            whole = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
            a, b = whole[:size], whole[int(size * (1 - share)) : int(size * (2 - share)) + size // 5]
            exact = len(np.setxor1d(a, b))
            bound = shingles.least_difference(shingles.parity_sketch(a), shingles.parity_sketch(b))
            assert bound <= exact and (exact == 0 or bound > exact // 3)


def test_sets_are_those_of_plain_python():
    texts = [None, "", " \t\r\n\x0b\x0c", "A b", "a  B", "é É x y z", "a b c d e", "A B C D E\nf", "a a a a a a a a", "x" * 5000]
    texts += [text for _, text in near_copies(40)]
    found = dict(shingles.shingle_sets(texts))
    names = {}
    for i, text in enumerate(texts):
        told = plain_set(text)
        assert len(found[i]) == len(told)
        names.setdefault(tuple(sorted(told)), set()).add(found[i].tobytes())
    assert all(len(v) == 1 for v in names.values())
    assert len({next(iter(v)) for v in names.values()}) == len(names)


def test_odd_rows(spark, scratch):
    same = "one two three four five six seven eight nine ten"
    rows = [(None, same), (None, None), (5, None), (6, ""), (7, "  "), (4, "a b"), (3, "A B"), (2, "b a"), (9, same), (9, same),
            (9, "a b"), (10, same.upper())]
    found = joined(spark, scratch, rows)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in found if r.doc_id) == [
        (2, 1, 2), (3, 1, 3), (4, 1, 3), (5, 0, 5), (6, 0, 6), (7, 0, 7), (9, 1, 3), (9, 6, 3), (9, 6, 3), (10, 6, 3)
    ]
    assert sorted((r.n_shingles, r.component_id) for r in found if not r.doc_id) == [(0, None), (6, None)]
    docs = spark.createDataFrame([(1, same)], DOCS)
    for name in ("a", "b", "doc", "n_shingles", "sketch", "component_id", "members"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert ngram_join.ngram_components(docs, scratch).first() == (1, 6, 1)
    assert joined(spark, scratch, []) == []


def test_a_large_group_is_compared_in_blocks(spark, scratch, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rows = near_copies(80, seed=8)
    _, root = plain_components(rows)
    assert {r.doc_id: r.component_id for r in joined(spark, scratch, rows)} == root


def test_similar_sets_meet_at_a_set_similar_to_neither(spark, scratch):
    # The pages hold all of the short text, and are too long to be similar to it.
    short = [f"w{i}" for i in range(89)]
    rows = [(1, " ".join(short)), (2, " ".join(short + [f"e{i}" for i in range(15)]))]
    rows += [(i, " ".join(short + [f"p{i}x{j}" for j in range(24 + i % 8)])) for i in range(3, 203)]
    _, root = plain_components(rows)
    assert root[2] == 1 and len(set(root.values())) == 201
    assert {r.doc_id: r.component_id for r in joined(spark, scratch, rows)} == root


@pytest.mark.parametrize("percent", [60, 100])
def test_other_similarities(spark, scratch, percent):
    rows = near_copies(60, seed=5)
    _, root = plain_components(rows, percent)
    assert {r.doc_id: r.component_id for r in joined(spark, scratch, rows, percent=percent)} == root


def test_index_sends_short_keys(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(400)))], DOCS)
    bands = ngram_join.allocate(80, ngram_join.band_starts(400, 80), *[np.ones(len(ngram_join.band_starts(400, 80)))] * 2)
    rows = ngram_join.indexed(docs, bands).collect()
    assert rows and all(5 * len(row.sets) == 8 * len(row.keys) for row in rows)
    keys = np.array([0x0102030405060708, 0xFFFFFFFFFFFFFFFF], np.uint64)
    assert ngram_join.long_keys(ngram_join.short_keys(keys)).tolist() == [0x0102030405000000, 0xFFFFFFFFFF000000]
