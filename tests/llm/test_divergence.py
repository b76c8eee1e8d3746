"""Prices of sources and terms against plain Python with whole numbers."""

import random
from collections import Counter

import numpy as np
import pytest

from themeloom.llm import divergence
from themeloom.llm.divergence import Forest, WHOLE


def plain(rows, min_docs=10, top=10):
    import re

    docs = [(lang or "", source or "", text or "") for text, lang, source in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, frequency = Counter(), Counter()
    for lang, source, text in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        for term in terms:
            counts[lang, source, term] += 1
        for term in set(terms):
            frequency[lang, term] += 1
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for (l, t), n in frequency.items() if l == lang and n >= min_docs]
        sources = {d[1] for d in docs if d[0] == lang}

        def share(members):
            n = {t: sum(counts[lang, s, t] for s in members) for t in kept}
            mass = sum(n.values()) + 2 * len(kept)
            return {t: 1 + WHOLE * (n[t] + 2) // mass for t in kept}

        q = share(sources)
        shares = {s: share([s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(shares[s][t], shares[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(shares[s][t], q[t]), t) for t in kept if counts[lang, s, t] and shares[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, r) for r, (v, i) in enumerate(found[:most], 1)]
    return sorted(out)


def audit(spark, scratch, rows, **more):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text STRING, lang STRING, source STRING, term INT")
    found = divergence.audit_sources(docs, scratch, **more)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in found.collect())


def corpus(n=400, sources=5):
    rng = random.Random(7)
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice([f"s{i}" for i in range(sources)] + [None, "s0", "s0"])
        pool = [f"W{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(60)]
        text = " ".join(rng.choice(pool) + rng.choice(["", ".", "1x"]) for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice([text, text, text, None, ""]), lang, source))
    return rows + [("only here", "fr", "a"), (None, "it", "a"), ("x", "it", "b")]


def test_against_plain_python(spark, scratch):
    rows = corpus()
    assert audit(spark, scratch, rows) == plain(rows)
    assert audit(spark, scratch, rows, min_docs=25, top_terms=3) == plain(rows, 25, 3)


def test_many_sources_in_tiles_and_blocks(spark, scratch, monkeypatch):
    rows = corpus(500, sources=12)
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "BLOCK", 7)
    assert audit(spark, scratch, rows, min_docs=5) == plain(rows, 5)


def test_no_rows(spark, scratch):
    assert audit(spark, scratch, []) == []


def test_long_texts_are_split_at_spaces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    data = b"aaa bbbbbbbbbbbbbbbbb c " * 9
    parts = list(divergence.text_pieces(data))
    assert b"".join(parts) == data and [w for p in parts for w in p.split()] == data.split()


@pytest.mark.parametrize("places", [1, 2, 7, 64])
def test_forest(places):
    rng = np.random.default_rng(places)
    counts = rng.integers(0, 3, (6, places)) * rng.integers(0, 2, (6, places))
    counts[1], counts[2, 0] = counts[0], 1 << 40
    masses = [int(c.sum()) + 2 * places for c in counts]
    forest = Forest(counts, masses)
    assert forest.roots[0] == forest.roots[1]
    p = [[1 + WHOLE * (int(c) + 2) // m for c in row] for row, m in zip(counts, masses)]
    for tree in range(6):
        others = np.array([o for o in range(6) if o != tree])
        told = [sum((a - b) ** 2 // (a + b) for a, b in zip(p[tree], p[o])) for o in others]
        assert forest.prices(tree, others).tolist() == told
