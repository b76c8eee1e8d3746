"""Suffix arrays by grouping, and removal of repeated strings, against brute force."""

import random

import numpy as np
import pytest

from themeloom.llm import suffixes
from themeloom.llm.grouping import Texts, suffix_array


def sorted_suffixes(symbols, lengths):
    out, start = [], 0
    for length in lengths:
        text = symbols[start : start + length]
        out += [start + i for i in sorted(range(length), key=lambda i: text[i:])]
        start += length
    return out


def test_suffix_arrays_of_many_texts():
    rng = random.Random(1)
    for _ in range(200):
        symbols, lengths = [], []
        for _ in range(rng.randint(1, 6)):
            kinds = rng.randint(1, 3)
            text = [rng.randint(1, kinds) for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.3:
                text = (text[:3] * 20)[: len(text)]
            symbols += [*text, 0]
            lengths.append(len(text) + 1)
        assert suffix_array(Texts(np.array(symbols), np.array(lengths))).tolist() == sorted_suffixes(symbols, lengths)


@pytest.mark.parametrize("text", [b"a" * 3000, b"ab" * 1500, b"ba" * 900 + b"a" * 300, b"abc" * 700 + b"abd" * 90])
def test_text_that_repeats_itself_takes_few_steps(text):
    symbols = np.append(np.frombuffer(text, np.uint8).astype(np.int64), 0)
    assert suffix_array(Texts(symbols, np.array([len(symbols)]))).tolist() == sorted_suffixes(
        symbols.tolist(), [len(symbols)]
    )


def test_hashes_and_minima():
    raw = np.frombuffer(bytes(range(200)) * 2, np.uint8)
    for length in (1, 7, 20, 24, 48, 50):
        grams = suffixes.gram_hashes(raw, length)
        assert len(grams) == len(raw) - length + 1
        assert grams[3] == grams[203] and len(set(grams[:200].tolist())) == 200
    assert not len(suffixes.gram_hashes(raw[:5], 6))
    values = np.random.default_rng(1).integers(0, 99, 60)
    for width in (1, 2, 3, 8, 31):
        assert suffixes.smallest(values, width).tolist() == [min(values[i : i + width]) for i in range(61 - width)]


def plain(rows, size=suffixes.WINDOW):
    """Kept bytes and spans of each row, by looking at every string."""
    first = {}
    texts = [(suffixes.NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    for doc, text in texts:
        for at in range(len(text) - size + 1):
            s = text[at : at + size]
            first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, text in texts:
        gone = np.zeros(len(text), bool)
        for at in range(len(text) - size + 1):
            if first[text[at : at + size]] < doc:
                gone[at : at + size] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(int)))
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        out.append((kept, list(zip(edges[::2].tolist(), edges[1::2].tolist()))))
    return out


def check(spark, scratch, rows):
    docs = spark.createDataFrame(
        [(i, t, n, "x", "y") for n, (i, t) in enumerate(rows)],
        "doc_id BIGINT, text STRING, n INT, spans STRING, doc STRING",
    )
    found = suffixes.drop_repeats(docs, scratch)
    assert found.columns == ["doc_id", "text", "n", "doc", "spans", "kept"]
    got = {r.n: (bytes(r.kept), [(s.low, s.high) for s in r.spans]) for r in found.collect()}
    assert got == dict(enumerate(plain(rows)))
    return got


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


def test_against_brute_force(spark, scratch):
    rng = random.Random(2)
    passages = [words(rng, n) for n in (12, 15, 30, 60)]
    rows = []
    for doc in rng.sample(range(1000), 60):
        parts = [words(rng, rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(passages)
            cut = rng.randint(0, 20)
            parts += [passage[cut:] if rng.random() < 0.5 else passage, words(rng, rng.randint(0, 9))]
        rows.append((doc, rng.choice(["", " ", "\n"]).join(parts)))
    rows += [(2000 + i, rows[i][1]) for i in range(5)]
    got = check(spark, scratch, rows)
    assert sum(len(spans) for _, spans in got.values()) > 50


def test_odd_rows(spark, scratch):
    text = "The quick brown fox jumps over the lazy dog and runs away."
    rows = [
        (5, text), (5, text), (5, text + " Again."), (None, None), (None, text[3:56]), (1, ""), (7, "é" * 60),
        (8, "x" + "é" * 40), (3, "a" * 5000), (2, "a" * 49), (4, "b" + "a" * 50), (6, "ab" * 400), (9, "ba" * 300),
        (10, text[:49]), (11, text[:50]), (-4, text[1:51]),
    ]
    check(spark, scratch, rows)
    empty = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert suffixes.drop_repeats(empty, scratch).count() == 0


def test_keys_with_many_places_and_long_texts(spark, scratch, monkeypatch):
    """A passage in every document, cut again by longer grams, and texts in pieces."""
    rng = random.Random(5)
    common = "of the people by the people for the people shall not perish"
    rows = [(i, words(rng, 3) + common[: rng.randint(25, 59)] + words(rng, 3)) for i in range(150)]
    rows.append((500, " ".join(t for _, t in rows)))
    check(spark, scratch, rows)
    texts = [t.encode() for _, t in rows]
    whole = list(suffixes.pieces(texts))
    monkeypatch.setattr(suffixes, "PIECE", 64)
    small = list(suffixes.pieces(texts))
    assert sum(int(p.counts.sum()) for p in small) == sum(int(p.counts.sum()) for p in whole)
    assert max(int(p.counts.max()) for p in small) <= 64


def test_large_groups_are_parted(monkeypatch):
    """Equal windows of many different stretches with one key."""
    rng = np.random.default_rng(6)
    core = rng.integers(97, 123, 60).astype(np.uint8)
    parts = []
    for i in range(120):
        left, right = rng.integers(97, 123, 8).astype(np.uint8), rng.integers(97, 123, 8).astype(np.uint8)
        parts.append(np.concatenate([left[: i % 8], core[i % 7 : 60 - i % 5], right[: i % 6]]))
    lengths = np.array([len(p) for p in parts])
    data, at, counts = np.concatenate(parts), np.cumsum(lengths) - lengths, lengths - suffixes.WINDOW + 1
    keys, owner = np.zeros(len(parts), np.int64), rng.integers(0, 50, len(parts))
    got = suffixes.smallest_documents(data, keys, at, counts, np.repeat(owner, counts))
    strings = [bytes(p[i : i + suffixes.WINDOW]) for p, n in zip(parts, counts) for i in range(n)]
    ids = np.repeat(owner, counts)
    least = {}
    for s, i in zip(strings, ids):
        least[s] = min(least.get(s, i), i)
    assert got.tolist() == [least[s] for s in strings]


@pytest.mark.parametrize("hashed", [1, 7, 64, 1 << 14])
def test_windows_are_hashed_in_blocks_of_any_size(monkeypatch, hashed):
    monkeypatch.setattr(suffixes, "HASHED", hashed)
    rng = np.random.default_rng(5)
    for size in (0, 19, 20, 49, 50, 51, 64, 300):
        raw = rng.integers(0, 3, size).astype(np.uint8)
        for gram in (suffixes.GRAM, suffixes.LONG_GRAM, suffixes.WINDOW):
            keys, grams = suffixes.window_keys(raw, gram)
            assert grams.tolist() == suffixes.gram_hashes(raw, gram).tolist()
            near = suffixes.WINDOW - gram + 1
            told = [int(grams[i : i + near].min()) >> 16 for i in range(size - suffixes.WINDOW + 1)]
            assert keys.tolist() == told


@pytest.mark.parametrize("equal_hashes", [False, True])
def test_contents_of_stretches_are_told_apart_by_their_bytes(monkeypatch, equal_hashes):
    if equal_hashes:
        monkeypatch.setattr(suffixes, "BYTES", np.zeros(256, np.uint64))
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 256, n).astype(np.uint8) for n in (50, 50, 61, 90)]
    chosen = rng.integers(0, 4, 40)
    keys = rng.integers(0, 3, 40)
    data = np.concatenate([texts[i] for i in chosen])
    lengths = np.array([len(texts[i]) for i in chosen])
    found = suffixes.different(data, keys, np.cumsum(lengths) - lengths, lengths - suffixes.WINDOW + 1)
    content, stretch = (x.tolist() for x in found)
    pairs = list(zip(keys.tolist(), chosen.tolist()))
    assert len(stretch) == len(set(pairs)) and [content[i] for i in stretch] == list(range(len(stretch)))
    assert all((content[i] == content[j]) == (pairs[i] == pairs[j]) for i in range(40) for j in range(40))
    assert [keys[i] for i in stretch] == sorted(keys[i] for i in stretch)


def test_keys_of_neighbours_are_looked_up_once():
    table = np.zeros(4, np.int64)
    table[1] = 1 << 3
    keys = np.array([67, 67, 5, 67, 5, 5])
    assert suffixes.held_windows(table, keys).tolist() == [True, True, False, True, False, False]
    assert suffixes.held_windows(table, keys[:0]).tolist() == []
