"""Indexes over words and mined phrases against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from themeloom.llm import collocations as c


def pieces_of(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower))]


def plain(rows, min_count=10, percent=50, top=2000):
    counts, words = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in pieces_of(text):
            words[lang] += len(piece)
            for n in (1, 2, 3):
                own.update(tuple(piece[i : i + n]) for i in range(len(piece) - n + 1))
    out = []
    for lang, own in counts.items():
        found = []
        often = [p for p, n in own.items() if len(p) > 1 and n >= min_count]
        covered = Counter()
        for p in often:
            for part in {p[:2], p[1:]} if len(p) == 3 else ():
                covered[part] = max(covered[part], own[p])
        for p in often:
            a = own[p]
            if len(p) == 2 and 100 * covered[p] >= percent * a:
                continue
            cuts = [(1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def mined(spark, scratch, rows, **more):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang STRING, text STRING, phrase INT")
    found = c.mine_phrases(docs, scratch, **more)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert found.columns == [*columns, "n_left", "n_right"]
    return sorted(tuple(r) for r in found.select(*columns).collect())


def corpus(n=300):
    rng = random.Random(3)
    pool = ["the", "of", "New", "York", "city", "ß", "a1", "—", "x'y"] + [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(0, 40)):
            text += rng.choice(["New York ", "new york city ", rng.choice(pool) + rng.choice([" ", "\t", "  ", ", ", ".\n"])])
        rows.append((rng.choice(["en", "en", "de", None]), rng.choice([text, text, text, None, ""])))
    return rows


def test_against_plain_python(spark, scratch):
    rows = corpus()
    told = plain(rows)
    assert mined(spark, scratch, rows) == told and len(told) > 10
    assert mined(spark, scratch, rows, min_count=3, top=7, percent=90) == plain(rows, 3, 90, 7)


def test_no_rows_and_no_words(spark, scratch):
    assert mined(spark, scratch, []) == []
    assert mined(spark, scratch, [("en", None), (None, " .,\n"), ("", "a b " * 20)]) == plain([("", "a b " * 20)])


def test_shards_change_nothing(monkeypatch):
    rows = corpus()
    batch = pa.table({"lang": [x or "und" for x, _ in rows], "text": [t or "" for _, t in rows]}).to_batches()

    def counted():
        out = Counter()
        for shard in c.read_shards(iter(batch)):
            names = shard.words.to_pylist()
            for n, of in zip(*np.unique(shard.numbers, return_counts=True)):
                if n:
                    out[shard.lang, names[n - 1]] += int(of)
        return out

    whole = counted()
    monkeypatch.setattr(c, "SHARD", 50)
    assert len(list(c.read_shards(iter(batch)))) > 20 and counted() == whole


@pytest.mark.parametrize("kinds", [2, 5, 50])
def test_intervals_of_both_indexes(kinds):
    rng = np.random.default_rng(kinds)
    numbers = np.append(rng.integers(0, kinds, 400), 0)
    ahead, back = c.Index(numbers, kinds), c.Index(numbers[::-1], kinds)
    text = numbers.tolist()

    def places(phrase):
        return [i for i in range(len(text)) if text[i : i + len(phrase)] == list(phrase)]

    found = c.single_words(ahead)
    for length, left in ((2, True), (3, False)):
        found = c.extend(ahead if left else back, found, left)
        told = {tuple(text[i : i + length]) for i in range(len(text) - length + 1)}
        told = {p for p in told if 0 not in p}
        assert {tuple(p) for p in found.numbers.tolist()} == told and len(found.count) == len(told)
        befores = c.neighbours(ahead, found.ahead, found.count)
        afters = c.neighbours(back, found.back, found.count)
        for phrase, count, before, after in zip(found.numbers.tolist(), found.count, befores, afters):
            at = places(phrase)
            assert count == len(at)
            assert before == sum(i > 0 and text[i - 1] > 0 for i in at)
            assert after == sum(text[i + length] > 0 for i in at)


def test_keys_are_short():
    hashes = c.hashes_of("en", pa.array([b"w%d" % i for i in range(5000)], pa.binary()))
    for length in (1, 2, 3):
        numbers = np.stack([np.arange(1, 5001)] * length, axis=1)
        keys = c.phrase_keys(hashes, numbers)
        assert keys.min() >= 0 and keys.max() < 1 << 32 and len(np.unique(keys)) > 4990
