"""Phrases whose words belong together, counted in full-text indexes over words.

Every shard of a language has an index of its own: the Burrows-Wheeler transform
of its words and that of the same words backwards. A phrase is an interval in
each, as wide as the phrase is frequent; what is left and right of it stands in
the transforms there. Intervals are extended word by word to a set depth, all of
one length at a time. Counts of shards are added up.

Words, then pairs, then triples of words that are too rare in all of a language are
left out of what follows, which changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.shingles import ODD, mix, word_hashes
from themeloom.llm.sieves import may_hold, sieve_bits
from themeloom.plans.scratch import Scratch

# Longest phrase, and occurrences a phrase must have in its language.
DEPTH, MIN_COUNT = 3, 10
# Share, in percent, from which a longer phrase stands for one inside it.
PERCENT = 50
# Phrases reported of each language, and the factor of their score.
TOP, SCALE = 2000, 1_000_000
# Words of a shard, about.
SHARD = 1 << 18
UNDETERMINED = "und"

# Pieces end at . , ; : ! ? and at bytes 10 to 13, words at spaces and
# tabs; A-Z become a-z.
PARTED = bytes(
    10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
FACTOR = np.uint64(0xD1342543DE82EF95)
# Bits of the key of a phrase. Tables tell 27 of them apart, so more would only be shuffled.
KEY_BITS = 32


@dataclass(frozen=True)
class Shard:
    """Words of a language by number, from 1 on; 0 stands after every piece of text."""

    lang: str
    words: pa.Array
    numbers: np.ndarray
    hashes: np.ndarray


def split_words(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """Words of a text, and how many are in each of its pieces."""
    pieces = [piece.split() for piece in data.translate(PARTED).split(b"\n")]
    return [word for piece in pieces for word in piece], np.fromiter(map(len, pieces), np.int64, len(pieces))


def read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards of about SHARD words from batches of (lang, text), whole documents each."""
    words: dict[str, list[list[bytes]]] = {}
    counts: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}

    def close(lang: str) -> Iterator[Shard]:
        if sizes.pop(lang):
            yield make_shard(lang, [w for some in words[lang] for w in some], np.concatenate(counts[lang]))
        del words[lang], counts[lang]

    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found, lengths = split_words(text.encode())
            words.setdefault(lang, []).append(found)
            counts.setdefault(lang, []).append(lengths)
            sizes[lang] = sizes.get(lang, 0) + len(found)
            # Of many languages no more is held than of one.
            if sizes[lang] >= SHARD or sum(sizes.values()) >= 2 * SHARD:
                for full in [lang] if sizes[lang] >= SHARD else list(sizes):
                    yield from close(full)
    for lang in list(sizes):
        yield from close(lang)


def make_shard(lang: str, words: list[bytes], counts: np.ndarray) -> Shard:
    told = pa.array(words, pa.binary()).dictionary_encode()
    counts = counts[counts > 0]
    numbers = np.zeros(len(words) + len(counts), np.int64)
    numbers[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)] = told.indices.to_numpy() + 1
    return Shard(lang, told.dictionary, numbers, hashes_of(lang, told.dictionary))


def hashes_of(lang: str, words: pa.Array) -> np.ndarray:
    """Hashes of words of a language, from number 1 on."""
    salt = mix(word_hashes(lang.encode().hex().encode() or b"-"))[0]
    hashes = mix(word_hashes(b" ".join(words.cast(pa.binary()).to_pylist())) ^ salt)
    return np.append(np.uint64(0), hashes)


def without_rare(shard: Shard, table: np.ndarray) -> Shard:
    """The same with 0 in place of words that are rare in the language."""
    keys = phrase_keys(shard.hashes, np.arange(1, len(shard.words) + 1)[:, None])
    known = np.append(False, may_hold(table, keys))
    return Shard(shard.lang, shard.words, np.where(known[shard.numbers], shard.numbers, 0), shard.hashes)


class Index:
    """Transform of numbers: row r of the sorted suffixes follows ``before[r]``;
    ``first[c]`` is the first row that starts with c, ``jump[r]`` the row of the
    suffix that is one longer. Rows are in order up to DEPTH + 1 numbers, which is
    as far as intervals are followed."""

    def __init__(self, numbers: np.ndarray, kinds: int) -> None:
        n = len(numbers)
        self.first = np.append(0, np.cumsum(np.bincount(numbers, minlength=kinds)))
        rank, width = numbers, 1
        while width <= DEPTH:
            # Rank of the next ones; behind the end nothing is smaller than all.
            after = np.append(rank[width:] + 1, np.zeros(min(width, n), np.int64))[:n]
            pair = rank * (n + kinds + 2) + after
            order = np.argsort(pair)
            told = pair[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(0, told[1:] != told[:-1]))
            width *= 2
        self.before = numbers[order - 1]
        self.jump = np.empty(n, np.int64)
        # The k-th row before which c stands is the k-th row that starts with c.
        self.jump[np.argsort(self.before * n + np.arange(n))] = np.arange(n)


@dataclass(frozen=True)
class Intervals:
    """Phrases of one length: their numbers (phrase, place), first rows in the forward
    and the backward index, and how often they occur."""

    numbers: np.ndarray
    ahead: np.ndarray
    back: np.ndarray
    count: np.ndarray

    def take(self, chosen: np.ndarray) -> Intervals:
        return Intervals(self.numbers[chosen], self.ahead[chosen], self.back[chosen], self.count[chosen])


def single_words(index: Index) -> Intervals:
    count = np.diff(index.first)[1:]
    words = np.flatnonzero(count) + 1
    start = index.first[words]
    return Intervals(words[:, None], start, start, count[words - 1])


def extend(index: Index, found: Intervals, left: bool) -> Intervals:
    """All phrases one word longer, on the left by the forward index, on the right by
    the backward one; the interval in the other index moves along."""
    here, there = (found.ahead, found.back) if left else (found.back, found.ahead)
    owner = np.repeat(np.arange(len(here)), found.count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(found.count) - found.count, found.count)
    row = here[owner] + inside
    word = index.before[row]
    kinds = len(index.first)
    # Rows of an interval follow each other, so the smallest of a word is its first.
    order = np.argsort(owner * kinds + word)
    owner, word, row = owner[order], word[order], row[order]
    head = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (word[1:] != word[:-1]))[: len(owner)])
    first = np.minimum.reduceat(row, head) if len(head) else row
    count = np.diff(np.append(head, len(owner)))
    # Words smaller than this one come first in the other index, too.
    smaller = head - (np.cumsum(found.count) - found.count)[owner[head]]
    use = word[head] > 0
    head, first, count, smaller = head[use], first[use], count[use], smaller[use]
    parent = owner[head]
    own, other = index.jump[first], there[parent] + smaller
    pair = (word[head][:, None], found.numbers[parent])
    numbers = np.concatenate(pair if left else pair[::-1], axis=1)
    return Intervals(numbers, *((own, other) if left else (other, own)), count)


def neighbours(index: Index, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each interval, the rows that follow a word and no end of a piece."""
    sums = np.append(0, np.cumsum(index.before > 0))
    return sums[start + count] - sums[start]


def phrase_keys(hashes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Keys of KEY_BITS of phrases (phrase, place) of words with hashes; different ones
    may share one."""
    key = hashes[numbers[:, 0]]
    for place in range(1, numbers.shape[1]):
        key = mix(key * FACTOR + hashes[numbers[:, place]] + ODD)
    return (key >> np.uint64(64 - KEY_BITS)).astype(np.int64)


def frequent_phrases(shard: Shard, tables: list[np.ndarray], depth: int) -> Iterator[tuple[Index, Index | None, Intervals]]:
    """Phrases of 2 to ``depth`` words, those of one length at a time. Table number n
    holds the keys of phrases of n + 1 words that are not too rare in the language;
    phrases with a part that is, and where there is a table those that are, are left out."""
    shard = without_rare(shard, tables[0])
    kinds = len(shard.words) + 1
    ahead = Index(shard.numbers, kinds)
    back = Index(shard.numbers[::-1], kinds) if depth > 2 else None
    found = single_words(ahead)
    for length in range(2, depth + 1):
        left = length % 2 == 0
        found = extend(ahead if left else back, found, left)
        for size in range(2, min(length, len(tables)) + 1):
            for start in {0, length - size}:
                keys = phrase_keys(shard.hashes, found.numbers[:, start : start + size])
                found = found.take(np.flatnonzero(may_hold(tables[size - 1], keys)))
        yield ahead, back, found


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of every shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in read_shards(batches):
            n = np.bincount(shard.numbers, minlength=len(shard.words) + 1)[1:]
            columns = [
                pa.array([shard.lang] * len(n), pa.string()), shard.words.cast(pa.string()), pa.array(n.astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])

    return docs.mapInArrow(work, "lang STRING, word STRING, n BIGINT")


def word_keys(words: DataFrame) -> DataFrame:
    """(key) of words (lang, word)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in batch.column(0).unique():
                some = batch.column(1).filter(pc.equal(batch.column(0), lang))
                keys = phrase_keys(hashes_of(lang.as_py(), some), np.arange(1, len(some) + 1)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])

    return words.select("lang", "word").mapInArrow(work, "key BIGINT")


def count_keys(docs: DataFrame, tables, length: int) -> DataFrame:
    """(key, n) of the phrases of so many words whose parts are not too rare, of every
    shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in read_shards(batches):
            *_, (_, _, found) = frequent_phrases(shard, [t.value for t in tables], length)
            keys = phrase_keys(shard.hashes, found.numbers)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(found.count)], names=["key", "n"])

    return docs.mapInArrow(work, "key BIGINT, n BIGINT")


def count_phrases(docs: DataFrame, tables) -> DataFrame:
    """(lang, phrase, words, n, n_left, n_right) of every shard: phrases that are not too
    rare, and how often such a word of their piece stands left and right of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in read_shards(batches):
            for ahead, back, found in frequent_phrases(shard, [t.value for t in tables], DEPTH):
                length = found.numbers.shape[1]
                told = [shard.words.take(pa.array(found.numbers[:, i] - 1)) for i in range(length)]
                phrase = pc.binary_join_element_wise(*told, pa.scalar(b" ", pa.binary()))
                n = len(found.count)
                columns = [
                    pa.array([shard.lang] * n, pa.string()), phrase.cast(pa.string()),
                    pa.array(np.full(n, length, np.int32)), pa.array(found.count),
                    pa.array(neighbours(ahead, found.ahead, found.count)),
                    pa.array(neighbours(back, found.back, found.count)),
                ]
                names = ["lang", "phrase", "words", "n", "n_left", "n_right"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(
        work, "lang STRING, phrase STRING, words INT, n BIGINT, n_left BIGINT, n_right BIGINT"
    )


def mine_phrases(
    docs: DataFrame, scratch: Scratch, min_count: int = MIN_COUNT, percent: int = PERCENT, top: int = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, n_left, n_right): the ``top`` phrases of
    two to DEPTH words of each language.

    ``a`` is how often a phrase occurs, ``l`` and ``r`` how often its parts do where
    it is cut with the lowest score, floor(SCALE a a / (l r)), and ``n`` the words of
    the language. Phrases inside a longer one that is as good as always there are
    left out; the longer one needs ``min_count`` occurrences, too. ``n_left`` and
    ``n_right`` count occurrences next to which a word stands that is not too rare
    itself.

    Needs (lang, text): a null text is empty, a null lang ``und``; other columns
    change nothing. Equal rows count as often as they occur. Ties go to the more
    frequent phrase, then to the smaller one in UTF-8. An empty table gives no rows.
    """
    context = docs.sparkSession.sparkContext
    docs = docs.select(
        F.coalesce("lang", F.lit(UNDETERMINED)).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    counted = count_words(docs).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = scratch.keep(counted, "words")
    often = F.col("n") >= min_count
    known = word_keys(counted.filter(often))
    tables = [context.broadcast(sieve_bits(known, "key", often=F.lit(True))["often"])]
    for length in range(2, DEPTH + 1):
        keys = count_keys(docs, tables, length).groupBy("key").agg(F.sum("n").alias("n")).filter(often)
        tables.append(context.broadcast(sieve_bits(keys, "key", often=often)["often"]))
    phrases = (
        count_phrases(docs, tables)
        .groupBy("lang", "phrase", "words")
        .agg(*[F.sum(c).alias(c) for c in ("n", "n_left", "n_right")])
        .filter(often)
    )
    phrases = scratch.keep(phrases, "phrases")
    scored = scratch.keep(best_cuts(phrases, counted.filter(often)), "scored")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = without_inner(scored, percent).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    sizes = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score", "n_left", "n_right"
    )


def best_cuts(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score, n_left, n_right) at the lowest-scoring cut."""
    known = phrases.select("lang", "phrase", "n").unionByName(
        words.select("lang", F.col("word").alias("phrase"), "n")
    )
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    parts = F.split("phrase", " ")
    cuts = cuts.select(
        "*",
        F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("tail"),
    )
    for part, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    # Up to 38 digits.
    a, l, r = (F.col(c).cast("decimal(19,0)") for c in ("n", "l", "r"))
    score = F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (a * a), l * r)
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    counts = [F.max(c).alias(c) for c in ("n", "n_left", "n_right")]
    return cuts.groupBy("lang", "phrase", "words").agg(best, *counts).select(
        "lang", "phrase", "words", F.col("n").alias("a"), "best.l", "best.r", "best.score", "n_left", "n_right"
    )


def without_inner(scored: DataFrame, percent: int) -> DataFrame:
    """Leaves out phrases that a longer one stands for."""
    parts = F.split("phrase", " ")
    # Start and length of every shorter phrase in it.
    size = F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size")
    inner = scored.filter("words > 2").select("lang", "phrase", "words", "a", size)
    inner = inner.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("start"))
    inner = inner.select("lang", F.array_join(F.slice(parts, F.col("start"), F.col("size")), " ").alias("phrase"), "a")
    longest = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    stands = 100 * F.coalesce("longer", F.lit(0)) >= percent * F.col("a")
    return scored.join(longest, ["lang", "phrase"], "left").filter(~stands).drop("longer")
