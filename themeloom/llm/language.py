"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes a space, and every pair
and triple of characters counts in one of BUCKETS. Counting and scoring run in
numpy over pieces of bounded size, so a text of any length is read whole; the
matrix of log-probabilities is languages x BUCKETS, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.llm.batches import parts as batch_parts

BUCKETS = 1 << 16
# Characters handled at a time.
PIECE = 1 << 18
# Added to every count of a language.
SMOOTHING = 0.5
# Longest list of languages that one model may have; the matrix has 512 KB each.
MOST_LANGUAGES = 500
UNDETERMINED = "und"
SPACE = 32


def held_out(doc_id: str) -> Column:
    """Whether a document is kept from training: a quarter, by the checksum of
    its id as text; a null id counts as an empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")
    return (F.crc32(text) % 4 == 2).alias("held_out")


@dataclass(frozen=True)
class LanguageModel:
    """Sorted ``languages``, their log-priors, and log-probabilities by bucket;
    the last row stands for no n-gram."""

    languages: list[str]
    priors: np.ndarray
    weights: np.ndarray


@cache
def letters() -> np.ndarray:
    """Code point to itself if it is a letter, else to a space."""
    codes = np.arange(0x110000, dtype=np.uint32)
    is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(is_letter, codes, SPACE).astype(np.uint32)


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(owners, starts, codes): pieces of texts side by side, about PIECE characters.

    A long text comes in several pieces that overlap by two characters; the last
    two positions of a piece begin no n-gram.
    """
    owners: list[int] = []
    parts: list[str] = []
    size = 0
    for owner, text in enumerate(texts):
        padded = f" {(text or '').lower()}  "
        for start in range(0, len(padded) - 2, PIECE):
            part = padded[start : start + PIECE + 2]
            owners.append(owner)
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield owners, *flat(parts)
                owners, parts, size = [], [], 0
    if parts:
        yield owners, *flat(parts)


def flat(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return starts, letters()[codes]


def ngrams(starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the pair and of the triple that begins at each position."""
    first = codes * np.uint32(0x9E3779B1)
    second = np.append(codes[1:], 0).astype(np.uint32)
    third = np.append(codes[2:], [0, 0]).astype(np.uint32)
    pair = first + second * np.uint32(0x85EBCA77)
    triple = pair + third * np.uint32(0xC2B2AE3D) + np.uint32(1)
    ends = np.append(starts[1:], len(codes))
    found = []
    for mixed in (pair, triple):
        mixed = mixed ^ (mixed >> np.uint32(15))
        bucket = ((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.int64)
        bucket[ends - 1] = BUCKETS
        bucket[ends - 2] = BUCKETS
        found.append(bucket)
    return found[0], found[1]


def count_languages(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n): n-grams of each language over whole texts; bucket -1
    holds the documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batch_parts(batches):
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(langs, texts, strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                seen[lang] = seen.get(lang, 0) + len(own)
                total = totals.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                for _, starts, codes in pieces(own):
                    for bucket in ngrams(starts, codes):
                        total += np.bincount(bucket, minlength=BUCKETS + 1)
        for lang, total in totals.items():
            held = np.flatnonzero(total[:BUCKETS])
            yield pa.record_batch(
                {
                    "lang": pa.array([lang] * (len(held) + 1), pa.string()),
                    "bucket": pa.array(np.append(held, -1), pa.int32()),
                    "n": pa.array(np.append(total[held], seen[lang]), pa.int64()),
                }
            )

    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counted = known.mapInArrow(count, "lang string, bucket int, n bigint")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame) -> LanguageModel:
    """Model of the languages in ``lang``, from all rows of (text, lang) where
    neither is null. No such row gives a model without languages."""
    rows = count_languages(docs).groupBy("lang").agg(
        F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("ns")
    )  # one row per language, of at most BUCKETS + 1 entries
    counts: dict[str, np.ndarray] = {}
    for row in rows.toLocalIterator():
        if len(counts) == MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} different values of lang")
        counts[row.lang] = np.zeros(BUCKETS + 1)
        counts[row.lang][np.array(row.buckets)] = row.ns
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((BUCKETS + 1, 0)))
    table = np.stack([counts[lang] for lang in languages], axis=1)
    docs_of, grams = table[-1], table[:-1] + SMOOTHING
    weights = np.log(grams) - np.log(grams.sum(axis=0))
    return LanguageModel(
        languages, np.log(docs_of / docs_of.sum()), np.vstack([weights, np.zeros(len(languages))])
    )


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text."""
    n = len(texts)
    logs = np.tile(model.priors, (n, 1))
    has_letters = np.zeros(n, bool)
    if model.languages:
        for owners, starts, codes in pieces(texts):
            has = np.bitwise_or.reduceat(codes != SPACE, starts)
            scores = sum(
                np.add.reduceat(np.take(model.weights, bucket, axis=0), starts, axis=0)
                for bucket in ngrams(starts, codes)
            )
            np.add.at(logs, owners, scores)
            np.logical_or.at(has_letters, owners, has)
    if not model.languages or not n:
        return [UNDETERMINED] * n, np.zeros(n)
    odds = np.exp(logs - logs.max(axis=1, keepdims=True))
    best = logs.argmax(axis=1)
    score = odds.max(axis=1) / odds.sum(axis=1)
    named = [model.languages[b] if has else UNDETERMINED for b, has in zip(best, has_letters, strict=True)]
    return named, np.where(has_letters, score, 0.0)


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds ``lang_pred`` and ``score``, the posterior probability, to every row.

    Only ``text`` is read; other columns pass through, but for clashing ones of
    those two names. Texts that are null or have no letters, and all texts under
    a model without languages, get ``und`` and 0. Ties go to the language that
    sorts first. Repeated rows get equal answers; an empty table stays empty.
    """
    held = docs.drop("lang_pred", "score")
    schema = T.StructType(
        [*held.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_parts(batches):
            langs, scores = score_texts(sent.value, batch.column("text").to_pylist())
            yield batch.append_column("lang_pred", pa.array(langs, pa.string())).append_column(
                "score", pa.array(scores, pa.float64())
            )

    return held.mapInArrow(predict, schema)
