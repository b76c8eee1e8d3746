"""Reproducible uniform draws: a value depends only on its key, never on the task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Constants of the public xxHash64 algorithm, and the seed from which
# Spark's function starts.
PRIMES = tuple(
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
START = np.uint64(42)


def document_key(seed: int, iteration: int, doc_id: Column) -> Column:
    """One BIGINT for a document in an iteration (0 = initial state)."""
    return F.xxhash64(
        F.xxhash64(F.lit(seed).cast("bigint"), F.lit(iteration).cast("bigint")),
        doc_id.cast("bigint"),
    )


def uniform(key: Column, term_id: Column, pos: Column) -> Column:
    """Uniform double in [0, 1) with 53 random bits for one token of a document.

    The same token gets the same number after a retry, a repartitioning or a
    restart, which keeps recomputed partitions consistent with the others.
    """
    bits = F.xxhash64(key, term_id.cast("bigint"), pos.cast("bigint"))
    return F.shiftrightunsigned(bits, 11) / F.lit(float(1 << 53))


def hash_numbers(values: np.ndarray, seeds: np.ndarray | np.uint64) -> np.ndarray:
    """xxHash64 of 64-bit numbers, as Spark's xxhash64 function chains it."""
    one, two, three, four, five = PRIMES
    with np.errstate(over="ignore"):
        h = seeds + (five + np.uint64(8)) ^ rotated(values.astype(np.int64).view(np.uint64) * two, 31) * one
        h = rotated(h, 27) * one + four
        h = (h ^ (h >> np.uint64(33))) * two
        h = (h ^ (h >> np.uint64(29))) * three
        return h ^ (h >> np.uint64(32))


def rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def document_keys(seed: int, iteration: int, docs: np.ndarray) -> np.ndarray:
    """``document_key`` in numpy."""
    first = hash_numbers(np.array([iteration]), hash_numbers(np.array([seed]), START))
    key = hash_numbers(first.view(np.int64), START)
    return hash_numbers(docs, key)


def uniforms(keys: np.ndarray, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``uniform`` in numpy."""
    h = hash_numbers(places, hash_numbers(terms, hash_numbers(keys.view(np.int64), START)))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)
