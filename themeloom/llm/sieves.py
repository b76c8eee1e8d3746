"""Tables of bits in a driver's and workers' memory, of a size set beforehand: they
tell which keys cannot be in a set, however large the set is."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a table.
SIEVE_BITS = 1 << 27


def sieve_bits(keys: DataFrame, key: str, bits: int = SIEVE_BITS, **kinds: Column) -> dict[str, np.ndarray]:
    """One table per kind: the bits of the keys (BIGINT) for which it holds. At most
    bits / 64 rows reach the driver."""
    bit = F.expr(f"shiftleft(1L, cast({key} & 63L AS INT))")
    word = F.shiftright(F.col(key).bitwiseAND(F.lit(bits - 1)), 6).alias("word")
    none = F.lit(0).cast("bigint")
    told = keys.groupBy(word).agg(*[F.bit_or(F.when(kind, bit).otherwise(none)).alias(name) for name, kind in kinds.items()])
    words = told.toArrow()
    tables = {}
    for name in kinds:
        tables[name] = np.zeros(bits >> 6, np.int64)
        tables[name][words.column("word").to_numpy()] = words.column(name).to_numpy()
    return tables


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that were not put in."""
    word = table[(keys & (64 * len(table) - 1)) >> 6]
    return (word >> (keys & 63)) & 1 == 1
