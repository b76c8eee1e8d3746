"""Vectors: which take part, and classes of equal ones. DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null or empty, not zero, and no null or non-finite component."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def doubles(vector: str) -> Column:
    """Components as doubles; minus zero is zero."""
    return F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0))


def most_common_size(rows: DataFrame, vector: str) -> int:
    """Number of components that most vectors have, the smallest of equals; 0 if none."""
    sizes = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return next((row.d for row in sizes.toLocalIterator()), 0)


def name_of(*columns: Column | str) -> Column:
    """128 bits that tell different values apart."""
    return F.struct(F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *columns).alias("h2"))
