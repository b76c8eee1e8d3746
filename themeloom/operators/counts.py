"""Topic counts: long form for results, one array per key inside a sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Up to this many topics, one aggregate per topic is compiled.
COUNTED = 64

GRAINS = {"term": ["term_id"], "doc_term": ["doc_id", "term_id"]}


def grain_keys(grain: str) -> list[str]:
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {sorted(GRAINS)}, not {grain!r}")
    return GRAINS[grain]


def word_topic_counts(state: DataFrame, grain: str = "term") -> DataFrame:
    """Tokens per (term, topic), or per (document, term, topic): n > 0 only."""
    return state.groupBy(*grain_keys(grain), "topic").agg(F.count("*").alias("n"))


def doc_topic_counts(state: DataFrame) -> DataFrame:
    """Tokens per (document, topic): n > 0 only."""
    return state.groupBy("doc_id", "topic").agg(F.count("*").alias("n"))


def doc_lengths(state: DataFrame) -> DataFrame:
    """Tokens per document: (doc_id, n)."""
    return state.groupBy("doc_id").agg(F.count("*").alias("n"))


def topic_totals(state: DataFrame, k: int) -> DataFrame:
    """Tokens per topic, empty topics included: (topic, n)."""
    return spread(topic_vector(state, [], k))


def topic_vector(state: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Counts of tokens per key as ``n`` ARRAY<BIGINT> of length k.

    Partial aggregation runs before the shuffle, so a term or document that
    holds a large part of the tokens costs one row per task.
    """
    if k <= COUNTED:
        counts = ", ".join(f"count_if(topic = {topic})" for topic in range(k))
        return state.groupBy(*keys).agg(F.expr(f"array({counts})").alias("n"))
    # Pre-aggregated to (keys, topic), then one array slot per topic.
    wide = state.groupBy(*keys).pivot("topic", list(range(k))).agg(F.count(F.lit(1)))
    slots = [F.coalesce(F.col(f"`{topic}`"), F.lit(0)).cast("bigint") for topic in range(k)]
    return wide.select(*keys, F.array(*slots).alias("n"))


def topic_sums(counted: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """``topic_vector`` of counts (keys, topic, n)."""
    if k <= COUNTED:
        sums = ", ".join(f"coalesce(sum(n) filter (where topic = {topic}), 0)" for topic in range(k))
        return counted.groupBy(*keys).agg(F.expr(f"array({sums})").alias("n"))
    wide = counted.groupBy(*keys).pivot("topic", list(range(k))).agg(F.sum("n"))
    slots = [F.coalesce(F.col(f"`{topic}`"), F.lit(0)).cast("bigint") for topic in range(k)]
    return wide.select(*keys, F.array(*slots).alias("n"))


def add_vectors(vectors: DataFrame, keys: Sequence[str], k: int, *more: Column) -> DataFrame:
    """Sums of the arrays ``n`` per key."""
    sums = ", ".join(f"coalesce(sum(get(n, {topic})), 0)" for topic in range(k))
    return vectors.groupBy(*keys).agg(F.expr(f"array({sums})").alias("n"), *more)


def spread(vectors: DataFrame, name: str = "n") -> DataFrame:
    """Array column to long form: the other columns, topic, value."""
    others = [column for column in vectors.columns if column != name]
    return vectors.select(*others, F.posexplode(name).alias("topic", name))


def vector_sum(name: str) -> Column:
    """Sum of an ARRAY<BIGINT>."""
    return F.aggregate(name, F.lit(0).cast("bigint"), lambda total, n: total + n)


def zeros(k: int) -> Column:
    return F.array_repeat(F.lit(0).cast("bigint"), k)


def numbers(spark: SparkSession, values: Sequence[int]) -> DataFrame:
    """(topic, n) of totals the driver already holds: one number per topic."""
    array = F.lit(list(values)).cast("array<bigint>")
    return spark.range(1).select(F.posexplode(array).alias("topic", "n"))
