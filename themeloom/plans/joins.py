"""Joins of many rows with a table that has one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A table is broadcast only when its size is known and not above this; of a larger one
# the rows of frequent keys, as many as fit.
BROADCAST_LIMIT = 64 * 1024 * 1024


def can_broadcast(table_bytes: int | None) -> bool:
    return table_bytes is not None and table_bytes <= BROADCAST_LIMIT


def frequent_from(table: DataFrame, weight: str, table_bytes: int) -> int | None:
    """Smallest power of two such that the rows of this weight or more fit in a
    broadcast; None if there is none. Weights are told apart by their number of bits."""
    bits = F.length(F.bin(F.greatest(F.col(weight), F.lit(1)).cast("bigint"))).alias("_bits")
    counts = {row["_bits"]: row["_rows"] for row in table.groupBy(bits).agg(F.count("*").alias("_rows")).toArrow().to_pylist()}
    most = BROADCAST_LIMIT * sum(counts.values()) // max(table_bytes, 1)
    low, held = None, 0
    for size in sorted(counts, reverse=True):
        held += counts[size]
        if held > most:
            break
        low = size
    return None if low is None else 1 << (low - 1)


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    *,
    weight: str,
    spread_by: Sequence[str],
    table_bytes: int | None = None,
) -> DataFrame:
    """Inner equi-join; ``weight`` is the column of ``table`` that holds the rows per key.

    With a known size under the limit the table is broadcast. Of a larger one the
    frequent keys are, which most rows have; ``rows`` is read twice then. For the
    others, or if the size is not known, both sides are shuffled, and a key that holds
    more than one partition's share of the rows is spread over as many salts as it
    fills partitions. Fewer keys than partitions can be that heavy, which bounds the
    list that is broadcast and the rows that are repeated.
    """
    if can_broadcast(table_bytes):
        return rows.join(F.broadcast(table.drop(weight)), key)
    least = None if table_bytes is None else frequent_from(table, weight, table_bytes)
    if least is not None:
        often = table.filter(F.col(weight) >= least)
        near = rows.join(F.broadcast(often.drop(weight)), key)
        rest = rows.join(F.broadcast(often.select(key)), key, "left_anti")
        others = table.filter(F.col(weight) < least)
        return near.unionByName(lookup(rest, others, key, weight=weight, spread_by=spread_by))

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = table.agg((F.sum(weight) / partitions).alias("share")).scalar()
    fanned = table.withColumn(
        "_fan", F.greatest(F.lit(1), F.ceil(F.col(weight) / share).cast("int"))
    ).drop(weight)
    heavy = fanned.filter("_fan > 1").select(key, F.col("_fan").alias("_salts"))
    salted = rows.join(F.broadcast(heavy), key, "left").withColumn(
        "_salt",
        F.when(F.col("_salts").isNull(), 0).otherwise(
            F.pmod(F.xxhash64(*spread_by), F.col("_salts")).cast("int")
        ),
    )
    repeated = fanned.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_fan") - 1)))
    return salted.join(repeated, [key, "_salt"]).drop("_salt", "_salts", "_fan")
