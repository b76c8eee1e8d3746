"""Numeric helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Width of the bands in which exponentials are summed; exp(64) * 2^63 is finite.
BAND = 64.0

# Coefficients of 1/x^2, 1/x^4, ... in the asymptotic series of
# the digamma function, -B(2n) / 2n.
DIGAMMA_SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132)
# The recurrence digamma(x) = digamma(x + 1) - 1/x is applied this often first.
DIGAMMA_STEPS = 6


def digamma(x: Column) -> Column:
    """Digamma for x > 0: recurrence to x + 6, then the asymptotic series."""
    shift = F.lit(0.0)
    for step in range(DIGAMMA_STEPS):
        shift = shift + F.lit(1.0) / (x + F.lit(float(step)))
    y = x + F.lit(float(DIGAMMA_STEPS))
    inverse_square = F.lit(1.0) / (y * y)
    series = F.lit(0.0)
    for coefficient in reversed(DIGAMMA_SERIES):
        series = (series + F.lit(coefficient)) * inverse_square
    return F.ln(y) - F.lit(0.5) / y + series - shift


def log_sum_exp(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Overflow-safe log of the sum of exponentials per key: (key, log_sum_exp).

    Values are summed in bands of fixed width, so the rows of a key are
    partially aggregated before the shuffle and never joined to their maximum.
    What is joined to its key's highest band is a band, (base, sum), of which there
    are as many as the values of the key span, and all of them are added.
    """
    x = F.col(value).cast("double")
    infinite = F.abs(x) == F.lit(float("inf"))
    base = F.when(infinite, x).otherwise(x - F.pmod(x, F.lit(BAND)))
    banded = rows.select(F.col(key), x.alias("_x"), base.alias("_base"))
    above = F.when(F.col("_x") == F.col("_base"), 1.0).otherwise(F.exp(F.col("_x") - F.col("_base")))
    bands = banded.groupBy(key, "_base").agg(F.sum(above).alias("_sum"))
    # One shuffle by key serves both sides of the join.
    bands = bands.repartition(key)
    tops = bands.groupBy(key).agg(F.max("_base").alias("_top")).withColumnRenamed(key, "_key")
    met = bands.join(tops, F.col(key).eqNullSafe(F.col("_key")))
    scale = F.when(F.col("_base") == F.col("_top"), 1.0).otherwise(F.exp(F.col("_base") - F.col("_top")))
    sums = met.groupBy(key, "_top").agg(F.sum(F.col("_sum") * scale).alias("_sum"))
    # As in the sum over values less their maximum, minus infinity alone gives NaN.
    lowest = F.col("_top") == F.lit(float("-inf"))
    found = F.when(lowest, F.lit(float("nan"))).otherwise(F.col("_top") + F.ln("_sum"))
    return sums.select(key, found.alias("log_sum_exp"))


def dirichlet_expectation(
    rows: DataFrame, row_id: str = "row_id", alpha: str = "alpha"
) -> DataFrame:
    """Adds ``e_log_theta`` = digamma(alpha) - digamma(sum of alpha in the row)."""
    totals = rows.groupBy(row_id).agg(F.sum(F.col(alpha).cast("double")).alias("_total"))
    totals = totals.select(row_id, digamma(F.col("_total")).alias("_digamma_total"))
    # A row of very many entries is a skewed key of the join, which adaptive execution splits.
    return rows.join(totals, row_id).select(
        *rows.columns,
        (digamma(F.col(alpha).cast("double")) - F.col("_digamma_total")).alias("e_log_theta"),
    )
