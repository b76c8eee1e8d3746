"""Approximate nearest neighbours by inner product: shifted Hilbert curves.

Vectors and queries are projected on random directions, a set of them for each
curve, shifted, and ordered along a Hilbert curve. Every curve is cut in BLOCKS
key ranges of equal size; a query meets the candidates of the ranges around its
own, and the best of all curves are merged. Ranges are shares of the table, so
recall does not depend on its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.vectors import doubles, most_common_size, name_of, usable
from themeloom.plans.joins import lookup
from themeloom.plans.scratch import Scratch

# Curves, key ranges of a curve, and ranges on either side that a query visits.
CURVES, BLOCKS, REACH = 6, 16, 3
# Projected dimensions and bits of each in a key.
AXES, BITS = 6, 10
# A range has at least so many vectors; a piece of work compares at most about so
# many questions with at most about so many candidates.
LEAST_BLOCK, MOST_VECTORS = 64, 8192
SEED = 20240611


@dataclass(frozen=True)
class Curves:
    """Projection and shift of each curve, and the scale of the table."""

    directions: np.ndarray  # curve, component, axis; one more component for the norm
    shifts: np.ndarray  # curve, axis
    longest: float  # norm of the longest candidate
    spread: float  # root mean square of a projected coordinate


def make_curves(size: int, longest: float, seed: int = SEED) -> Curves:
    rng = np.random.default_rng(seed)
    axes = min(AXES, size + 1)
    directions = np.stack([np.linalg.qr(rng.normal(size=(size + 1, axes)))[0] for _ in range(CURVES)])
    return Curves(directions, rng.uniform(0, 0.25, (CURVES, axes)), longest, longest / math.sqrt(size + 1))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of cells (n, axes) of ``bits`` bits each."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    level = 1 << (bits - 1)
    while level > 1:  # turn each quadrant so that the curve enters where it left
        low = level - 1
        for i in range(axes):
            high = (x[i] & level) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, axes):  # Gray code along the axes
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[-1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(curves: Curves, curve: int, vectors: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Keys of vectors whose extra component is ``last``."""
    projected = vectors @ curves.directions[curve][:-1] + np.outer(last, curves.directions[curve][-1])
    scaled = projected / (6 * curves.spread) + 0.375 + curves.shifts[curve]
    cells = np.clip(np.floor(scaled * (1 << BITS)), 0, (1 << BITS) - 1)
    return hilbert_keys(cells, BITS)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def keyed(rows: DataFrame, curves: Curves, queries: bool) -> DataFrame:
    """Adds (curve, key), a row for each curve. An extra component makes all
    candidates equally long, so that the nearest is the one of largest inner
    product; queries have 0 there and are scaled to the same length."""
    sent = rows.sparkSession.sparkContext.broadcast(curves)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("v"))
            norms = np.linalg.norm(vectors, axis=1)
            longest = sent.value.longest
            if queries:
                vectors, last = vectors * (longest / norms)[:, None], np.zeros(len(norms))
            else:
                last = np.sqrt(np.maximum(longest**2 - norms**2, 0))
            for curve in range(CURVES):
                keys = curve_keys(sent.value, curve, vectors, last)
                yield batch.append_column("curve", pa.array([curve] * len(keys), pa.int32())).append_column(
                    "key", pa.array(keys, pa.int64())
                )

    schema = rows.select("*", F.lit(0).alias("curve"), F.lit(0).cast("bigint").alias("key")).schema
    return rows.mapInArrow(work, schema)


def ranged(rows: DataFrame, bounds: dict[int, list[int]]) -> DataFrame:
    """Adds ``block``, the number of bounds of the curve that the key exceeds."""
    block = F.lit(0)
    for curve, limits in bounds.items():
        above = F.lit(0)
        for limit in limits:
            above = above + (F.col("key") > limit).cast("int")
        block = F.when(F.col("curve") == curve, above).otherwise(block)
    return rows.withColumn("block", block)


def nearest(
    rows: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 20, vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` candidates of largest inner product
    found for each query, largest first, ties to the smaller vec_id.

    ``rows`` and ``queries`` have (vec_id, ``vector``); other columns are ignored.
    All rows are candidates but those with the query's own vec_id. Vectors that
    are null, empty or zero, hold null or non-finite components, or have another
    number of components than most rows, and rows without vec_id, take no part.
    Rows that repeat a vec_id with the same vector count once; with another
    vector they are candidates or queries of their own. With ``k`` candidates or
    fewer all are returned; an empty table gives no rows.

    Equal vectors are one candidate, of which the ``k + 1`` smallest ids are
    kept, as no query can need more of them.
    """

    def taking_part(table: DataFrame) -> DataFrame:
        told = table.select("vec_id", F.col(vector).alias("raw")).filter(F.col("vec_id").isNotNull() & usable("raw"))
        return told.select("vec_id", doubles("raw").alias("v"))

    size = most_common_size(taking_part(rows), "v")
    own = F.size("v") == size
    vectors = taking_part(rows).filter(own).withColumn("name", name_of("v")).dropDuplicates(["vec_id", "name"])
    first = Window.partitionBy("name").orderBy("vec_id")
    members = vectors.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    candidates = scratch.keep(
        members.groupBy("name").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")),
        "candidates",
    )
    asked = taking_part(queries).filter(own).withColumn("name", name_of("v")).dropDuplicates(["vec_id", "name"])
    asked = scratch.keep(asked, "queries")
    questions = scratch.keep(asked.groupBy("name").agg(F.first("v").alias("v"), F.count("*").alias("asking")), "questions")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    total, longest = candidates.agg(F.count("*"), F.sqrt(F.max(square))).first()
    curves = make_curves(size, float(longest or 1.0))
    placed = scratch.keep(keyed(candidates.select("name", "v", "ids"), curves, False), "placed")
    blocks = max(1, min(BLOCKS, total // LEAST_BLOCK))
    shares = [i / blocks for i in range(1, blocks)]
    bounds = {curve: [] for curve in range(CURVES)}
    if shares:
        cuts = placed.groupBy("curve").agg(F.percentile_approx("key", shares, 10_000).alias("cuts"))
        bounds = {row.curve: row.cuts for row in cuts.toLocalIterator()}
    salts = max(1, math.ceil(total / blocks / MOST_VECTORS))
    # Questions can crowd in one range, so all of them are counted.
    chunks = max(1, math.ceil(questions.count() / MOST_VECTORS))
    targets = (
        ranged(placed, bounds)
        .withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(salts)).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    )
    visits = 2 * REACH + 1
    from_block = F.greatest(F.lit(0), F.least(F.col("block") - REACH, F.lit(blocks - visits)))
    asking = (
        ranged(keyed(questions.select("name", "v"), curves, True), bounds)
        .withColumn("from", from_block)
        .withColumn("block", F.explode(F.sequence("from", F.least(F.col("from") + visits - 1, F.lit(blocks - 1)))))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        .withColumn("chunk", F.pmod(F.xxhash64("name"), F.lit(chunks)).cast("int"))
    )

    wanted = k + 1  # one of them may be the query's own vector

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        asks, has = matrix(left.column("v").combine_chunks()), matrix(right.column("v").combine_chunks())
        least = np.array([ids[0].as_py() for ids in right.column("ids")])
        who, whom, scores = [], [], []
        for start in range(0, len(asks) if len(has) else 0, 256):
            some = asks[start : start + 256] @ has.T
            for i, row in enumerate(some):
                keep = np.arange(len(row))
                if len(row) > wanted:
                    keep = np.flatnonzero(row >= np.partition(row, -wanted)[-wanted] - 1e-9 * (1 + abs(row).max()))
                exact = (asks[start + i] * has[keep]).sum(axis=1)
                best = np.lexsort((least[keep], -exact))[:wanted]
                who += [start + i] * len(best)
                whom += keep[best].tolist()
                scores += exact[best].tolist()
        names = [left.column("name").take(pa.array(who, pa.int64())), right.column("name").take(pa.array(whom, pa.int64()))]
        return pa.table(
            {"question": names[0], "name": names[1], "score": pa.array(scores, pa.float64()),
             "ids": right.column("ids").take(pa.array(whom, pa.int64()))}
        )

    kind = rows.schema["vec_id"].dataType.simpleString()
    piece = ["curve", "block", "salt", "chunk"]
    found = asking.groupBy(*piece).cogroup(targets.groupBy(*piece)).applyInArrow(
        search, f"question struct<h1:bigint,h2:bigint>, name struct<h1:bigint,h2:bigint>, score double, ids array<{kind}>"
    )
    once = found.groupBy("question", "name").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    best = Window.partitionBy("question").orderBy(F.desc("score"), F.col("ids")[0])
    merged = once.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= wanted)
    lists = merged.groupBy("question").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    lists = scratch.keep(lists.join(questions.select(F.col("name").alias("question"), "asking"), "question"), "lists")
    answered = lookup(
        asked.select(F.col("name").alias("question"), F.col("vec_id").alias("query_id")),
        lists, "question", weight="asking", spread_by=["query_id"],
    )
    each = F.flatten(
        F.transform(
            "near",
            lambda n: F.transform(
                n["ids"], lambda i: F.struct((-n["score"]).alias("minus"), i.alias("vec_id"))
            ),
        )
    )
    others = F.filter(each, lambda x: x["vec_id"] != F.col("query_id"))
    ranked = answered.select("query_id", F.posexplode(F.slice(F.array_sort(others), 1, k)).alias("at", "n"))
    return ranked.select(
        "query_id", (F.col("at") + 1).alias("rank"), "n.vec_id", (-F.col("n.minus")).alias("score")
    )
