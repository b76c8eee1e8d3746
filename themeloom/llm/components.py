"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.plans.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): the smallest node of its
    component. Edges with a null end, loops and repeats change nothing.

    Each round every node points to the smallest node next to it, pointers are
    followed to their ends, and the edges between ends are the next round's; the
    number of rounds grows with the logarithm of the nodes. Everything is stored
    in between, and only row counts reach the driver.
    """
    run = uuid.uuid4().hex[:8]
    step = 0

    def keep(rows: DataFrame) -> DataFrame:
        nonlocal step
        step += 1
        return scratch.keep(rows, f"components-{run}-{step}")

    def simple(rows: DataFrame) -> DataFrame:
        ends = rows.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return keep(ends.distinct())

    left = simple(edges)
    roots = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = keep(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("to")))
        while True:
            ends = points.select(F.col("a").alias("to"), F.col("to").alias("end"))
            further = points.join(ends, "to").select("a", F.col("end").alias("to"), (F.col("end") < F.col("to")).alias("moved"))
            further = keep(further)
            points = further.drop("moved")
            if further.filter("moved").isEmpty():
                break
        if roots is None:
            roots = points.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            newer = points.select(F.col("a").alias("root"), F.col("to").alias("end"))
            roots = keep(
                roots.join(newer, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
            )
        to_a = points.select("a", F.col("to").alias("ta"))
        to_b = points.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        left = simple(
            left.join(to_a, "a").join(to_b, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
        )
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
