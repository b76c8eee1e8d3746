"""The first topic of every token."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.uniform import document_key, uniform, uniforms
from themeloom.operators.buckets import BLOCK_CELLS, copies
from themeloom.operators.packed import added, counted, flat, lists, row_heads, sizes

# Copies of a cell are generated in blocks of this many.
BLOCK = 1 << 20


def expand_bag(bag: DataFrame, largest: int | None = None) -> DataFrame:
    """One row per token of a bag: (doc_id, term_id, pos), pos = 0 .. cnt - 1.

    ``pos`` numbers the copies of a term inside its document, so the key of a
    token is (doc_id, term_id, pos) and no running sum over a document is
    needed. Unless the ``largest`` count is known to fit in one block, counts
    are cut in blocks that are dealt out over the tasks before they are
    expanded.
    """
    others = [column for column in bag.columns if column != "cnt"]
    if largest is not None and largest <= BLOCK:
        ranges = bag.select(
            *others, F.lit(0).cast("bigint").alias("_first"), (F.col("cnt") - 1).alias("_last")
        )
    else:
        ranges = cut_blocks(bag).select(*others, "_first", "_last")
    return ranges.select(*others, F.explode(F.sequence("_first", "_last")).alias("pos"))


def cut_blocks(bag: DataFrame) -> DataFrame:
    """One row per block of copies, with the ``_first`` and ``_last`` of them."""
    number = F.floor((F.col("cnt") - 1) / BLOCK)
    first = F.col("_block") * BLOCK
    return (
        bag.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), number)).alias("_block"))
        .repartition("doc_id", "term_id", "_block")
        .withColumn("_first", first)
        .withColumn("_last", F.least(first + BLOCK, F.col("cnt")) - 1)
        .drop("_block")
    )


def init_cells(bag: DataFrame, k: int, seed: int, largest: int) -> DataFrame:
    """Entries of every cell when each of its tokens starts at a random topic: the columns
    of ``bag`` with another ``cnt``, and ``topic``.

    Cells up to one block are expanded and counted again where they are.
    """
    keys = [column for column in bag.columns if column != "cnt"]

    def counted(tokens: DataFrame) -> DataFrame:
        return init_assignments(tokens, k, seed).groupBy(*keys, "topic").agg(F.count("*").alias("cnt"))

    if largest <= BLOCK:
        return counted(expand_bag(bag, largest))
    return counted(expand_bag(bag.filter(F.col("cnt") <= BLOCK), BLOCK)).unionByName(
        counted(expand_bag(bag.filter(F.col("cnt") > BLOCK)))
    )


def expand_cells(cells: DataFrame) -> DataFrame:
    """One row per token of cells (doc_id, term_id, n ARRAY): (doc_id, pos, term_id,
    topic), a cell's tokens in the order of their topics."""
    before = F.aggregate(
        F.slice("n", 1, F.col("topic")), F.lit(0).cast("bigint"), lambda total, n: total + n
    )
    topics = cells.select("doc_id", "term_id", "n", F.posexplode("n").alias("topic", "_count"))
    ranges = topics.filter("_count > 0").withColumn("_before", before)
    last = F.floor((F.col("_count") - 1) / BLOCK)
    blocks = ranges.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    first = F.col("_block") * BLOCK
    end = F.least(first + BLOCK, F.col("_count")) - 1
    copies = F.explode(F.sequence(F.col("_before") + first, F.col("_before") + end)).alias("pos")
    return blocks.select("doc_id", copies, "term_id", "topic")


def init_packed(placed: DataFrame, k: int, seed: int) -> DataFrame:
    """First topics of the tokens of each bucket, one row for each document or chunk of it:
    (bucket, doc_id, chunk, pos, term_id, topic), the last three arrays.

    ``placed`` holds the tokens of a document in one or more rows of arrays.
    """
    pos, term = (placed.schema[name].dataType.simpleString() for name in ("pos", "term_id"))

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("chunk", "ascending")])).combine_chunks()
        lengths, heads = sizes(rows), row_heads(rows)
        keys = np.repeat(rows.column("_key").to_numpy().astype(np.uint64), lengths)
        terms, places = flat(rows, "term_id"), flat(rows, "pos")
        topics = np.floor(uniforms(keys, terms, places) * k).astype(np.int32)
        firsts = rows.select(["bucket", "doc_id", "chunk"]).take(pa.array(heads))
        of_docs = np.add.reduceat(lengths, heads)
        arrays = {name: lists(of_docs, values) for name, values in (("pos", places), ("term_id", terms), ("topic", topics))}
        return pa.table({name: firsts.column(name) for name in firsts.column_names} | arrays)

    keyed = placed.filter(F.size("term_id") > 0).withColumn("_key", document_key(seed, 0, F.col("doc_id")))
    schema = f"bucket BIGINT, doc_id BIGINT, chunk INT, pos {pos}, term_id {term}, topic ARRAY<INT>"
    return keyed.groupBy("bucket").applyInArrow(work, schema)


def init_packed_cells(placed: DataFrame, k: int, seed: int) -> DataFrame:
    """First topics of the cells of each bucket, from arrays of terms and counts, one row for
    each document or chunk of it: (bucket, doc_id, chunk, term_id, topic, cnt), the last three
    arrays of entries. The copies of a cell are drawn in blocks and never are rows."""
    term = placed.schema["term_id"].dataType.simpleString()

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("chunk", "ascending")])).combine_chunks()
        heads, lengths = row_heads(rows), sizes(rows)
        of_row = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, rows.num_rows)))
        own, terms = np.repeat(of_row, lengths), flat(rows, "term_id")
        low = int(terms.min(initial=0))
        span = int(terms.max(initial=0)) - low + 1
        # The cells of a document in several rows come together.
        pair, count = added(own * span + (terms - low), flat(rows, "cnt"))
        own, terms = pair // span, (pair % span + low).astype(terms.dtype)
        keys = rows.column("_key").to_numpy().astype(np.uint64)[heads]
        codes, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for cell, copy in copies(count, BLOCK_CELLS):
            topic = np.floor(uniforms(keys[own[cell]], terms[cell], copy) * k).astype(np.int64)
            for found, told in zip((codes, n), counted(cell * k + topic), strict=True):
                found.append(told)
        # A cell may go on in the next block.
        code, n = added(np.concatenate(codes), np.concatenate(n))
        cell = code // k
        firsts = rows.select(["bucket", "doc_id", "chunk"]).take(pa.array(heads))
        held = np.bincount(own[cell], minlength=len(heads))
        arrays = (("term_id", terms[cell]), ("topic", (code % k).astype(np.int32)), ("cnt", n))
        columns = {name: lists(held, values) for name, values in arrays}
        return pa.table({name: firsts.column(name) for name in firsts.column_names} | columns)

    keyed = placed.filter(F.size("term_id") > 0).withColumn("_key", document_key(seed, 0, F.col("doc_id")))
    schema = f"bucket BIGINT, doc_id BIGINT, chunk INT, term_id {term}, topic ARRAY<INT>, cnt ARRAY<BIGINT>"
    return keyed.groupBy("bucket").applyInArrow(work, schema)


def init_assignments(tokens: DataFrame, k: int, seed: int) -> DataFrame:
    """Uniform random topic for each token: (doc_id, pos, term_id, topic)."""
    u = uniform(document_key(seed, 0, F.col("doc_id")), F.col("term_id"), F.col("pos"))
    return tokens.withColumn("topic", F.floor(u * F.lit(float(k))).cast("int"))
