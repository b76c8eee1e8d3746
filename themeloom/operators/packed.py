"""Tokens as arrays, a row for a document or a part of one.

In edge mode an entry (term_id, topic, cnt) says how many tokens of the cell of a document
and a term have a topic, if any has; the entries of a cell stand together, by topic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Arrays that stand side by side, one entry for each token, cell, or topic of a cell.
ARRAYS = ("pos", "term_id", "topic", "cnt")
# Counts of cells that are written out at a time.
CELLS_AT_ONCE = 1 << 20
COUNTS = T.ArrayType(T.LongType())


def token_rows(packed: DataFrame) -> DataFrame:
    """One row for each token or cell, in the partition of its document."""
    arrays = [name for name in packed.columns if name in ARRAYS]
    others = [name for name in packed.columns if name not in ARRAYS]
    return packed.select(*others, F.inline(F.arrays_zip(*arrays)))


def one_by_one(tokens: DataFrame) -> DataFrame:
    """Tokens or cells as arrays of one each, with the other columns."""
    others = [name for name in tokens.columns if name not in ARRAYS]
    return tokens.select(*others, *[F.array(name).alias(name) for name in tokens.columns if name in ARRAYS])


def packed_lengths(packed: DataFrame) -> DataFrame:
    """Tokens per document: (doc_id, n)."""
    sized = packed.select("doc_id", F.size("term_id").cast("bigint").alias("n")).filter("n > 0")
    return sized.groupBy("doc_id").agg(F.sum("n").alias("n"))


def flat(rows: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    """The entries of a column of arrays, one behind the other."""
    found = rows.column(name)
    parts = found.chunks if isinstance(found, pa.ChunkedArray) else [found]
    return np.concatenate([part.flatten().to_numpy() for part in parts] or [np.zeros(0, np.int64)])


def sizes(rows: pa.RecordBatch | pa.Table, name: str = "term_id") -> np.ndarray:
    found = rows.column(name)
    parts = found.chunks if isinstance(found, pa.ChunkedArray) else [found]
    return np.concatenate([part.value_lengths().to_numpy() for part in parts] or [np.zeros(0, np.int64)]).astype(np.int64)


def lists(lengths: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, values if isinstance(values, pa.Array) else pa.array(values))


def whole(values: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], values.type)


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers in order, and how often each is there."""
    codes = np.sort(codes)
    heads = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[heads], np.diff(np.append(heads, len(codes)))


def added(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers in order, and the sum of the weights of each."""
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    heads = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[heads], np.add.reduceat(weights, heads) if len(heads) else weights


def with_counts(packed: DataFrame, *names: str) -> DataFrame:
    """Some arrays of tokens, or of entries with the ``cnt`` of each."""
    return packed.select(*names, *(["cnt"] if "cnt" in packed.columns else []))


def term_topics(packed: DataFrame, k: int) -> DataFrame:
    """(term_id, topic, n) of tokens or entries, counted for many documents at once; a pair
    may have several rows."""
    kind = packed.schema["term_id"].dataType.elementType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            codes = flat(rows, "term_id").astype(np.int64) * k + flat(rows, "topic")
            codes, n = added(codes, flat(rows, "cnt")) if "cnt" in rows.schema.names else counted(codes)
            terms = pa.array(codes // k).cast(rows.column("term_id").type.value_type)
            columns = [terms, pa.array((codes % k).astype(np.int32)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["term_id", "topic", "n"])

    told = with_counts(packed, "term_id", "topic")
    return told.mapInArrow(work, f"term_id {kind}, topic INT, n BIGINT")


def held_terms(packed: DataFrame) -> DataFrame:
    """(bucket, term_id) of the terms of tokens; a pair may have several rows."""
    kind = packed.schema["term_id"].dataType.elementType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            buckets = rows.column("bucket").to_numpy()
            terms, sized = flat(rows, "term_id"), np.cumsum(np.append(0, sizes(rows)))
            for bucket in np.unique(buckets):
                own = np.flatnonzero(buckets == bucket)
                held, _ = counted(np.concatenate([terms[sized[i] : sized[i + 1]] for i in own]))
                ids = pa.array(held).cast(rows.column("term_id").type.value_type)
                columns = [pa.array(np.full(len(held), bucket)), ids]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "term_id"])

    return packed.select("bucket", "term_id").mapInArrow(work, f"bucket BIGINT, term_id {kind}")


def packed_cells(packed: DataFrame) -> DataFrame:
    """Tokens of the terms of every row, (doc_id, term_id, cnt), the last two arrays. A
    document in several rows has cells in each."""
    kind = packed.schema["term_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            names, term = np.unique(flat(rows, "term_id"), return_inverse=True)
            row = np.repeat(np.arange(rows.num_rows), sizes(rows))
            codes, n = counted(row * max(len(names), 1) + term)
            held = np.bincount(codes // max(len(names), 1), minlength=rows.num_rows)
            terms = pa.array(names[codes % max(len(names), 1)]).cast(rows.column("term_id").type.value_type)
            columns = [rows.column("doc_id"), lists(held, terms), lists(held, n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "term_id", "cnt"])

    doc = packed.schema["doc_id"].dataType.simpleString()
    return packed.select("doc_id", "term_id").mapInArrow(work, f"doc_id {doc}, term_id {kind}, cnt ARRAY<BIGINT>")


def topics_by_row(rows: pa.RecordBatch, k: int) -> pa.ListArray:
    """Tokens by topic of every row of tokens or entries."""
    code = np.repeat(np.arange(rows.num_rows), sizes(rows, "topic")) * k + flat(rows, "topic")
    if "cnt" not in rows.schema.names:
        n = np.bincount(code, minlength=rows.num_rows * k).astype(np.int64)
    else:
        n = np.zeros(rows.num_rows * k, np.int64)
        np.add.at(n, code, flat(rows, "cnt"))
    return lists(np.full(rows.num_rows, k), n)


def document_topics(packed: DataFrame, k: int) -> DataFrame:
    """(doc_id, n ARRAY) of the tokens or entries of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            columns = [rows.column("doc_id"), topics_by_row(rows, k)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n"])

    kind = packed.schema["doc_id"].dataType.simpleString()
    return with_counts(packed, "doc_id", "topic").mapInArrow(work, f"doc_id {kind}, n ARRAY<BIGINT>")


def with_topics(packed: DataFrame, k: int) -> DataFrame:
    """Adds ``nd``, the tokens by topic of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield rows.append_column("nd", topics_by_row(rows, k))

    return packed.mapInArrow(work, T.StructType([*packed.schema, T.StructField("nd", COUNTS)]))


def cell_heads(row: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Where the cells of entries begin, given the rows and terms of these."""
    return np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (terms[1:] != terms[:-1]))[: len(row)])


def cell_rows(packed: DataFrame, k: int) -> DataFrame:
    """One row for each cell of entries, with all its counts: the other columns, term_id,
    cnt and n ARRAY. Made in the partition of its document, CELLS_AT_ONCE // k at a time."""
    others = [name for name in packed.columns if name not in ARRAYS]
    step = max(64, CELLS_AT_ONCE // k)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            row, terms = np.repeat(np.arange(rows.num_rows), sizes(rows)), flat(rows, "term_id")
            topics, n = flat(rows, "topic"), flat(rows, "cnt")
            heads = np.append(cell_heads(row, terms), len(row))
            for start in range(0, len(heads) - 1, step):
                own = heads[start : start + step + 1]
                part, size = slice(own[0], own[-1]), np.diff(own)
                dense = np.zeros((len(size), k), np.int64)
                dense[np.repeat(np.arange(len(size)), size), topics[part]] = n[part]
                told = rows.select(others).take(pa.array(row[own[:-1]]))
                cells = [pa.array(terms[own[:-1]]), pa.array(dense.sum(axis=1)), lists(np.full(len(size), k), dense.ravel())]
                yield pa.RecordBatch.from_arrays([*told.columns, *cells], names=[*others, "term_id", "cnt", "n"])

    kinds = [T.StructField("term_id", packed.schema["term_id"].dataType.elementType), T.StructField("cnt", T.LongType())]
    schema = T.StructType([*[packed.schema[name] for name in others], *kinds, T.StructField("n", COUNTS)])
    return packed.select(*others, "term_id", "topic", "cnt").mapInArrow(work, schema)


def pack(rows: DataFrame) -> DataFrame:
    """The reverse of ``token_rows``: the tokens or entries of each bucket, one row for each
    document or chunk of it. Entries come by term and topic, tokens by term and place."""
    arrays = [name for name in rows.columns if name in ARRAYS]
    order = ["doc_id", "chunk", "term_id", "pos" if "pos" in arrays else "topic"]

    def work(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [(name, "ascending") for name in order])).combine_chunks()
        heads = row_heads(group)
        firsts = group.select(["bucket", "doc_id", "chunk"]).take(pa.array(heads))
        held = np.diff(np.append(heads, group.num_rows))
        columns = {name: lists(held, whole(group.column(name))) for name in arrays}
        return pa.table({name: firsts.column(name) for name in firsts.column_names} | columns)

    kinds = [T.StructField(name, T.ArrayType(rows.schema[name].dataType)) for name in arrays]
    schema = T.StructType([*[rows.schema[name] for name in ("bucket", "doc_id", "chunk")], *kinds])
    return rows.select("bucket", "doc_id", "chunk", *arrays).groupBy("bucket").applyInArrow(work, schema)


def row_heads(rows: pa.Table) -> np.ndarray:
    """Where another document or chunk begins, in rows sorted by these."""
    doc = whole(rows.column("doc_id")).dictionary_encode(null_encoding="encode").indices.to_numpy()
    chunk = rows.column("chunk").to_numpy()
    return np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (chunk[1:] != chunk[:-1]))[: len(doc)])
