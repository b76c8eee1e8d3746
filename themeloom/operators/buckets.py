"""Work on one bucket of documents at a time, in numpy.

A bucket holds whole documents (or whole chunks of very long ones) and is one
partition of a table bucketed by its name. The count vectors of just the terms
it holds are sent to it, once each; tokens stay where they are. Vectors are
sparse: a cell is ``count * k + topic``, so a rare term costs little however
many topics there are, and rows become dense for a few thousand tokens at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.operators.packed import cell_heads, flat, lists, sizes

# Numbers in a dense matrix of a block of rows.
BLOCK_CELLS = 1 << 18
# What a vector belongs to.
TERM, DOCUMENT = 0, 1

VECTORS = "bucket BIGINT, kind INT, id BIGINT, cells ARRAY<BIGINT>"


def sparse_cells(name: str, k: int) -> Column:
    """Non-zero entries of an ARRAY<BIGINT> of k counts as ``count * k + topic``."""
    coded = F.transform(name, lambda n, topic: n * F.lit(k).cast("bigint") + topic)
    return F.filter(coded, lambda cell: cell >= k)


def term_vectors(words: DataFrame, routes: DataFrame, k: int) -> DataFrame:
    """Vectors of the terms of every bucket, from counts (term_id, n) and the table
    (term_id, bucket) of what each bucket holds."""
    sparse = words.select("term_id", sparse_cells("n", k).alias("cells"))
    return routes.join(sparse, "term_id").select(
        "bucket", F.lit(TERM).alias("kind"), F.col("term_id").cast("bigint").alias("id"), "cells"
    )


def document_vectors(docs: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """Vectors of documents in several buckets, from counts (doc_id, n) and the table
    (doc_id, bucket)."""
    sparse = docs.select("doc_id", sparse_cells("n", k).alias("cells"))
    return places.join(sparse, "doc_id").select(
        "bucket", F.lit(DOCUMENT).alias("kind"), F.col("doc_id").alias("id"), "cells"
    )


def no_vectors(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame([], VECTORS)


@dataclass(frozen=True)
class Counts:
    """Sparse rows of counts by topic, by sorted id."""

    ids: np.ndarray
    starts: np.ndarray
    topics: np.ndarray
    values: np.ndarray
    k: int

    @staticmethod
    def of_cells(ids: np.ndarray, cells: pa.ListArray, k: int) -> Counts:
        starts = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(np.asarray(cells.value_lengths().fill_null(0)), out=starts[1:])
        flat = cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(ids, kind="stable")
        sizes = np.diff(starts)[order]
        moved = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=moved[1:])
        flat = flat[ramps(starts[:-1][order], sizes)]
        return Counts(ids[order], moved, flat % k, flat // k, k)

    @staticmethod
    def of_tokens(ids: np.ndarray, topics: np.ndarray, k: int, weights: np.ndarray | None = None) -> Counts:
        """Counted from one (id, topic) each, or from weights of them."""
        names, row = np.unique(ids, return_inverse=True)
        codes, at = np.unique(row * k + topics, return_inverse=True)
        values = np.bincount(at, minlength=len(codes)) if weights is None else whole_sums(at, weights, len(codes))
        starts = np.searchsorted(codes, np.arange(len(names) + 1) * k)
        return Counts(names, starts, codes % k, values, k)

    def rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different ones of ``ids``, their dense counts, and the row of each id."""
        names, row = np.unique(ids, return_inverse=True)
        at = np.searchsorted(self.ids, names)
        sizes = self.starts[at + 1] - self.starts[at]
        cells = ramps(self.starts[at], sizes)
        dense = np.zeros((len(names), self.k), np.int64)
        dense[np.repeat(np.arange(len(names)), sizes), self.topics[cells]] = self.values[cells]
        return names, dense, row


def ramps(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one behind the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(before - starts, sizes)


def copies(count: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The copies 0 .. count - 1 of cells, ``step`` at a time: their cells, their numbers."""
    ends = np.cumsum(count)
    for start in range(0, int(ends[-1]) if len(ends) else 0, step):
        stop = min(start + step, int(ends[-1]))
        first, last = np.searchsorted(ends, [start, stop - 1], side="right")
        own = slice(first, last + 1)
        low = np.maximum(start - (ends - count)[own], 0)
        high = np.minimum(stop - (ends - count)[own], count[own])
        yield np.repeat(np.arange(first, last + 1), high - low), ramps(low, high - low)


def whole_sums(at: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    sums = np.zeros(size, np.int64)
    np.add.at(sums, at, weights)
    return sums


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def matrix(table: pa.Table, name: str, k: int) -> np.ndarray:
    """A column of arrays of k numbers."""
    flat = table.column(name).combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(-1, k)


@dataclass(frozen=True)
class Cells:
    """Cells one behind the other: document, term, tokens and row of each, and the topics
    that any token of it has, from one of ``starts`` to the next."""

    docs: np.ndarray
    terms: np.ndarray
    count: np.ndarray
    row: np.ndarray
    starts: np.ndarray
    topics: np.ndarray
    n: np.ndarray
    k: int

    def dense(self, part: slice) -> np.ndarray:
        """All counts of some cells."""
        starts = self.starts[part.start : part.stop + 1]
        found = np.zeros((len(starts) - 1, self.k), np.int64)
        own = slice(starts[0], starts[-1])
        found[np.repeat(np.arange(len(found)), np.diff(starts)), self.topics[own]] = self.n[own]
        return found

    def blocks(self) -> Iterator[slice]:
        return blocks_of(len(self.docs), self.k)


class Bucket:
    """The rows of a bucket and the vectors sent to it."""

    def __init__(self, rows: pa.Table, vectors: pa.Table, k: int) -> None:
        self.rows, self.k = rows, k
        kinds, ids = column(vectors, "kind"), column(vectors, "id")
        cells = vectors.column("cells").combine_chunks()
        if isinstance(cells, pa.ChunkedArray):
            cells = pa.concat_arrays(cells.chunks) if cells.num_chunks else pa.array([], pa.list_(pa.int64()))
        self._sent = {}
        for kind in (TERM, DOCUMENT):
            chosen = np.flatnonzero(kinds == kind)
            self._sent[kind] = Counts.of_cells(ids[chosen], cells.take(pa.array(chosen)), k)

    def terms(self) -> Counts:
        return self._sent[TERM]

    def documents(self) -> Counts:
        """Of split documents as they were sent, else from the rows: a bucket holds
        all of a document."""
        if len(self._sent[DOCUMENT].ids):
            return self._sent[DOCUMENT]
        docs = self.values("doc_id")
        if "topic" in self.rows.column_names:
            weights = self.values("cnt") if "cnt" in self.rows.column_names else None
            return Counts.of_tokens(docs, self.values("topic").astype(np.int64), self.k, weights)
        n = matrix(self.rows, "n", self.k)
        cell, topic = np.nonzero(n)
        return Counts.of_tokens(docs[cell], topic, self.k, n[cell, topic])

    def cells(self) -> Cells:
        """Of a state of cells, be they rows or entries."""
        if not self.packed:
            docs, terms, count = (column(self.rows, name) for name in ("doc_id", "term_id", "cnt"))
            n = matrix(self.rows, "n", self.k)
            cell, topic = np.nonzero(n)
            starts = np.searchsorted(cell, np.arange(len(n) + 1))
            return Cells(docs, terms, count, np.arange(len(n)), starts, topic, n[cell, topic], self.k)
        terms, n = self.values("term_id"), self.values("cnt")
        row = np.repeat(np.arange(self.rows.num_rows), sizes(self.rows))
        heads = cell_heads(row, terms)
        count = np.add.reduceat(n, heads) if len(heads) else n
        starts = np.append(heads, len(row))
        docs = column(self.rows, "doc_id")[row[heads]]
        return Cells(docs, terms[heads], count, row[heads], starts, self.values("topic"), n, self.k)

    @property
    def packed(self) -> bool:
        """Whether a row holds arrays of tokens."""
        return pa.types.is_list(self.rows.schema.field("term_id").type)

    def values(self, name: str) -> np.ndarray:
        """A column by token or cell, whether its rows are packed or not."""
        if not self.packed:
            return column(self.rows, name)
        if pa.types.is_list(self.rows.schema.field(name).type):
            return flat(self.rows, name)
        return np.repeat(column(self.rows, name), sizes(self.rows))

    def as_rows(self, values: np.ndarray) -> pa.Array:
        """Numbers by token, as a column of the rows."""
        return lists(sizes(self.rows), values) if self.packed else pa.array(values)

    def sums(self, values: np.ndarray) -> pa.Array:
        """Sums by row of numbers by token."""
        if not self.packed:
            return pa.array(values)
        row = np.repeat(np.arange(self.rows.num_rows), sizes(self.rows))
        found = np.bincount(row, weights=values, minlength=self.rows.num_rows)
        return pa.array(found.astype(values.dtype))

    def blocks(self) -> Iterator[slice]:
        return blocks_of(len(self.values("term_id")), self.k)


def blocks_of(rows: int, k: int) -> Iterator[slice]:
    size = max(64, BLOCK_CELLS // k)
    for start in range(0, rows, size):
        yield slice(start, start + size)


def by_bucket(
    rows: DataFrame, vectors: DataFrame, k: int, work: Callable[[Bucket], pa.Table], schema: str
) -> DataFrame:
    """``work`` over each bucket of ``rows``, a table bucketed by ``bucket``, next to its
    vectors. Only the vectors are shuffled."""

    def both(own: pa.Table, sent: pa.Table) -> pa.Table:
        return work(Bucket(own, sent, k))

    return rows.groupBy("bucket").cogroup(vectors.groupBy("bucket")).applyInArrow(both, schema)


def table_like(rows: pa.Table, keep: Sequence[str], **more: pa.Array) -> pa.Table:
    columns = {name: rows.column(name) for name in keep}
    return pa.table(columns | more)
