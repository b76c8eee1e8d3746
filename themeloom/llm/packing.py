"""Packing of tokenised documents into sequences of one size.

Full windows of a document are sequences of their own. For the rest, only the
histogram of its lengths goes to the driver, one number per length: all pairs
and triples of lengths that fill a window are the columns of a non-negative
least-squares problem whose solution says how often each is used. Rounded
repeats give ranges of ranks per length; what is left is packed longest first,
each window filled to the end. A document finds its places by its length and
its rank among the documents of that length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.llm.batches import parts as batch_parts
from themeloom.llm.bpe import Encoder, read_vocabulary
from themeloom.plans.scratch import Scratch

WINDOW = 1024
# Bytes of text tokenised at a time, about.
TOKENISED = 4 << 20
# Rounds of the solver, and the change of the solution at which it ends.
ROUNDS, SETTLED = 600, 1e-6
# Places in the plan are found by length * RANKS + rank.
RANKS = 1 << 40


@dataclass(frozen=True)
class Plan:
    """Where the k-th document of a length goes. Its size is bound by the window."""

    slots: np.ndarray  # sorted length * RANKS + first rank
    sequences: np.ndarray  # sequence of that first rank
    offsets: np.ndarray  # offset in the sequence
    covered: np.ndarray  # by length: ranks below are in slots
    rest: np.ndarray  # by length: place of the first other rank on the tape
    tape: int  # sequence in which the tape begins


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All pairs and triples (a <= b <= c) of the lengths that fill the window;
    a pair has a = 0."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    rows = []
    for a in [0, *lengths.tolist()]:
        middle = lengths[(lengths >= a) & (2 * lengths <= window - a)]
        last = window - a - middle
        fits = present[last]
        rows.append(np.stack([np.full(fits.sum(), a), middle[fits], last[fits]], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def solve_repeats(combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients: how often
    to use each combination so that the lengths used match the histogram."""

    def used(x: np.ndarray) -> np.ndarray:
        total = sum(np.bincount(combos[:, j], x, len(histogram)) for j in range(3))
        total[0] = 0.0
        return total

    def back(error: np.ndarray) -> np.ndarray:
        return error[combos].sum(axis=1)

    x = np.ones(len(combos))
    for _ in range(30):  # largest eigenvalue, for the step
        y = back(used(x))
        size = np.linalg.norm(y)
        x = y / size
    step = 1 / (1.02 * size)
    target = histogram.astype(float)
    target[0] = 0.0
    x = np.zeros(len(combos))
    z, t = x, 1.0
    for _ in range(ROUNDS):
        new = np.maximum(z - step * back(used(z) - target), 0)
        next_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / next_t * (new - x)
        moved = np.abs(new - x).max()
        x, t = new, next_t
        if moved <= SETTLED * max(1.0, x.max()):
            break
    return x


def make_plan(histogram: np.ndarray, first_sequence: int, window: int = WINDOW) -> Plan:
    """Plan for ``histogram[n]`` documents of each length 1 .. window - 1."""
    lengths = np.flatnonzero(histogram)
    left = histogram.astype(np.int64).tolist()
    combos = combinations(lengths, window)
    repeats = [0] * len(combos)
    if len(combos):
        solved = solve_repeats(combos, histogram)
        order = np.argsort(-solved, kind="stable").tolist()
        rows = combos.tolist()
        # Rounded down first, most used first; then what else the lengths allow.
        for most in (np.floor(solved).tolist(), None):
            for i in order:
                parts = [n for n in rows[i] if n]
                limit = min(left[n] // parts.count(n) for n in parts)
                k = limit if most is None else min(limit, int(most[i]))
                if k:
                    repeats[i] += k
                    for n in parts:
                        left[n] -= k
    covered = np.zeros(window + 1, np.int64)
    slots, sequences, offsets = [], [], []
    sequence = first_sequence
    for i in np.flatnonzero(repeats).tolist():
        offset = 0
        for n in reversed(combos[i].tolist()):
            if n:
                slots.append(n * RANKS + int(covered[n]))
                sequences.append(sequence)
                offsets.append(offset)
                covered[n] += repeats[i]
                offset += n
        sequence += repeats[i]
    order = np.argsort(np.array(slots, np.int64), kind="stable")
    rest = np.zeros(window + 1, np.int64)
    place = 0
    for n in range(window, 0, -1):
        rest[n] = place
        place += n * (left[n] if n < len(left) else 0)
    return Plan(
        slots=np.array(slots, np.int64)[order],
        sequences=np.array(sequences, np.int64)[order],
        offsets=np.array(offsets, np.int64)[order],
        covered=covered,
        rest=rest,
        tape=sequence,
    )


def pieces_of(plan: Plan, n: int, rank: int, first_full: int, window: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of a document of n tokens."""
    found = [(i * window, window, first_full + i, 0) for i in range(n // window)]
    start, length = n - n % window, n % window
    if not length:
        return found
    if rank < plan.covered[length]:
        i = int(np.searchsorted(plan.slots, length * RANKS + rank, side="right")) - 1
        inside = rank - int(plan.slots[i]) % RANKS
        return [*found, (start, length, int(plan.sequences[i]) + inside, int(plan.offsets[i]))]
    place = int(plan.rest[length]) + (rank - int(plan.covered[length])) * length
    while length:
        size = min(length, window - place % window)
        found.append((start, size, plan.tape + place // window, place % window))
        start, place, length = start + size, place + size, length - size
    return found


# Columns next to doc_id in the stored table.
STORED = "part int, full_before bigint, rest int, rest_before bigint, n bigint, ids binary"


def tokenise(docs: DataFrame, path: str, end_id: int, window: int) -> DataFrame:
    """doc_id and STORED: tokens of every document, how many full windows come
    before it in its partition, and how many documents with the same rest."""
    vocabulary = read_vocabulary(path)
    width = np.dtype("<u2") if max(len(vocabulary.starts), end_id) <= 1 << 16 else np.dtype("<u4")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        part = TaskContext.get().partitionId()
        full = 0
        seen = np.zeros(window, np.int64)
        for batch in batch_parts(batches, size=TOKENISED):
            texts = batch.column("text").to_pylist()
            held: list[list[bytes]] = [[] for _ in texts]
            for owners, tokens in encoder.encode(texts):
                heads = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
                for own, some in zip(owners[heads].tolist(), np.split(tokens, heads[1:]), strict=True):
                    held[own].append(some.astype(width).tobytes())
            end = np.array([end_id], width).tobytes()
            ids = [b"".join([*some, end]) for some in held]
            counts = [len(x) // width.itemsize for x in ids]
            fulls, befores = [], []
            for n in counts:
                fulls.append(full)
                befores.append(int(seen[n % window]))
                full += n // window
                seen[n % window] += 1
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "part": pa.array([part] * len(ids), pa.int32()),
                    "full_before": pa.array(fulls, pa.int64()),
                    "rest": pa.array([n % window for n in counts], pa.int32()),
                    "rest_before": pa.array(befores, pa.int64()),
                    "n": pa.array(counts, pa.int64()),
                    "ids": pa.array(ids, pa.binary()),
                }
            )

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(STORED).fields])
    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def pack_documents(
    docs: DataFrame, path: str, scratch: Scratch, end_id: int = 0, window: int = WINDOW
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset,
    and ids, the tokens of the piece as little-endian unsigned 32-bit numbers.

    ``docs`` has (doc_id, text); other columns are ignored. Every row is tokenised
    on its own, whole, with the byte-level tokenizer file ``path`` and ``end_id``
    after it, so null and empty texts are one token long and repeated rows are
    packed as often as they come. Pieces of a sequence lie one after the other
    from offset 0; only the last sequence may be shorter than ``window``. An
    empty table gives no rows.
    """
    stored = scratch.keep(tokenise(docs, path, end_id, window), "tokens")
    by_rest = stored.groupBy("part", "rest").agg(F.count("*").alias("docs"))
    fulls = stored.groupBy("part").agg(F.sum(F.floor(F.col("n") / window)).alias("fulls"))
    # One row per partition, and per partition and length.
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first_full = fulls.select("part", F.coalesce(F.sum("fulls").over(parts), F.lit(0)).alias("first_full"))
    ranks = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = scratch.keep(
        by_rest.select("part", "rest", "docs", F.coalesce(F.sum("docs").over(ranks), F.lit(0)).alias("first_rank"))
        .join(first_full, "part"),
        "ranks",
    )
    histogram = np.zeros(window, np.int64)
    for row in before.groupBy("rest").agg(F.sum("docs").alias("docs")).toLocalIterator():
        histogram[row.rest] = row.docs  # at most one row per length
    histogram[0] = 0
    total = fulls.agg(F.coalesce(F.sum("fulls"), F.lit(0))).first()[0]
    plan = docs.sparkSession.sparkContext.broadcast(make_plan(histogram, int(total), window))
    placed = stored.join(before.drop("docs"), ["part", "rest"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_parts(batches):
            yield cut_batch(batch, plan.value, window)

    schema = T.StructType(
        [
            docs.schema["doc_id"],
            *T.StructType.fromDDL(
                "start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
            ).fields,
        ]
    )
    return placed.mapInArrow(cut, schema)


def cut_batch(batch: pa.RecordBatch, plan: Plan, window: int) -> pa.RecordBatch:
    """Pieces of the documents of a batch."""
    owners: list[int] = []
    places: list[tuple[int, int, int, int]] = []
    ids: list[bytes] = []
    columns = [batch.column(c).to_pylist() for c in ("n", "rest_before", "first_rank", "full_before", "first_full", "ids")]
    for i, (n, rank, first_rank, full, first_full, held) in enumerate(zip(*columns, strict=True)):
        wide = np.frombuffer(held, f"<u{len(held) // n}").astype("<u4")
        for place in pieces_of(plan, n, rank + first_rank, full + first_full, window):
            owners.append(i)
            places.append(place)
            ids.append(wide[place[0] : place[0] + place[1]].tobytes())
    start, length, sequence, offset = zip(*places, strict=True)
    at = pa.array(owners, pa.int64())
    return pa.record_batch(
        {
            "doc_id": batch.column("doc_id").take(at),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()),
            "doc_tokens": batch.column("n").take(at),
            "sequence_id": pa.array(sequence, pa.int64()),
            "offset": pa.array(offset, pa.int64()),
            "ids": pa.array(ids, pa.binary()),
        }
    )
