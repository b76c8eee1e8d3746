"""Removal of byte strings that an earlier document holds, by suffix arrays.

A window is a string of WINDOW bytes. Of the hashes of all its grams the smallest
is its key, so equal windows have equal keys and meet in one shard, wherever they
stand. Shards hold the stretches of text whose windows share a key that several
documents have; the suffix array of these (``grouping``) puts equal windows next
to each other, and the smallest document of each is read off.

Copies cost little: documents are cut where their own bytes say so, and of equal
parts only one is looked at. A key with very many places is cut again by longer
grams, so that its windows are spread over shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.llm.grouping import Texts, suffix_array
from themeloom.llm.lines import sieve, sifted
from themeloom.llm.shingles import ODD, mix
from themeloom.llm.sieves import SIEVE_BITS, may_hold
from themeloom.plans.joins import lookup
from themeloom.plans.scratch import Scratch

# Bytes of a string that is removed where an earlier document has it.
WINDOW = 50
# Bytes of the grams whose smallest hash is the key, and of those for keys with many places.
GRAM, LONG_GRAM = 20, 48
# Windows of a stretch at most.
LONGEST = 128
# Places from which on a key is cut again.
MANY = 4096
# Windows of text handled at a time; longer texts go in several pieces. Of these, what is
# hashed at once, so that all its numbers stay near the core.
PIECE, HASHED = 1 << 20, 1 << 14
# A part ends where a hash has so many zero bits at its end, or after so many windows,
# or before so many windows that are in no other document.
PART_BITS, LONGEST_PART, GAP = 10, 4096, 64
# Parts seen lately by a task, whose bytes need not be sent again.
SEEN = 100_000
# Bytes of stretches in a shard, of a text whose suffixes are sorted, and of texts
# sorted side by side, about.
SHARD, LANE, SIDE = 4 << 20, 256, 1 << 20
# Bytes of text whose keys are counted in one task, about.
COUNTED = 64 << 20
SPANS = "array<struct<low:bigint,high:bigint>>"
# Fixed value: the smallest BIGINT stands for a missing doc_id.
NO_ID = -(1 << 63)

FACTOR = np.uint64(0xD1342543DE82EF95)
BYTES = mix(np.arange(256, dtype=np.uint64) + ODD)


def gram_hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """Hash of every string of ``length`` bytes, by doubling."""
    if len(raw) < length:
        return np.zeros(0, np.uint64)
    found, size, width, span = None, 0, 1, BYTES[raw]
    while width <= length:
        if length & width:
            # The strings found so far follow the new ones.
            found = span if found is None else span[: len(span) - size] * raised(size) + found[width:]
            size += width
        width *= 2
        if width <= length:
            half = width // 2
            span = span[:-half] * raised(half) + span[half:]
    return mix(found)


def raised(n: int) -> np.uint64:
    return np.uint64(pow(int(FACTOR), n, 1 << 64))


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by doubling."""
    if len(values) < width:
        return values[:0]
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def window_keys(raw: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """48-bit key of every window, and the hashes of all grams."""
    grams = np.empty(max(len(raw) - gram + 1, 0), np.uint64)
    keys = np.empty(max(len(raw) - WINDOW + 1, 0), np.int64)
    width, done = WINDOW - gram + 1, 0
    for at in range(0, len(grams), HASHED):
        end = min(at + HASHED, len(grams))
        grams[at:end] = gram_hashes(raw[at : end + gram - 1], gram)
        # The windows that end in what is hashed by now.
        ready = max(end - width + 1, 0)
        keys[done:ready] = smallest(grams[done:end], width) >> np.uint64(16)
        done = ready
    return keys, grams


def runs(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the longest stretches of equal values within ranges
    (start, count) that lie one behind the other."""
    ranges = counts > 0
    new = np.zeros(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[starts[ranges]] = True
    head = np.flatnonzero(new)
    owner = np.searchsorted(starts[ranges], head, side="right") - 1
    inside = owner >= 0
    inside[inside] = head[inside] < (starts[ranges] + counts[ranges])[owner[inside]]
    head, owner = head[inside], owner[inside]
    ends = np.minimum(np.append(head[1:], len(values)), (starts[ranges] + counts[ranges])[owner])
    return head, ends - head


def held_windows(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """``may_hold`` of the keys of windows, which is asked once for neighbours with one key."""
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    heads = np.flatnonzero(new)
    return np.repeat(may_hold(table, keys[heads]), np.diff(np.append(heads, len(keys))))


class Pieces:
    """Texts next to each other in one buffer, in pieces of at most PIECE windows."""

    def __init__(self, rows: list[tuple[int, int, bytes]]) -> None:
        """Rows: (number of the text, where the piece starts in it, its bytes)."""
        self.text = np.array([r[0] for r in rows])
        self.at = np.array([r[1] for r in rows])
        self.data = b"".join(r[2] for r in rows)
        self.raw = np.frombuffer(self.data, np.uint8)
        lengths = np.array([len(r[2]) for r in rows])
        self.starts = np.cumsum(lengths) - lengths
        self.counts = lengths - WINDOW + 1

    def inside(self) -> np.ndarray:
        """Whether a window that starts at a place lies in one piece."""
        found = np.zeros(len(self.raw), bool)
        found[ramps(self.starts, self.counts)] = True
        return found

    def owners(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


def pieces(texts: Iterable[bytes | None]) -> Iterator[Pieces]:
    """All texts that hold a window, about PIECE bytes at a time."""
    waiting: list[tuple[int, int, bytes]] = []
    size = 0
    for number, data in enumerate(texts):
        for at in range(0, len(data or b"") - WINDOW + 1, PIECE):
            waiting.append((number, at, data[at : at + PIECE + WINDOW - 1]))
            size += len(waiting[-1][2])
            if size >= PIECE:
                yield Pieces(waiting)
                waiting, size = [], 0
    if waiting:
        yield Pieces(waiting)


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    for value in column.cast(pa.binary()):
        yield value.as_py()


def packed(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpacked(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(zstandard.decompress(x), kind) for x in column.to_pylist()]


def shards_of(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The stretches of equal numbers of a sorted list."""
    heads = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(shard)])
    for low, high in zip(heads.tolist(), [*heads[1:].tolist(), len(shard)], strict=True):
        yield int(shard[low]), slice(low, high)


def key_places(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, keys, ids): keys with a document that has each; of one batch, the smallest
    and the largest. Keys are sorted and stored as differences. Equal keys, and all of
    one word of the table of bits, are in one shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for some in pieces(utf8(batch.column(1))):
                keys, _ = window_keys(some.raw)
                heads, _ = runs(keys, some.starts, some.counts)
                keys, owner = keys[heads], ids[some.text[some.owners(heads)]]
                order = np.argsort(keys)
                keys, owner = keys[order], owner[order]
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
                low, high = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
                two = low != high
                keys, owner = np.concatenate([keys[first], keys[first][two]]), np.concatenate([low, high[two]])
                shard = ((keys & (SIEVE_BITS - 1)) >> 6) % shards
                # The largest documents follow the smallest, both in the order of keys.
                order = np.argsort(keys, kind="stable")
                order = order[np.argsort(shard[order], kind="stable")]
                keys, owner, shard = keys[order], owner[order], shard[order]
                rows = [
                    (number, packed(np.diff(keys[part], prepend=0)), packed(owner[part]))
                    for number, part in shards_of(shard)
                ]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("shard", "keys", "ids"), row, strict=True)) for row in rows],
                    schema=pa.schema({"shard": pa.int64(), "keys": pa.binary(), "ids": pa.binary()}),
                )

    return docs.select("id", "text").mapInArrow(work, "shard BIGINT, keys BINARY, ids BINARY")


def shared_keys(docs: DataFrame, shards: int) -> dict[str, np.ndarray]:
    """Bits of the keys that ``several`` documents have, and of those with ``many`` places.
    SIEVE_BITS / 64 rows at most reach the driver."""

    def count(group: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(x) for x in unpacked(group.column("keys"), "<i8")])
        ids = np.concatenate(unpacked(group.column("ids"), "<i8"))
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        several = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
        many = several & (np.diff(np.append(first, len(keys))) > MANY)
        slots = keys[first] & (SIEVE_BITS - 1)
        order = np.flatnonzero(several)
        order = order[np.argsort(slots[order])]
        word, bit = slots[order] >> 6, np.int64(1) << (slots[order] & 63)
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
        either = (bit, np.where(many[order], bit, 0))
        one, two = (np.bitwise_or.reduceat(b, heads) if len(heads) else b for b in either)
        return pa.table({"word": word[heads], "several": one, "many": two})

    found = key_places(docs, shards).groupBy("shard").applyInArrow(count, "word BIGINT, several BIGINT, many BIGINT")
    words = found.toArrow()
    tables = {}
    for name in ("several", "many"):
        tables[name] = np.zeros(SIEVE_BITS >> 6, np.int64)
        tables[name][words.column("word").to_numpy()] = words.column(name).to_numpy()
    return tables


def cut_parts(some: Pieces, grams: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts in the buffer and numbers of windows of parts that hold all wanted windows
    and few others. They are cut where the hash of the bytes says so."""
    cut = grams[: len(wanted)] & np.uint64((1 << PART_BITS) - 1) == 0
    cut[some.starts] = True
    at = np.flatnonzero(wanted)
    range_of = np.cumsum(cut)[at]
    new = np.append(True, (np.diff(at) > GAP) | (np.diff(range_of) > 0))[: len(at)]
    heads = np.flatnonzero(new)
    head, tail = at[heads], at[np.append(heads[1:], len(at)) - 1]
    counts = tail - head + 1
    several = -(-counts // LONGEST_PART)
    step = ramps(np.zeros(len(several), np.int64), several) * LONGEST_PART
    head, counts = np.repeat(head, several) + step, np.repeat(counts, several) - step
    return head, np.minimum(counts, LONGEST_PART)


def shared_parts(docs: DataFrame, table) -> DataFrame:
    """(doc, id, start, windows, part, bytes) of the parts of documents that hold a
    window with a key of several documents; ``part`` is a digest of the bytes, which
    are null where the task has sent them already."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several, seen = table.value["several"], set()
        for batch in batches:
            doc, ids = batch.column(0), batch.column(1)
            for some in pieces(utf8(batch.column(2))):
                keys, grams = window_keys(some.raw)
                out: list[tuple] = []
                wanted = held_windows(several, keys) & some.inside()[: len(keys)]
                heads, counts = cut_parts(some, grams, wanted)
                owners = some.owners(heads).tolist()
                for piece, head, count in zip(owners, heads.tolist(), counts.tolist(), strict=True):
                    data = some.data[head : head + count + WINDOW - 1]
                    digest = hashlib.blake2b(data, digest_size=16).digest()
                    known = digest in seen
                    if not known:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(digest)
                    start = int(some.at[piece] + head - some.starts[piece])
                    out.append((int(some.text[piece]), start, count, digest, None if known else data))
                if out:
                    rows = [r[0] for r in out]
                    yield pa.RecordBatch.from_arrays(
                        [
                            doc.take(pa.array(rows)), ids.take(pa.array(rows)),
                            pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int32()),
                            pa.array([r[3] for r in out], pa.binary()), pa.array([r[4] for r in out], pa.binary()),
                        ],
                        names=["doc", "id", "start", "windows", "part", "bytes"],
                    )

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "id", "text").mapInArrow(
        work, f"doc {kind}, id BIGINT, start BIGINT, windows INT, part BINARY, bytes BINARY"
    )


def stretches(parts: DataFrame, table, shards: int) -> DataFrame:
    """(shard, keys, lengths, bytes, parts, starts, ids): the stretches of windows
    with one shared key, those of a batch and shard in one row, as packed arrays."""

    def found(some: Pieces, keys: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, ...]:
        heads, counts = runs(keys, some.starts, some.counts)
        use = kept[heads]
        heads, counts = heads[use], counts[use]
        # Text that repeats itself has long ones.
        pieces = -(-counts // LONGEST)
        step = ramps(np.zeros(len(pieces), np.int64), pieces) * LONGEST
        heads, counts = np.repeat(heads, pieces) + step, np.repeat(counts, pieces) - step
        return keys[heads], heads, np.minimum(counts, LONGEST)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for some in pieces(x.as_py() for x in batch.column(2)):
                keys, _ = window_keys(some.raw)
                shared = held_windows(table.value["several"], keys)
                many = shared & held_windows(table.value["many"], keys)
                cut = [found(some, keys, shared & ~many)]
                if many.any():
                    # Windows of other keys part the stretches.
                    longer = np.where(many, window_keys(some.raw, LONG_GRAM)[0], NO_ID)
                    cut.append(found(some, longer, many))
                key, head, count = (np.concatenate(x) for x in zip(*cut, strict=True))
                shard = (mix(key.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                key, head, count, shard = key[order], head[order], count[order], shard[order]
                owner = some.owners(head)
                start = some.at[owner] + head - some.starts[owner]
                lengths = count + WINDOW - 1
                ends = np.cumsum(lengths)
                data = some.raw[ramps(head, lengths)]
                columns = [[] for _ in range(7)]
                for number, part in shards_of(shard):
                    columns[0].append(number)
                    told = (
                        key[part], count[part].astype(np.int32),
                        data[ends[part.start] - lengths[part.start] : ends[part.stop - 1]],
                        names[some.text[owner[part]]], start[part].astype(np.int32), ids[some.text[owner[part]]],
                    )
                    for column, value in zip(columns[1:], told, strict=True):
                        column.append(packed(value))
                kinds = [pa.int64(), *[pa.binary()] * 6]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=PACKED
                )

    schema = ", ".join(f"{name} {'BIGINT' if name == 'shard' else 'BINARY'}" for name in PACKED)
    return parts.select("name", "id", "bytes").mapInArrow(work, schema)


PACKED = ["shard", "keys", "counts", "bytes", "names", "starts", "ids"]


def ramps(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one behind the other."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(before - starts, counts)


def earlier_windows(shards: DataFrame) -> DataFrame:
    """(name, low, high): windows of a part that occur in a document before the first
    one that holds the part."""

    def work(group: pa.Table) -> pa.Table:
        def whole(name: str, kind: str) -> np.ndarray:
            return np.concatenate(unpacked(group.column(name), kind))

        keys, counts, data = whole("keys", "<i8"), whole("counts", "<i4").astype(np.int64), whole("bytes", "u1")
        names, starts, ids = whole("names", "<i8"), whole("starts", "<i4").astype(np.int64), whole("ids", "<i8")
        lengths = counts + WINDOW - 1
        at = np.cumsum(lengths) - lengths
        where = np.cumsum(counts) - counts
        first = smallest_documents(data, keys, at, counts, np.repeat(ids, counts))
        # Of each stretch, the windows that are earlier than the part it is from.
        touched = np.flatnonzero(np.minimum.reduceat(first, where) < ids)
        spread = ramps(where[touched], counts[touched])
        owner = np.repeat(np.arange(len(touched)), counts[touched])
        early = first[spread] < ids[touched][owner]
        place = ramps(starts[touched], counts[touched])
        step = np.flatnonzero(early)
        new = np.ones(len(step), bool)
        new[1:] = (step[1:] != step[:-1] + 1) | (owner[step[1:]] != owner[step[:-1]])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(step)) - 1 if len(step) else heads
        return pa.table(
            {
                "name": names[touched][owner[step[heads]]],
                "low": place[step[heads]],
                "high": place[step[tails]] + 1,
            }
        )

    return shards.groupBy("shard").applyInArrow(work, "name BIGINT, low BIGINT, high BIGINT")


def smallest_documents(
    data: np.ndarray, keys: np.ndarray, at: np.ndarray, counts: np.ndarray, ids: np.ndarray, gram: int = GRAM
) -> np.ndarray:
    """Of stretches of ``data`` (key, place, number of windows) and the document of
    each of their windows: the smallest document of all equal windows of one key."""
    content, stretch = different(data, keys, at, counts)
    windows = counts[stretch]
    where = np.cumsum(windows) - windows
    spread = ramps(where[content], counts)
    first = np.full(int(windows.sum()), np.iinfo(np.int64).max)
    np.minimum.at(first, spread, ids)
    # Only windows of different stretches with one key can still be equal.
    keys, at = keys[stretch], at[stretch]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.add.reduceat(windows + WINDOW, heads)
    number = np.diff(np.append(heads, len(keys)))
    longer_gram = {GRAM: LONG_GRAM, LONG_GRAM: WINDOW}.get(gram)
    large = (size > 2 * LANE) & (longer_gram is not None)
    again = np.flatnonzero(np.repeat((number > 1) & large, number))
    if len(again):
        # Parted by longer grams, so that texts stay short; at last by whole windows.
        lengths = windows[again] + WINDOW - 1
        some = data[ramps(at[again], lengths)]
        begin = np.cumsum(lengths) - lengths
        longer, _ = window_keys(some, longer_gram)
        head, count = runs(longer, begin, windows[again])
        owner = np.searchsorted(begin, head, side="right") - 1
        slots = ramps(where[again][owner] + head - begin[owner], count)
        first[slots] = smallest_documents(some, longer[head], head, count, first[slots], longer_gram)
    chosen = np.flatnonzero(np.repeat((number > 1) & ~large, number))
    for batch in lanes(keys, windows + WINDOW - 1, chosen):
        compare(batch, data, at, windows + WINDOW - 1, where, first)
    return first[spread]


def different(
    data: np.ndarray, keys: np.ndarray, at: np.ndarray, counts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The number of each stretch's content, and one stretch of every content, in the
    order of keys."""
    lengths = counts + WINDOW - 1
    raw, step = data[ramps(at, lengths)], ramps(np.zeros(len(at), np.int64), lengths)
    powers = np.cumprod(np.full(int(lengths.max(initial=1)), FACTOR))
    hashes = np.add.reduceat(BYTES[raw] * powers[step], np.cumsum(lengths) - lengths) if len(at) else keys
    order = np.lexsort((hashes, lengths, keys))
    new = np.ones(len(keys), bool)
    new[1:] = False
    for values in (keys, lengths, hashes):
        new[1:] |= values[order][1:] != values[order][:-1]
    content, stretch = np.empty(len(keys), np.int64), np.empty(int(new.sum()), np.int64)
    content[order] = np.cumsum(new) - 1
    stretch[content] = np.arange(len(keys))
    # Equal hashes are not yet equal bytes.
    others = data[np.repeat(at[stretch[content]], lengths) + step]
    return (content, stretch) if np.array_equal(raw, others) else exactly_different(data, keys, at, counts)


def exactly_different(
    data: np.ndarray, keys: np.ndarray, at: np.ndarray, counts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """``different`` without hashes of our own."""
    raw = data.tobytes()
    numbers: dict[tuple[int, bytes], int] = {}
    order = np.argsort(keys, kind="stable")
    content = np.empty(len(keys), np.int64)
    ends = at[order] + counts[order] + WINDOW - 1
    for i, key, low, high in zip(
        order.tolist(), keys[order].tolist(), at[order].tolist(), ends.tolist(), strict=True
    ):
        content[i] = numbers.setdefault((key, raw[low:high]), len(numbers))
    stretch = np.empty(len(numbers), np.int64)
    stretch[content] = np.arange(len(keys))
    return content, stretch


def lanes(keys: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Stretches dealt out to texts, those of one key to the same; several texts of
    like length at a time."""
    if not len(chosen):
        return
    heads = np.flatnonzero(np.append(True, keys[chosen][1:] != keys[chosen][:-1]))
    sizes = np.add.reduceat(lengths[chosen] + 1, heads)
    tails = np.append(heads[1:], len(chosen))
    batch: list[np.ndarray] = []
    lane: list[np.ndarray] = []
    filled = total = 0
    for group in np.argsort(-sizes, kind="stable").tolist():
        if lane and filled + sizes[group] > LANE:
            batch.append(np.concatenate(lane))
            total += filled
            lane, filled = [], 0
            if total >= SIDE:
                yield batch
                batch, total = [], 0
        lane.append(chosen[heads[group] : tails[group]])
        filled += int(sizes[group])
    yield [*batch, np.concatenate(lane)]


def compare(
    batch: list[np.ndarray], data: np.ndarray, at: np.ndarray, lengths: np.ndarray,
    where: np.ndarray, first: np.ndarray,
) -> None:
    """Sorts the suffixes of each text; equal windows get the smallest document
    of all of them in ``first``."""
    chosen = np.concatenate(batch)
    size = lengths[chosen]
    # Every stretch is followed by a 1, every text by a 0.
    last = np.cumsum([len(x) for x in batch]) - 1
    room = size + 1
    room[last] += 1
    begin = np.cumsum(room) - room
    symbols = np.ones(int(room.sum()), np.int64)
    inside = ramps(begin, size)
    symbols[inside] = data[ramps(at[chosen], size)].astype(np.int64) + 2
    symbols[(begin + room - 1)[last]] = 0
    texts = Texts(symbols, np.add.reduceat(room, np.append(0, last[:-1] + 1)))
    order = suffix_array(texts)
    # Places of windows, and where ``first`` has them.
    slot = np.full(len(symbols), -1)
    windows = size - WINDOW + 1
    slot[ramps(begin, windows)] = ramps(where[chosen], windows)
    order = order[slot[order] >= 0]
    slot = slot[order]
    packed = eights(symbols)
    same = np.ones(len(order) - 1, bool)
    for offset in (*range(0, WINDOW - 7, 8), WINDOW - 8):
        word = packed[order + offset]
        same &= word[1:] == word[:-1]
    heads = np.flatnonzero(np.append(True, ~same))
    least = np.minimum.reduceat(first[slot], heads)
    first[slot] = np.repeat(least, np.diff(np.append(heads, len(order))))


def eights(symbols: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; short ones at the end."""
    padded = np.append((symbols - 2).astype(np.uint8), np.zeros(8, np.uint8)).astype(np.uint64)
    for shift in (1, 2, 4):
        padded[:-shift] |= padded[shift:] << np.uint64(8 * shift)
    return padded[: len(symbols)]


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, spans): byte ranges to remove from each document that has any, not yet
    merged. ``docs`` needs (doc, id, text); ``id`` is never null."""
    context = docs.sparkSession.sparkContext
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    table = context.broadcast(shared_keys(docs, max(context.defaultParallelism, size // COUNTED)))
    parts = scratch.keep(shared_parts(docs, table), "parts", compression="zstd")
    once = parts.groupBy("part").agg(
        F.min("id").alias("id"), F.count("*").alias("n"), F.any_value("bytes", True).alias("bytes")
    )
    once = once.withColumn("name", F.monotonically_increasing_id())
    once = scratch.keep(once, "different-parts", compression="zstd")
    size = once.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    shards = max(context.defaultParallelism, 4 * size // SHARD)
    early = earlier_windows(stretches(once, table, shards))
    found = early.groupBy("name").agg(F.collect_list(F.struct("low", "high")).alias("early"))
    known = scratch.keep(
        once.select("name", "part", "n", F.col("id").alias("first")).join(found, "name", "left").drop("name"), "known"
    )
    scratch.drop("different-parts")
    places = lookup(parts.drop("bytes"), known, "part", weight="n", spread_by=["doc", "start"])
    more = F.lit(WINDOW - 1)

    def span(low, high):
        return F.struct((F.col("start") + low).alias("low"), (F.col("start") + high + more).alias("high"))

    whole = F.array(span(F.lit(0), F.col("windows")))
    some = F.transform(F.coalesce("early", F.array()), lambda e: span(e["low"], e["high"]))
    spans = places.select("doc", F.when(F.col("id") > F.col("first"), whole).otherwise(some).alias("spans"))
    spans = spans.filter(F.size("spans") > 0)
    removed = scratch.keep(spans.groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("spans")), "removed")
    scratch.drop("parts")
    scratch.drop("known")
    return removed


def drop_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The columns of ``docs``, and ``spans``, the maximal byte ranges [low, high)
    removed, in order, and ``kept`` BINARY, the remaining bytes of ``text`` in UTF-8.

    ``docs`` needs (doc_id, text); its own ``spans`` and ``kept`` are replaced. A byte
    goes if a string of WINDOW bytes that covers it also starts in a document with a
    smaller doc_id; overlaps count, and strings are those of the input. Rows of equal
    doc_id are one document, a missing doc_id is smaller than all. Null texts count as
    empty. An empty table gives no rows. A character may be cut.
    """
    text = F.coalesce("text", F.lit(""))
    doc = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("text_hash"))
    keyed = docs.select(doc.alias("doc"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), text.alias("text"))
    removed = repeated_spans(keyed, scratch)
    bitmap = scratch.keep(sieve(removed, "doc"), "removed-sieve")
    others = [c for c in docs.columns if c not in ("spans", "kept")]
    rows = docs.select(doc.alias("doc"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"))
    rows = sifted(rows, bitmap, "doc")
    # Only documents that may lose bytes are shuffled.
    cut = without_spans(rows.filter("_maybe").join(removed, "doc", "left").select("row", "spans"))
    whole = F.encode(F.coalesce("row.text", F.lit("")), "UTF-8")
    same = rows.filter("NOT _maybe").select("row", F.array().cast(SPANS).alias("spans"), whole.alias("kept"))
    return cut.unionByName(same).select(*[F.col(f"row.`{c}`").alias(c) for c in others], "spans", "kept")


def without_spans(rows: DataFrame) -> DataFrame:
    """Merges ``spans`` of (row, spans), and adds ``kept``, the text of the row without them."""
    schema = T.StructType([*rows.schema.fields, T.StructField("kept", T.BinaryType())])
    text_at = rows.schema["row"].dataType.fieldNames().index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged, kept = [], []
            for spans, raw in zip(batch.column(1), utf8(batch.column(0).field(text_at)), strict=True):
                told, left, at, raw = [], [], 0, raw or b""
                for low, high in sorted((s["low"], s["high"]) for s in spans.as_py() or []):
                    if told and low <= told[-1]["high"]:
                        told[-1]["high"] = max(told[-1]["high"], high)
                    else:
                        told.append({"low": low, "high": high})
                for span in told:
                    left.append(raw[at : span["low"]])
                    at = span["high"]
                merged.append(told)
                kept.append(b"".join([*left, raw[at:]]))
            spans = pa.array(merged, batch.schema.field(1).type)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), spans, pa.array(kept, pa.binary())], names=["row", "spans", "kept"]
            )

    return rows.mapInArrow(work, schema)
