"""Sets of word shingles in numpy, for whole texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

# Words of a shingle.
WORDS = 5
# Bytes of text handled at a time.
PIECE = 1 << 20
# White space that parts words.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
# Bytes with A-Z in lower case, spread over 64 bits.
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mix(LOWER + ODD)


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0xD1342543DE82EF95, np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of every word of one text, in order."""
    raw = np.frombuffer(data, np.uint8)
    white = WHITE[raw]
    inside = ~white
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    terms = BYTES[raw[at]] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(terms, np.cumsum(lengths) - lengths))


def shingle_sets(texts: Sequence[str | None], words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of each text, in order.

    A text of fewer words is one shingle; one without words has none. Texts are
    hashed side by side, a piece at a time; a long text is one piece.
    """
    batch: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        batch.append(data)
        size += len(data)
        if size >= PIECE or i + 1 == len(texts):
            yield from zip(range(first, i + 1), _sets(batch, words), strict=True)
            batch, first, size = [], i + 1, 0


def _sets(batch: list[bytes], words: int) -> Iterator[np.ndarray]:
    # A zero byte is no white space; texts are told apart by their numbers of words.
    counts = []
    for data in batch:
        raw = np.frombuffer(data, np.uint8)
        inside = ~WHITE[raw]
        counts.append(int(inside[:1].sum() + (inside[1:] & ~inside[:-1]).sum()))
    hashes = word_hashes(b" ".join(batch))
    factors = powers(words + 1)[1:]
    n = len(hashes) - words + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for j in range(words):
        rolled += hashes[j : j + max(n, 0)] * factors[j]
    rolled = mix(rolled)
    at = 0
    for count in counts:
        if count >= words:
            found = np.sort(rolled[at : at + count - words + 1])
            yield found[np.append(True, found[1:] != found[:-1])]
        elif count:
            few = hashes[at : at + count]
            whole = (few * factors[:count]).sum(dtype=np.uint64) + np.uint64(count)
            yield mix(np.array([whole], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        at += count


def set_hashes(members: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, as signed numbers; equal sets have equal ones."""
    one = mix(np.array([members.sum(dtype=np.uint64) + np.uint64(len(members))], np.uint64))
    two = mix(np.array([mix(members ^ ODD).sum(dtype=np.uint64)], np.uint64))
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


def parity_sketch(members: np.ndarray) -> bytes:
    """One bit for each of 2 to 4 times as many places as members: whether an odd
    number of members falls there. Sets differ in at least as many members as
    their sketches differ in bits."""
    bits = max(64, 1 << (2 * len(members) - 1).bit_length())
    flips = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def least_difference(one: bytes, two: bytes) -> int:
    """Lower bound of the symmetric difference of two sets, from their sketches."""
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())
