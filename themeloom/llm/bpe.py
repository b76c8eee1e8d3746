"""Byte-level BPE in numpy: encoding and decoding of whole texts.

Texts are cut into words over flat arrays of code points, and words are looked
up by a 64-bit hash in a cache. Words that are new are merged together: the
symbols of all of them lie in one array, every round finds the lowest-ranked
pair of each word by binary search over sorted pair keys and merges it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from themeloom.llm.batches import parts as batch_parts

# Characters handled at a time, and words that a cache holds at most.
PIECE = 1 << 19
CACHED_WORDS = 500_000
# Classes of characters in the pattern that cuts words.
OTHER, LETTER, NUMBER, WHITE = 0, 1, 2, 3
SPACE, APOSTROPHE = 32, 39
# Endings that are words of their own after an apostrophe.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")
NO_RANK = np.iinfo(np.int32).max
# A long text may be cut before white space that follows a printable character.
CUT = re.compile(r"(?<=[!-~])[ \n]")


@dataclass(frozen=True)
class Vocabulary:
    """What encoding and decoding need, as arrays; the same size for any corpus."""

    classes: np.ndarray  # class of each code point
    byte_ids: np.ndarray  # token of each byte
    keys: np.ndarray  # sorted pairs of tokens, left << 32 | right
    ranks: np.ndarray  # rank of each pair
    merged: np.ndarray  # token that a pair becomes
    added: dict[str, int]  # tokens that are cut out of a text first
    pool: np.ndarray  # bytes of all tokens one after the other
    starts: np.ndarray  # place of each token in the pool, one more at the end


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in files of this kind: printable ones
    for themselves, the others from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> Vocabulary:
    """Reads a byte-level BPE tokenizer file; other kinds raise."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, cutter = told["model"], told["pre_tokenizer"] or {}
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback") if model[k]]
    if model["type"] != "BPE" or odd or told["normalizer"] or cutter.get("type") != "ByteLevel":
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
    if cutter["add_prefix_space"] or not cutter["use_regex"]:
        raise ValueError(f"{path} cuts words in a way that is not supported")
    if any(t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} has added tokens that are not supported")
    added = {t["content"]: t["id"] for t in told["added_tokens"]}
    vocab, byte_of = model["vocab"], printable_bytes()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], np.int64)
    right = np.array([vocab[b] for _, b in pairs], np.int64)
    keys = (left << 32) | right
    order = np.argsort(keys)
    spelled = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items() if token not in added}
    spelled |= {i: token.encode() for token, i in added.items()}
    parts = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
    byte_ids = np.zeros(256, np.int32)
    for char, byte in byte_of.items():
        byte_ids[byte] = vocab[char]
    return Vocabulary(
        classes=character_classes(),
        byte_ids=byte_ids,
        keys=keys[order],
        ranks=order.astype(np.int32),
        merged=np.array([vocab[a + b] for a, b in pairs], np.int32)[order],
        added=added,
        pool=np.frombuffer(b"".join(parts), np.uint8),
        starts=np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64),
    )


@cache
def character_classes() -> np.ndarray:
    """Class of every code point, asked of the library's own cutter once: its
    tables of letters and numbers are those of one version of Unicode."""
    from tokenizers import pre_tokenizers

    cutter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    classes = np.full(0x110000, WHITE, np.uint8)
    unsettled = [(c, c + 256) for c in range(0, 0x110000, 256) if not 0xD800 <= c < 0xE000]
    for size in (256, 16, 1):
        unsettled = [(c, c + size) for start, end in unsettled for c in range(start, end, size)]
        for kind, before in ((OTHER, "!"), (NUMBER, "1"), (LETTER, "a")):
            # Characters of one class stay with the character before them.
            rows = [before + "".join(map(chr, range(start, end))) for start, end in unsettled]
            begins = {begin for _, (begin, _) in cutter.pre_tokenize_str("\n".join(rows))}
            rest = []
            for i, block in enumerate(unsettled):
                at = i * (size + 2) + 1
                if begins.isdisjoint(range(at, at + size)):
                    classes[slice(*block)] = kind
                else:
                    rest.append(block)
            unsettled = rest
    return classes


def word_starts(codes: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """True where a word begins; ``first`` marks the first character of each text.

    Words are runs of letters, of numbers, or of other characters, each with a
    space before it if there is one; white space but for that; and endings like
    's. White space before a word keeps its last character apart.
    """
    kind = classes[codes]
    n = len(codes)
    begins = first.copy()
    begins[1:] |= kind[1:] != kind[:-1]
    run = begins.copy()
    white = kind == WHITE
    after_white = np.zeros(n, bool)
    after_white[1:] = white[:-1] & ~white[1:] & ~first[1:]
    at = np.flatnonzero(after_white)
    begins[at - 1] = True
    begins[at] = codes[at - 1] != SPACE
    # Endings: an apostrophe that begins a word, then the letters.
    at = np.flatnonzero((codes == APOSTROPHE) & run)
    at = at[at + 1 < n]
    if len(at):
        spaced = (at > 0) & ~first[at] & (codes[np.maximum(at - 1, 0)] == SPACE)
        at = at[~spaced & (kind[at + 1] == LETTER) & ~first[at + 1]]
        after = codes[at + 1]
        short = at[np.isin(after, [ord(c) for c in SHORT_ENDINGS])]
        far = at[at + 2 < n]
        far = far[~first[far + 2]]
        long = far[np.any([(codes[far + 1] == ord(e[0])) & (codes[far + 2] == ord(e[1])) for e in LONG_ENDINGS], axis=0)]
        for ends, length in ((short, 2), (long, 3)):
            begins[ends + 1] = False
            next_at = ends + length
            begins[next_at[next_at < n]] = True
    return begins


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length) one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def merge_words(words: Sequence[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of many words in one array, and the number of tokens of each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbols = vocab.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), lengths)

    def rank_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged token of the pair that begins at each place."""
        ranks = np.full(len(at), NO_RANK, np.int32)
        becomes = np.zeros(len(at), np.int32)
        inside = at + 1 < len(symbols)
        inside[inside] = owner[at[inside]] == owner[at[inside] + 1]
        here = at[inside]
        keys = (symbols[here].astype(np.int64) << 32) | symbols[here + 1]
        found = np.minimum(np.searchsorted(vocab.keys, keys), len(vocab.keys) - 1)
        same = vocab.keys[found] == keys
        ranks[np.flatnonzero(inside)[same]] = vocab.ranks[found[same]]
        becomes[np.flatnonzero(inside)[same]] = vocab.merged[found[same]]
        return ranks, becomes

    done: list[tuple[np.ndarray, np.ndarray]] = []
    ranks, becomes = rank_of(np.arange(len(symbols)))
    while len(symbols):
        heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sizes = np.diff(np.append(heads, len(symbols)))
        lowest = np.minimum.reduceat(ranks, heads)
        active = np.repeat(lowest < NO_RANK, sizes)
        if not active.all():
            done.append((owner[~active], symbols[~active]))
            symbols, owner, ranks, becomes = symbols[active], owner[active], ranks[active], becomes[active]
            sizes, lowest = sizes[lowest < NO_RANK], lowest[lowest < NO_RANK]
            if not len(symbols):
                break
        at = np.flatnonzero(ranks == np.repeat(lowest, sizes))
        # Of overlapping pairs, as in a run of one letter, every other one goes first.
        new_run = np.append(True, np.diff(at) != 1) | np.append(True, owner[at[1:]] != owner[at[:-1]])
        offset = np.arange(len(at)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
        at = at[offset % 2 == 0]
        symbols[at] = becomes[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        symbols, owner, ranks, becomes = symbols[keep], owner[keep], ranks[keep], becomes[keep]
        changed = place[at]
        touched = np.zeros(len(symbols), bool)
        touched[changed] = True
        touched[np.maximum(changed - 1, 0)] = True
        changed = np.flatnonzero(touched)
        ranks[changed], becomes[changed] = rank_of(changed)
    owners = np.concatenate([o for o, _ in done]) if done else np.zeros(0, np.int64)
    tokens = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int32)
    order = np.argsort(owners, kind="stable")
    return tokens[order], np.bincount(owners, minlength=len(words))


class Encoder:
    """Encodes texts; keeps the tokens of words it has seen."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        parts = sorted(vocab.added, key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, parts)) + ")") if parts else None
        self.powers = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        # Sorted hashes of the words, and the row of each.
        self.hashes = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int32)
        self.tokens = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.offsets = np.zeros(1 << 14, np.int32)
        self.counts = np.zeros(1 << 14, np.int32)

    def pieces(self, texts: Sequence[str | None]) -> Iterator[tuple[list[int], list[str], list[bool]]]:
        """Parts of texts, about PIECE characters at a time: whose they are, the
        part, and whether it is an added token. Words never cross parts."""
        owners: list[int] = []
        parts: list[str] = []
        special: list[bool] = []
        size = 0
        for owner, text in enumerate(texts):
            if not text:
                continue
            cut = self.added.split(text) if self.added and self.added.search(text) else [text]
            for i, segment in enumerate(cut):
                start = 0
                while start < len(segment):
                    found = CUT.search(segment, start + PIECE) if start + PIECE < len(segment) else None
                    end = found.start() if found else len(segment)
                    owners.append(owner)
                    parts.append(segment[start:end])
                    special.append(i % 2 == 1)
                    size += end - start
                    start = end
                    if size >= PIECE:
                        yield owners, parts, special
                        owners, parts, special, size = [], [], [], 0
        if parts:
            yield owners, parts, special

    def encode(self, texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(owners, tokens): tokens of the texts in order, a piece at a time, and
        the text that each belongs to."""
        for owners, parts, special in self.pieces(texts):
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            whole = "".join(parts)
            codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
            first = np.zeros(len(codes), bool)
            at = np.cumsum(lengths) - lengths
            first[at] = True
            begins = word_starts(codes, first, self.vocab.classes)
            for i in np.flatnonzero(special):
                begins[at[i] : at[i] + lengths[i]] = False
                begins[at[i]] = True
            starts = np.flatnonzero(begins)
            rows = self._rows(whole, codes, starts)
            counts = self.counts[rows]
            tokens = self.tokens[spread(self.offsets[rows], counts)]
            word_part = np.searchsorted(at, starts, side="right") - 1
            yield np.repeat(np.asarray(owners)[word_part], counts), tokens

    def _hash(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        ends = np.append(starts[1:], len(codes))
        longest = int((ends - starts).max())
        if longest > len(self.powers):
            self.powers = np.cumprod(np.full(longest, 0x9E3779B97F4A7C15, np.uint64))
        mixed = (codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        inside = np.arange(len(codes)) - np.repeat(starts, ends - starts)
        total = np.add.reduceat(mixed * self.powers[inside], starts)
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        return total ^ (total >> np.uint64(32))

    def _rows(self, whole: str, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Row of the cache for each word; new words are merged and added."""
        hashes, where, back = np.unique(self._hash(codes, starts), return_index=True, return_inverse=True)
        if len(self.rows) + len(hashes) > max(CACHED_WORDS, 2 * len(hashes)):
            self._forget()
        place = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if len(new):
            begin = starts[where[new]]
            end = np.append(starts[1:], len(codes))[where[new]]
            own = [whole[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
            tokens, counts = merge_words([w.encode("utf-8", "surrogatepass") for w in own], self.vocab)
            ids = [self.vocab.added.get(w) for w in own]
            for k, i in enumerate(ids):
                if i is not None:  # the only words that contain one are the ones cut out
                    at = int(counts[:k].sum())
                    tokens = np.concatenate([tokens[:at], [i], tokens[at + counts[k] :]]).astype(np.int32)
                    counts[k] = 1
            row = len(self.rows)
            self.tokens = room(self.tokens, self.used + len(tokens))
            self.offsets, self.counts = room(self.offsets, row + len(new)), room(self.counts, row + len(new))
            self.tokens[self.used : self.used + len(tokens)] = tokens
            self.offsets[row : row + len(new)] = self.used + np.cumsum(counts) - counts
            self.counts[row : row + len(new)] = counts
            self.used += len(tokens)
            self.rows = np.insert(self.rows, place[new], np.arange(row, row + len(new), dtype=np.int32))
            self.hashes = np.insert(self.hashes, place[new], hashes[new])
            place = np.searchsorted(self.hashes, hashes)
        return self.rows[place][back]


def room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


def token_bytes(tokens: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Bytes that the tokens stand for, one after the other. Unknown ids raise."""
    if len(tokens) and not 0 <= tokens.min() <= tokens.max() < len(vocab.starts) - 1:
        raise ValueError("an id is not in the vocabulary")
    lengths = vocab.starts[tokens + 1] - vocab.starts[tokens]
    return vocab.pool[spread(vocab.starts[tokens], lengths)]


def encode_texts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``ids``, ARRAY<INT>: the tokens of the whole text. Null and empty
    texts have none. Other columns pass through, but for a clashing ``ids``."""
    held = docs.drop("ids")
    schema = T.StructType([*held.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in batch_parts(batches):
            texts = batch.column(text).to_pylist()
            yield batch.append_column("ids", id_lists(encoder, texts))

    return held.mapInArrow(encode, schema)


def id_lists(encoder: Encoder, texts: Sequence[str | None]) -> pa.Array:
    counts = np.zeros(len(texts), np.int64)
    tokens = [np.zeros(0, np.int32)]
    for owners, some in encoder.encode(texts):
        counts += np.bincount(owners, minlength=len(texts))
        tokens.append(some)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens), pa.int32()))


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``: the text of ``ids``; bytes that are no UTF-8 become the
    replacement character. Null ids give null; ids beyond the vocabulary raise."""
    held = rows.drop("decoded")
    schema = T.StructType([*held.schema.fields, T.StructField("decoded", T.StringType())])
    sent = rows.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_parts(batches):
            texts = [
                None if ids is None else token_bytes(np.array(ids, np.int64), sent.value).tobytes().decode("utf-8", "replace")
                for ids in batch.column("ids").to_pylist()
            ]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    return held.mapInArrow(decode, schema)


def digest_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: digests of the
    ids, decimal and joined by commas, and of the UTF-8 bytes they decode to.

    Ids are decoded a piece at a time, and digests grow with the pieces.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = sent.value
        encoder = Encoder(vocab)
        spelled = [f",{i}".encode() for i in range(len(vocab.starts) - 1)]
        numerals = np.frombuffer(b"".join(spelled), np.uint8)
        lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
        places = np.cumsum(lengths) - lengths
        sizes = np.diff(vocab.starts)
        for batch in batch_parts(batches):
            texts = batch.column("text").to_pylist()
            counts = [0] * len(texts)
            written = [hashlib.sha256() for _ in texts]
            decoded = [hashlib.sha256() for _ in texts]
            for owners, tokens in encoder.encode(texts):
                heads = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
                ends = np.append(heads[1:], len(tokens))
                decimal = memoryview(numerals[spread(places[tokens], lengths[tokens])])
                plain = memoryview(token_bytes(tokens, vocab))
                to_decimal = np.append(0, np.cumsum(lengths[tokens]))
                to_plain = np.append(0, np.cumsum(sizes[tokens]))
                for head, end in zip(heads.tolist(), ends.tolist(), strict=True):
                    doc = int(owners[head])
                    begin = int(to_decimal[head]) + (counts[doc] == 0)  # no comma before the first
                    written[doc].update(decimal[begin : to_decimal[end]])
                    decoded[doc].update(plain[to_plain[head] : to_plain[end]])
                    counts[doc] += end - head
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": pa.array([h.hexdigest() for h in written], pa.string()),
                    "decoded_sha256": pa.array([h.hexdigest() for h in decoded], pa.string()),
                }
            )

    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )
    return docs.select("doc_id", "text").mapInArrow(digest, schema)
