"""N-gram Jaccard join: exact links between texts by their sets of word shingles.

Two sets of Jaccard similarity t or more differ in at most H elements, a number
given by their sizes. A band of sizes cuts the universe of shingles into
segments by hash; with more than H units of segments, some segment of a similar
pair is the same (one unit) or differs by one element (two units, for segments
that also index their one-deletion neighbourhood). Which segments do so is
allocated by cost for each band. Keys of fewer than two shingles, that any
common passage would share, are not indexed; a set with too few units left for
the guarantee is indexed a second time, shingle by shingle, among its like.

Sets that share a key meet at the smallest of them. Those pairs, and after a
first round of components all pairs around one meeting point that are not yet
together, are bounded by parity sketches and then compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.llm.batches import parts as batch_parts
from themeloom.llm.components import connected_components
from themeloom.llm.shingles import least_difference, mix, parity_sketch, set_hashes, shingle_sets
from themeloom.plans.scratch import Scratch

# Two documents are linked when 100 * intersection >= PERCENT * union.
PERCENT = 80
# Spare segments, as a factor and in standard deviations, for those without a key.
SPARE, SPARE_ROOTS = 1.3, 1.0
# One shingle in so many, by hash, is counted for the costs of a band.
SAMPLED = 64
# Cost of a pair that shares a key by chance, in keys.
PAIR_COST = 40
# Bytes of a key that are sent, its first ones: keys only meet those of their bucket, and
# what meets by chance is compared exactly.
KEY_BYTES = 5
# Keys of a bucket aimed at, and keys sent off at a time by a task.
BUCKET_KEYS, SENT_KEYS = 750_000, 500_000
# Meeting points with more sets are compared in blocks.
BLOCK = 1024
# Fixed value: marks the keys of the second index.
SECOND = np.uint64(1 << 62)


@dataclass(frozen=True)
class Bands:
    """Bands of set sizes and the allocation of each; a few dozen numbers."""

    percent: int
    starts: np.ndarray  # sizes of band k: starts[k] .. starts[k + 1] - 1
    segments: np.ndarray  # segments of band k
    wide: np.ndarray  # the first ones of them index one-deletion neighbourhoods too
    buckets: np.ndarray  # buckets of the keys of band k: buckets[k] .. buckets[k + 1] - 1

    def bucket(self, band: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Keys of one band share few buckets, as every bucket names the pairs it
        finds, and pairs with many common keys lie in one band or two."""
        first = self.buckets[band]
        return first + (keys % (self.buckets[band + 1] - first).astype(np.uint64)).astype(np.int64)

    def difference(self, total: np.ndarray) -> np.ndarray:
        """Most elements in which similar sets of ``total`` elements in all differ."""
        return (100 - self.percent) * total // (100 + self.percent)


def band_starts(largest: int, percent: int) -> np.ndarray:
    """Similar sets lie in one band or in two next to each other; a band reaches
    from a size to 1.1 times that at least, so that there are few of them."""
    starts, percent = [1], min(percent, 90)
    while len(starts) < 3 or starts[-2] <= largest:
        starts.append(max(starts[-1] + 1, -(-100 * starts[-1] // percent)))
    return np.array(starts, np.int64)


def allocate(percent: int, starts: np.ndarray, sets: np.ndarray, excess: np.ndarray) -> Bands:
    """Segments of each band, by the number of sets in it and ``excess``, the
    number of pairs of sets with a common shingle, summed over shingles.

    A chance match needs a key of two common shingles at most, so its frequency
    falls with the size of segments: half as many, wide segments make more keys
    and fewer matches. The cheaper of the two, in keys and pairs, is taken.
    """
    segments, wide, buckets = [], [], [0]
    for k in range(len(starts) - 1):
        top = int(starts[k + 1]) - 1
        units = (100 - percent) * (top + 100 * top // percent) // (100 + percent) + 1
        choices = []
        for per_segment in (1, 2):
            number = math.ceil(units / per_segment * SPARE + SPARE_ROOTS * math.sqrt(units))
            size = top / number
            keys = number if per_segment == 1 else number + top
            chance = (size * math.exp(-size)) ** 2 * (1 if per_segment == 1 else 0.5 * size * math.exp(-size / 2))
            cost = float(sets[k]) * keys + PAIR_COST * float(excess[k]) * chance
            choices.append((cost, number, 0 if per_segment == 1 else number))
        _, number, broad = min(choices)
        segments.append(number)
        wide.append(broad)
        # The band above is indexed with this one's segments as well.
        entries = float(sets[k] + (sets[k + 1] if k + 1 < len(sets) else 0)) * (number + (top if broad else 0))
        buckets.append(buckets[-1] + max(1, math.ceil(entries / BUCKET_KEYS)))
    return Bands(percent, starts, *(np.array(x, np.int64) for x in (segments, wide, buckets)))


def segment_keys(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key, bucket): the index entries of sorted sets, none of them empty."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    own_band = np.searchsorted(bands.starts, sizes, side="right") - 1
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    owners, keys, buckets = [], [], []
    largest_partner = 100 * sizes // bands.percent
    for lower in (0, 1):  # a set meets its own band's, and those of the band below
        band = own_band - lower
        takes = band >= 0
        band = np.maximum(band, 0)
        last = bands.starts[band + 1] - 1
        partner = largest_partner if lower == 0 else last
        if lower:
            takes &= bands.percent * sizes <= 100 * last
        units = np.zeros(len(sets), np.int64)
        for entry_owner, entry_key, unit_owner, unit in _band_keys(flat, owner, band, takes, bands):
            owners.append(entry_owner)
            keys.append(entry_key)
            buckets.append(bands.bucket(band[entry_owner], entry_key))
            units += np.bincount(unit_owner, unit, len(sets)).astype(np.int64)
        short = takes & (units <= bands.difference(sizes + partner))
        some = short[owner]
        owners.append(owner[some])
        salt = mix(SECOND + band[owner[some]].astype(np.uint64))
        keys.append(mix(flat[some] ^ salt))
        buckets.append(bands.bucket(band[owners[-1]], keys[-1]))
    return np.concatenate(owners), np.concatenate(keys), np.concatenate(buckets)


def _band_keys(
    flat: np.ndarray, owner: np.ndarray, band: np.ndarray, takes: np.ndarray, bands: Bands
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    some = takes[owner]
    values, owner = flat[some], owner[some]
    if not len(values):
        return
    number = bands.segments[band[owner]].astype(np.uint64)
    # Sets are sorted, so the elements of a segment lie side by side.
    segment = ((values >> np.uint64(32)) * number) >> np.uint64(32)
    heads = np.flatnonzero(
        np.append(True, (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1]))
    )
    counts = np.diff(np.append(heads, len(values)))
    spread = mix(values + np.uint64(0x2545F4914F6CDD1D))
    total = np.add.reduceat(spread, heads)
    of, at = owner[heads], segment[heads]
    salt = mix((band[of].astype(np.uint64) << np.uint64(32)) + at + np.uint64(1))
    full = counts >= 2
    broad = (at.astype(np.int64) < bands.wide[band[of]]) & (counts >= 3)
    yield of[full], mix(total[full] ^ salt[full]), of[full], np.where(broad[full], 2, 1)
    if broad.any():
        rows = np.repeat(np.arange(len(heads)), counts)
        rows, rest = rows[broad[rows]], spread[broad[rows]]
        yield of[rows], mix((total[rows] - rest) ^ salt[rows]), of[:0], counts[:0]


def describe_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, a, b, sketch, sample) of every row: size, two hashes,
    parity sketch and counted elements of its set."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_parts(batches):
            rows = []
            for _, members in shingle_sets(batch.column("text").to_pylist()):
                counted = members[members % np.uint64(SAMPLED) == 0].view(np.int64)
                rows.append((len(members), *set_hashes(members), parity_sketch(members) if len(members) else b"", counted))
            n, a, b, sketch, sample = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_shingles": pa.array(n, pa.int64()),
                    "a": pa.array(a, pa.int64()),
                    "b": pa.array(b, pa.int64()),
                    "sketch": pa.array(sketch, pa.binary()),
                    "sample": pa.array(sample, pa.list_(pa.int64())),
                }
            )

    told = "n_shingles bigint, a bigint, b bigint, sketch binary, sample array<bigint>"
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(told).fields])
    return docs.select("doc_id", "text").mapInArrow(describe, schema)


def plan_bands(classes: DataFrame, percent: int) -> Bands:
    """Bands and allocations for the sets in ``classes``, from counts over all of them."""
    largest = classes.agg(F.coalesce(F.max("n_shingles"), F.lit(1))).first()[0]
    starts = band_starts(int(largest), percent)
    begun = F.filter(F.lit(starts[:-1].tolist()), lambda start: start <= F.col("n_shingles"))
    sets, excess = np.zeros(len(starts)), np.zeros(len(starts))
    banded = classes.select((F.size(begun) - 1).alias("band"), "sample")
    for row in banded.groupBy("band").count().toLocalIterator():
        sets[row["band"]] = row["count"]
    common = banded.select("band", F.explode("sample").alias("element")).groupBy("band", "element").count()
    pairs = F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")
    for row in common.groupBy("band").agg(pairs).toLocalIterator():
        excess[row["band"]] = row["pairs"] * SAMPLED
    return allocate(percent, starts, sets, excess)


def short_keys(keys: np.ndarray) -> bytes:
    """KEY_BYTES of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEY_BYTES :].tobytes()


def long_keys(sent: bytes) -> np.ndarray:
    """The keys again, with 0 for what was not sent."""
    keys = np.zeros((len(sent) // KEY_BYTES, 8), np.uint8)
    keys[:, 8 - KEY_BYTES :] = np.frombuffer(sent, np.uint8).reshape(-1, KEY_BYTES)
    return keys.view("<u8").ravel()


def indexed(docs: DataFrame, bands: Bands) -> DataFrame:
    """(bucket, keys, sets): index entries of all documents as packed numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(bands)

    def packed(owners: list, keys: list, buckets: list) -> Iterator[pa.RecordBatch]:
        own, key, bucket = (np.concatenate(x) for x in (owners, keys, buckets))
        order = np.argsort(bucket, kind="stable")
        own, key = own[order], key[order]
        found, heads = np.unique(bucket[order], return_index=True)
        ends = np.append(heads[1:], len(key))
        yield pa.record_batch(
            {
                "bucket": pa.array(found, pa.int64()),
                "keys": pa.array([short_keys(key[i:j]) for i, j in zip(heads, ends, strict=True)], pa.binary()),
                "sets": pa.array([own[i:j].tobytes() for i, j in zip(heads, ends, strict=True)], pa.binary()),
            }
        )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in one task are indexed once
        owners: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        buckets: list[np.ndarray] = []
        held = 0
        waiting: list[np.ndarray] = []
        names: list[int] = []

        def flush() -> None:
            nonlocal held, waiting, names
            if waiting:
                own, key, bucket = segment_keys(waiting, sent.value)
                owners.append(np.array(names, np.int64)[own])
                keys.append(key)
                buckets.append(bucket)
                held += len(key)
                waiting, names = [], []

        for batch in batch_parts(batches):
            for _, members in shingle_sets(batch.column("text").to_pylist()):
                name = set_hashes(members)[0]
                if len(members) and name not in seen:
                    seen.add(name)
                    waiting.append(members)
                    names.append(name)
                    if sum(map(len, waiting)) > 1 << 17 if len(waiting) % 64 == 0 else len(members) > 1 << 17:
                        flush()
                        if held > SENT_KEYS:
                            yield from packed(owners, keys, buckets)
                            owners, keys, buckets, held = [], [], [], 0
        flush()
        if owners:
            yield from packed(owners, keys, buckets)

    return docs.select("text").mapInArrow(index, "bucket bigint, keys binary, sets binary")


def meetings(entries: DataFrame) -> DataFrame:
    """(center, other): sets that share a key with a smaller one, by hash."""

    def meet(table: pa.Table) -> pa.Table:
        keys = long_keys(b"".join(x.as_buffer() for x in table.column("keys")))
        sets = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("sets")])
        order = np.argsort(keys)
        keys, sets = keys[order], sets[order]
        # Most keys stand alone; the rest are sorted by set as well.
        same = keys[1:] == keys[:-1]
        shared = np.append(False, same) | np.append(same, False)
        keys, sets = keys[shared], sets[shared]
        order = np.lexsort((sets, keys))
        keys, sets = keys[order], sets[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        center = np.repeat(sets[heads], np.diff(np.append(heads, len(keys))))
        apart = sets != center
        pairs = np.unique(np.stack([center[apart], sets[apart]]), axis=1)
        return pa.table({"center": pa.array(pairs[0], pa.int64()), "other": pa.array(pairs[1], pa.int64())})

    met = entries.groupBy("bucket").applyInArrow(meet, "center bigint, other bigint")
    return met.distinct()


def maybe_similar(n: int, m: int, one: bytes, two: bytes, percent: int) -> bool:
    """False only for sets that cannot reach the similarity."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    return least_difference(one, two) <= (100 - percent) * (n + m) // (100 + percent)


def plausible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) that their sizes and sketches allow to be similar."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("n", "m", "one", "two")]
            passes = [maybe_similar(*row, percent) for row in zip(*columns, strict=True)]
            yield batch.select(["x", "y"]).filter(pa.array(passes, pa.bool_()))

    return pairs.mapInArrow(test, T.StructType([pairs.schema["x"], pairs.schema["y"]]))


def exact_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets have the similarity."""
    one = sets.select(F.col("doc_id").alias("x"), F.col("members").alias("mx"))
    two = sets.select(F.col("doc_id").alias("y"), F.col("members").alias("my"))
    common = F.size(F.array_intersect("mx", "my"))
    union = F.size("mx") + F.size("my") - F.col("common")
    both = pairs.join(one, "x").join(two, "y").withColumn("common", common)
    return both.filter(F.lit(100) * F.col("common") >= F.lit(percent) * union).select(
        F.col("x").alias("a"), F.col("y").alias("b")
    )


def members_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, members) of the wanted documents."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_parts(batches):
            found = [m.view(np.int64) for _, m in shingle_sets(batch.column("text").to_pylist())]
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "members": pa.array(found, pa.list_(pa.int64()))}
            )

    schema = T.StructType([docs.schema["doc_id"], T.StructField("members", T.ArrayType(T.LongType()))])
    some = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    return some.mapInArrow(collect, schema)


def differing(
    rows: np.ndarray, n: np.ndarray, component: np.ndarray, block: np.ndarray | None,
    sketches: list[bytes], percent: int,
) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others) of the rows of one group whose pairs lie in different
    components, and blocks if given, and may be similar by size and sketch."""
    lengths = np.fromiter((len(sketches[r]) // 8 for r in rows), np.int64, len(rows))
    held = {}
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        held[int(length)] = at, np.frombuffer(b"".join(sketches[rows[a]] for a in at), np.uint64).reshape(len(at), -1)
    # Similar sets have sketches of one length, or one is twice as long and folded.
    folded = {length // 2: (at, m[:, : length // 2] ^ m[:, length // 2 :]) for length, (at, m) in held.items() if length > 1}
    nothing = np.zeros(0, np.int64), np.zeros((0, 1), np.uint64)
    sizes, parts = n[rows], component[rows]
    for i, length in enumerate(lengths.tolist()):
        at, own = held[length]
        mine = own[np.searchsorted(at, i)]
        half = mine[: length // 2] ^ mine[length // 2 :] if length > 1 else None
        for side, (others, matrix) in (
            (mine, held[length]),
            (mine, folded.get(length, nothing)),
            (half, held.get(length // 2, nothing) if length > 1 else nothing),
        ):
            later = np.searchsorted(others, i, side="right")
            others = others[later:]
            fits = (parts[others] != parts[i]) & (
                100 * np.minimum(sizes[i], sizes[others]) >= percent * np.maximum(sizes[i], sizes[others])
            )
            if block is not None:
                fits &= block[others] != block[i]
            if fits.any():
                others = others[fits]
                apart = np.bitwise_count(matrix[later:][fits] ^ side).sum(axis=1)
                others = others[apart <= (100 - percent) * (sizes[i] + sizes[others]) // (100 + percent)]
                if len(others):
                    yield rows[i], rows[others]


def around_centers(groups: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Pairs (x, y) of sets that meet at one center, lie in different components,
    and are not ruled out by sizes and sketches.

    ``groups`` has (center, doc, component, n, sketch, size), ``size`` sets at each
    center. Small groups share a task; a large one is cut in blocks, and every
    pair of blocks is one piece of work.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc"), blocks).cast("int")
    cut = groups.withColumn("blocks", blocks).withColumn("own", own)
    spread = cut.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "partner"), F.greatest("own", "partner")
    work = spread.select(
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("center"), F.lit(buckets)))
        .otherwise(F.xxhash64("center", low, high))
        .alias("work"),
        "center", "doc", "component", "n", "sketch", "own", low.alias("low"), high.alias("high"),
    )
    kind = groups.schema["doc"].dataType

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("center", "ascending"), ("low", "ascending"), ("high", "ascending")])
        group, low, high, own = (table.column(c).to_numpy() for c in ("center", "low", "high", "own"))
        change = (group[1:] != group[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        heads = np.flatnonzero(np.append(True, change)) if len(group) else np.zeros(0, np.int64)
        n = table.column("n").to_numpy()
        sketches = table.column("sketch").to_pylist()
        component = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
        docs = table.column("doc").to_numpy()
        found: list[np.ndarray] = []
        for head, end in zip(heads, np.append(heads[1:], len(group)), strict=True):
            rows = np.arange(head, end)
            block = own[rows] if low[head] != high[head] else None
            for i, j in differing(rows, n, component, block, sketches, percent):
                found.append(np.stack([np.minimum(docs[i], docs[j]), np.maximum(docs[i], docs[j])]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        kind = table.schema.field("doc").type
        return pa.table({"x": pa.array(pairs[0], kind), "y": pa.array(pairs[1], kind)})

    schema = T.StructType([T.StructField("x", kind), T.StructField("y", kind)])
    return work.groupBy("work").applyInArrow(compare, schema).distinct()


def ngram_components(docs: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Words part at ASCII white space, A-Z are lower-cased; a set holds the
    different five-word shingles of the whole text, or its words as one if there
    are fewer. Two documents are linked when 100 * intersection >= ``percent`` *
    union, and ``component_id`` is the smallest doc_id reachable by links. Null
    and empty texts have empty sets and are linked with nothing. Rows that repeat
    a doc_id are one document with the links of all of them. A null doc_id has
    no links and a null component. Other columns are ignored; an empty table
    gives no rows.
    """
    if not 50 <= percent <= 100:
        raise ValueError(f"the similarity must be 50 to 100 percent, not {percent}")
    spark = docs.sparkSession
    told = scratch.keep(describe_sets(docs), "sets")
    linked = told.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # Equal sets are one class from here on, named by its smallest document.
    classes = scratch.keep(
        linked.groupBy("a", "b", "n_shingles").agg(
            F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"),
            F.first("sample").alias("sample"),
        ),
        "classes",
    )

    def verified(candidates: DataFrame, step: str) -> DataFrame:
        candidates = scratch.keep(candidates, f"candidates{step}")
        ends = candidates.select(F.col("x").alias("doc_id")).union(candidates.select("y")).distinct()
        sets = scratch.keep(members_of(docs, ends), f"members{step}")
        links = scratch.keep(exact_links(candidates, sets, percent), f"links{step}")
        scratch.drop(f"candidates{step}")
        scratch.drop(f"members{step}")
        return links

    bands = plan_bands(classes, percent)
    stars = scratch.keep(meetings(indexed(docs, bands)), "meetings")

    def side(name: str, hashed: str, n: str, sketch: str) -> DataFrame:
        return classes.select(
            F.col("a").alias(hashed), F.col("doc").alias(name), F.col("n_shingles").alias(n), F.col("sketch").alias(sketch)
        )

    # All of them, as two similar sets can meet at one too large or small for either.
    met = scratch.keep(
        stars.join(side("x", "center", "n", "one"), "center").join(side("y", "other", "m", "two"), "other")
        .select("x", "y", "n", "m", "one", "two"),
        "met",
    )
    scratch.drop("meetings")
    pairs = met.filter(F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m"))
    first = verified(plausible(pairs, percent), "1")
    roots = connected_components(first, scratch)
    around = (
        met.select(F.col("x").alias("center"), F.col("y").alias("doc"), F.col("m").alias("n"), F.col("two").alias("sketch"))
        .unionByName(
            met.select(F.col("x").alias("center"), F.col("x").alias("doc"), "n", F.col("one").alias("sketch")).distinct()
        )
    )
    placed = around.join(roots, around.doc == roots.node, "left").select(
        "center", "doc", "n", "sketch", F.coalesce("root", "doc").alias("component")
    )
    placed = scratch.keep(placed, "around")
    scratch.drop("met")
    apart = placed.groupBy("center").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")
    ).filter("lo < hi")
    groups = placed.join(apart.select("center", "size"), "center")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    second = verified(around_centers(groups, least, percent), "2")
    scratch.drop("around")
    # Documents of several classes hold them together.
    several = linked.groupBy("doc_id").agg(F.countDistinct("a", "b").alias("n")).filter("n > 1").select("doc_id")
    shared = (
        linked.select("doc_id", "a", "b").join(several, "doc_id").join(classes.select("a", "b", "doc"), ["a", "b"])
        .select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    )
    final = connected_components(first.unionByName(second).unionByName(shared), scratch)
    named = classes.join(final, classes.doc == final.node, "left").select(
        F.col("a").alias("ca"), F.col("b").alias("cb"), F.coalesce("root", "doc").alias("component_id")
    )
    known = (told.a == F.col("ca")) & (told.b == F.col("cb")) & (told.n_shingles > 0) & told.doc_id.isNotNull()
    return told.join(named, known, "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
