"""Near-duplicate vectors: randomised-rotation binary codes with correction factors.

A unit vector is rotated at random several times; the signs are its code, and
for each rotation the inner product of code and vector is stored as a
correction factor. Code and factor give an unbiased estimate of an inner
product and bounds for it: pairs whose upper bound misses the threshold are
done, the rest are computed exactly. Pairs come from equal runs of code bits,
as many runs as make a missed pair less likely than MISSED.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.components import connected_components
from themeloom.llm.vectors import doubles, name_of, usable
from themeloom.plans.joins import lookup
from themeloom.plans.scratch import Scratch

COSINE = 0.98
# Chance that a pair just at the threshold shares no run of bits, and deviations
# of an estimate that its bounds allow for.
MISSED, DEVIATIONS = 1e-7, 6.0
# Vectors that share a run by chance, aimed at; larger groups are cut in blocks.
SHARED, BLOCK = 4, 1024
# Vectors and pairs handled at a time.
ROWS, PAIRS = 8192, 1 << 16
SEED = 7561


@dataclass(frozen=True)
class Codes:
    """Rotations of one number of components and the runs taken from their bits."""

    rotations: np.ndarray  # rotation, component, component
    tables: int
    bits: int

    def rotate(self, unit: np.ndarray) -> np.ndarray:
        return np.einsum("nd,rde->nre", unit, self.rotations)

    def runs(self, signs: np.ndarray) -> np.ndarray:
        """Value of every run of bits (vector, table), from signs (vector, rotation, component)."""
        flat = signs.reshape(len(signs), -1)[:, : self.tables * self.bits]
        weights = np.int64(1) << np.arange(self.bits, dtype=np.int64)
        return flat.reshape(len(signs), self.tables, self.bits).astype(np.int64) @ weights


def make_codes(size: int, rows: int, cosine: float, seed: int = SEED) -> Codes:
    """Codes for ``rows`` vectors in the largest group that is compared."""
    bits = min(40, max(6, math.ceil(math.log2(max(2, rows / SHARED)))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    tables = math.ceil(math.log(MISSED) / math.log1p(-same))
    rotations = math.ceil(tables * bits / size)
    rng = np.random.default_rng([seed, size])
    return Codes(np.stack([np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(rotations)]), tables, bits)


def upper_bounds(
    rotated: np.ndarray, signs: np.ndarray, factors: np.ndarray, i: np.ndarray, j: np.ndarray
) -> np.ndarray:
    """Largest plausible cosine of the pairs (i, j).

    For a code x' of x with f = <x', x>, the estimate <x', y> / f of <x, y> has no
    bias, and its deviation is at most sqrt((1 - f^2) / f^2 / (d - 1)). The mean
    over rotations is taken.
    """
    count, size = rotated.shape[1:]
    codes = np.where(signs[j], 1.0, -1.0) / math.sqrt(size)
    estimate = (np.einsum("prd,prd->pr", codes, rotated[i]) / factors[j]).mean(axis=1)
    spread = (1 - factors[j] ** 2) / factors[j] ** 2 / max(1, size - 1)
    return estimate + DEVIATIONS * np.sqrt(np.maximum(spread, 0).sum(axis=1)) / count


def encode_vectors(classes: DataFrame, codes: dict[int, Codes]) -> DataFrame:
    """Adds code (packed signs), factors, and runs, the value of each run of bits."""
    sent = classes.sparkSession.sparkContext.broadcast(codes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                code: list = [None] * batch.num_rows
                factors, runs = list(code), list(code)
                for at, unit in unit_vectors(batch.column("v")):
                    own = sent.value[unit.shape[1]]
                    rotated = own.rotate(unit)
                    signs = rotated >= 0
                    f = np.abs(rotated).sum(axis=2) / math.sqrt(unit.shape[1])
                    packed = np.packbits(signs.reshape(len(at), -1), axis=1)
                    values = own.runs(signs)
                    for row, i in enumerate(at):
                        code[i], factors[i], runs[i] = packed[row].tobytes(), f[row], values[row]
                yield (
                    batch.append_column("code", pa.array(code, pa.binary()))
                    .append_column("factors", pa.array(factors, pa.list_(pa.float64())))
                    .append_column("runs", pa.array(runs, pa.list_(pa.int64())))
                )

    extra = classes.select(
        "*", F.lit(b"").alias("code"), F.array(F.lit(0.0)).alias("factors"),
        F.array(F.lit(0).cast("bigint")).alias("runs"),
    )
    return classes.mapInArrow(encode, extra.schema)


def unit_vectors(column: pa.Array) -> Iterator[tuple[list[int], np.ndarray]]:
    """Rows and unit vectors, for each number of components."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows.tolist(), normalised(matrix(column.take(pa.array(rows))))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def normalised(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that no square is too large or too small.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def linked_in_groups(work: DataFrame, codes: dict[int, Codes], cosine: float) -> DataFrame:
    """(node, n, root): links of a class found in one group, in vectors, and the
    smallest class that they lead to there.

    ``work`` is sorted by group; rows have group, node, at, the number of the run,
    own and across, which tell the blocks of a group that is cut, and copies, v,
    code and factors of the class.
    """
    sent = work.sparkSession.sparkContext.broadcast(codes)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            groups = table.column("group").to_numpy()
            heads = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
            # The last group may go on in the next batch.
            for begin, end in pieces(heads, int(heads[-1])):
                yield from answer(table.slice(begin, end - begin))
            rest = table.slice(int(heads[-1]))
        if rest is not None and rest.num_rows:
            yield from answer(rest)

    def pieces(heads: np.ndarray, last: int) -> Iterator[tuple[int, int]]:
        begin = 0
        while begin < last:
            further = heads[heads <= begin + ROWS]
            end = int(further[-1]) if len(further) and further[-1] > begin else int(heads[heads > begin][0])
            yield begin, min(end, last)
            begin = min(end, last)

    def answer(table: pa.Table) -> Iterator[pa.RecordBatch]:
        sizes = pc.list_value_length(table.column("v"))
        for size in pc.unique(sizes).to_pylist():
            found = compare(table.filter(pc.equal(sizes, size)).combine_chunks(), sent.value[size], cosine)
            if found is not None:
                yield found

    return work.mapInArrow(link, "node string, n bigint, root string")


def compare(table: pa.Table, coder: Codes, cosine: float) -> pa.RecordBatch | None:
    """Links between the rows of whole groups, all of one number of components."""
    n = table.num_rows
    groups = table.column("group").to_numpy()
    at = table.column("at").to_numpy()
    own, across = table.column("own").to_numpy(), table.column("across").to_numpy(zero_copy_only=False)
    copies = table.column("copies").to_numpy()
    unit = normalised(matrix(table.column("v")))
    size = unit.shape[1]
    packed = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(n, -1)
    shape = (n, len(coder.rotations), size)
    signs = np.unpackbits(packed, axis=1, count=shape[1] * size).reshape(shape).astype(bool)
    factors = matrix(table.column("factors"))
    runs = coder.runs(signs)
    rotated = coder.rotate(unit)
    earlier = np.arange(coder.tables)
    links = np.zeros(n, np.int64)
    ends: list[np.ndarray] = []

    def settle(i: np.ndarray, j: np.ndarray) -> None:
        # A pair counts in the first run it shares, and a pair of blocks only across.
        first = ~((runs[i] == runs[j]) & (earlier < at[i][:, None])).any(axis=1)
        first &= ~across[i] | (own[i] != own[j])
        i, j = i[first], j[first]
        some = upper_bounds(rotated, signs, factors, i, j) >= cosine
        i, j = i[some], j[some]
        near = (unit[i] * unit[j]).sum(axis=1) >= cosine
        i, j = i[near], j[near]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        ends.append(np.stack([i, j]))

    alive = np.arange(n - 1)
    step, waiting, held = 1, [], 0
    while len(alive):
        alive = alive[alive + step < n]
        alive = alive[groups[alive] == groups[alive + step]]
        for some in np.array_split(alive, max(1, len(alive) // PAIRS + 1)):
            waiting.append((some, some + step))
            held += len(some)
            if held >= PAIRS // 4:
                settle(*(np.concatenate(side) for side in zip(*waiting, strict=True)))
                waiting, held = [], 0
        step += 1
    if held:
        settle(*(np.concatenate(side) for side in zip(*waiting, strict=True)))
    linked = np.flatnonzero(links)
    if not len(linked):
        return None
    pairs = np.concatenate(ends, axis=1)
    nodes = table.column("node").to_pylist()
    order = np.unique(nodes, return_inverse=True)[1]
    root = np.arange(n)
    while True:  # every row takes the smallest root of its links until none changes
        small = np.where(order[root[pairs[0]]] <= order[root[pairs[1]]], root[pairs[0]], root[pairs[1]])
        before = root.copy()
        for side in pairs:
            better = np.lexsort((order[small], side))
            heads = np.flatnonzero(np.append(True, side[better][1:] != side[better][:-1]))
            to, best = side[better][heads], small[better][heads]
            gain = order[best] < order[root[to]]
            root[to[gain]] = best[gain]
        root = np.where(order[root[root]] < order[root], root[root], root)
        if (root == before).all():
            break
    return pa.record_batch(
        {
            "node": pa.array([nodes[i] for i in linked], pa.string()),
            "n": pa.array(links[linked], pa.int64()),
            "root": pa.array([nodes[root[i]] for i in linked], pa.string()),
        }
    )


def near_duplicate_vectors(
    rows: DataFrame, scratch: Scratch, cosine: float = COSINE, vector: str = "embedding"
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    ``rows`` has (vec_id, ``vector``, label); other columns are ignored. Rows of
    one label are linked where their cosine in double precision is ``cosine`` or
    more; every link reported is exact, and a pair at the threshold is missed
    with chance MISSED. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest vec_id reachable by links, and a row is kept
    if that is its own. Vectors that are null, empty or zero or hold null or
    non-finite components, and rows without label, are linked with nothing, and
    vectors of different numbers of components are not linked. Rows that repeat
    a vector are linked, also those that repeat a vec_id. A null vec_id is no
    smallest id: without another in its component, component_id and kept are
    null. An empty table gives no rows.

    Equal vectors are one class with a number of copies, so copies are never
    expanded into pairs.
    """
    if not 0 < cosine <= 1:
        raise ValueError(f"the cosine must be in (0, 1], not {cosine}")
    told = rows.select("vec_id", F.col(vector).alias("raw"), "label")
    takes = usable("raw") & F.col("label").isNotNull()
    named = told.withColumn("name", F.when(takes, name_of("label", doubles("raw"))))
    classes = scratch.keep(
        named.filter("name IS NOT NULL").groupBy("name").agg(
            F.first("label").alias("label"), F.first("raw").alias("v"), F.min("vec_id").alias("least"),
            F.count("*").alias("copies"),
        ).withColumn("node", F.concat(*[F.lpad(F.hex(f"name.{h}"), 16, "0") for h in ("h1", "h2")])),
        "classes",
    )
    spans = classes.groupBy("label", F.size("v").alias("d")).count().groupBy("d").agg(F.max("count").alias("most"))
    codes = {row.d: make_codes(row.d, row.most, cosine) for row in spans.toLocalIterator()}
    coded = scratch.keep(encode_vectors(classes.drop("name", "least"), codes), "codes")
    group = F.xxhash64("label", F.size("v"), "at", "run").alias("group")
    in_runs = coded.select("node", "label", "v", F.posexplode("runs").alias("at", "run")).select("node", "at", group)
    in_runs = scratch.keep(in_runs, "runs")
    sizes = in_runs.groupBy("group").agg(F.count("*").alias("members")).filter("members > 1")
    sizes = scratch.keep(sizes.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")), "groups")
    shared = lookup(in_runs, sizes, "group", weight="members", spread_by=["node"])
    # A large group is cut in blocks, and every pair of blocks is compared on its own.
    cut = shared.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = cut.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = F.xxhash64("group", F.least("own", "partner"), F.greatest("own", "partner"))
    places = paired.select(
        F.when(F.col("blocks") == 1, F.col("group")).otherwise(blocks).alias("group"),
        "node", "at", "own", (F.col("own") != F.col("partner")).alias("across"),
    )
    work = places.join(coded.select("node", "copies", "v", "code", "factors"), "node")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.keep(
        linked_in_groups(work.repartition(parts, "group").sortWithinPartitions("group"), codes, cosine), "links"
    )
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    counted = found.groupBy("node").agg(F.sum("n").alias("n"))
    placed = classes.join(counted, "node", "left").join(roots, "node", "left").select(
        "name", "least", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("root"),
    )
    placed = scratch.keep(placed, "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    answers = scratch.keep(
        lookup(placed, least, "root", weight="members", spread_by=["name"]).select(
            "name", "copies", "n_links", "component_id"
        ),
        "answers",
    )
    known = lookup(
        named.filter("name IS NOT NULL").select("vec_id", "name"), answers, "name", weight="copies", spread_by=["vec_id"]
    ).select("vec_id", "n_links", "component_id")
    alone = named.filter("name IS NULL").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return known.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
