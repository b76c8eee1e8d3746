"""Divergence of sources from each other and from their language, over term counts.

The terms of a language are dealt out to blocks. In a block the counts of every
source are the leaves of a segment tree; subtrees of equal counts are one node,
whichever source they are from. Two trees are walked side by side, and every pair
of nodes that comes up is priced once. Prices of blocks are added up. All numbers
are whole ones, so sums are exact in any order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.plans.joins import lookup
from themeloom.plans.scratch import Scratch

# A term is kept from so many documents of its language.
MIN_DOCS = 10
# Shares are whole numbers out of so many, with so much added to every count.
WHOLE, ADDED = 1_000_000_000, 2
# Terms of each source that are reported.
TOP_TERMS = 10
# Terms of a block, and sources whose trees are walked in one task.
BLOCK, TILE = 2048, 64
# Bytes of text split at a time; different terms counted by a task before it hands them on.
PIECE, HELD = 1 << 20, 200_000

# Bytes outside of terms become spaces, A-Z become a-z.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def text_pieces(data: bytes) -> Iterator[bytes]:
    """A text in pieces that end at spaces."""
    low = 0
    while low < len(data):
        high = low + PIECE
        if high < len(data):
            space = data.find(b" ", high)
            high = len(data) if space < 0 else space
        yield data[low:high]
        low = high


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, in
    parts still to be added up. Needs (lang, source, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (terms, seen) in found.items():
                words = list(terms)
                names = ["lang", "source", "term", "n", "docs"]
                columns = [
                    pa.array([lang] * len(words), pa.string()), pa.array([source] * len(words), pa.string()),
                    pa.array([w.decode() for w in words], pa.string()), pa.array(list(terms.values()), pa.int64()),
                    pa.array([seen[w] for w in words], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            found.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms, seen = found.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(terms), set()
                for piece in text_pieces(text.encode().translate(LETTERS)):
                    words = piece.split()
                    terms.update(words)
                    own.update(words)
                seen.update(own)
                held += len(terms) - before
                if held >= HELD:
                    yield from told()
                    held = 0
        yield from told()

    schema = "lang STRING, source STRING, term STRING, n BIGINT, docs BIGINT"
    return docs.select("lang", "source", "text").mapInArrow(work, schema)


def share(count: Column, mass: Column) -> Column:
    """1 + floor(WHOLE * (count + ADDED) / mass), exact."""
    top = F.lit(WHOLE).cast("decimal(10,0)") * (count + ADDED).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", top, mass.cast("decimal(20,0)"))


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_counts(docs: DataFrame, scratch: Scratch, min_docs: int) -> DataFrame:
    """(lang, source, term, n, total) of the terms in enough documents of their language."""
    counts = (
        count_terms(docs)
        .repartition("lang", "term")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    whole = Window.partitionBy("lang", "term")
    kept = counts.select(
        "lang", "source", "term", "n", F.sum("n").over(whole).alias("total"), F.sum("docs").over(whole).alias("_docs")
    ).filter(F.col("_docs") >= min_docs)
    return scratch.keep(kept.drop("_docs"), "kept")


def group_masses(docs: DataFrame, kept: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, source, mass, lang_mass, terms, cells, sources) of every group that
    occurs: the mass is its count of kept terms and ADDED for each term."""
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("cells"))
    groups = docs.groupBy("lang", "source").agg(F.lit(0).alias("_"))
    groups = groups.join(by_group, ["lang", "source"], "left").drop("_")
    terms = kept.groupBy("lang", "term").agg(F.max("total").alias("total"))
    by_lang = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("total"))
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    by_lang = sources.join(by_lang, "lang", "left")
    zero = F.lit(0).cast("bigint")
    terms = F.coalesce("terms", zero)
    masses = groups.join(by_lang, "lang").select(
        "lang", "source",
        (F.coalesce("n", zero) + ADDED * terms).alias("mass"),
        (F.coalesce("total", zero) + ADDED * terms).alias("lang_mass"),
        terms.alias("terms"), F.coalesce("cells", zero).alias("cells"), "sources",
    )
    return scratch.keep(masses, "masses")


def pair_prices(kept: DataFrame, masses: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all other sources of each source's language."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / BLOCK)).cast("int")
    tiles = F.ceil(F.col("sources") / TILE).cast("int")
    sizes = masses.withColumns({"blocks": blocks, "tiles": tiles})
    langs = sizes.groupBy("lang").agg(F.max("blocks").alias("blocks"), F.max("tiles").alias("tiles"))
    cells = kept.join(langs, "lang").withColumn(
        "block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    )
    # Every source is in every block, with or without terms there, and knows how many
    # terms the block has: some may occur in no source of two tiles.
    held = cells.select("lang", "block", "term").distinct().groupBy("lang", "block").agg(F.count("*").alias("held"))
    marks = sizes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    marks = marks.join(held, ["lang", "block"], "left")
    no_term = F.lit(None).cast("string")
    rows = cells.select("lang", "block", "tiles", "source", "term", "n", "total").unionByName(
        marks.select(
            "lang", "block", "tiles", "source", no_term.alias("term"), F.col("mass").alias("n"),
            F.coalesce("held", F.lit(0).cast("bigint")).alias("total"),
        )
    )
    # Tiles of sources meet in pairs, so a task holds two tiles of one block.
    own = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    met = rows.withColumn("own", own).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select(
        "lang", "block", F.least("own", "_with").alias("a"), F.greatest("own", "_with").alias("b"),
        "own", "source", "term", "n", "total",
    )
    schema = "lang STRING, source STRING, item STRING, value BIGINT"
    parts = met.groupBy("lang", "block", "a", "b").applyInArrow(walk_block, schema)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def walk_block(group: pa.Table) -> pa.Table:
    """Prices of all pairs of sources of two tiles over one block of terms."""
    lang, a, b = (group.column(c)[0].as_py() for c in ("lang", "a", "b"))
    marks, places = {}, 0
    cells: list[tuple[str, str, int]] = []
    totals: dict[str, int] = {}
    for own, source, term, n, total in zip(
        *(group.column(c).to_pylist() for c in ("own", "source", "term", "n", "total")), strict=True
    ):
        if term is None:
            marks[source], places = (own, n), total
        else:
            cells.append((source, term, n))
            totals[term] = total
    sources = sorted(marks)
    row = {s: i for i, s in enumerate(sources)}
    # Frequent terms first, so that the zeros of rare ones make large equal subtrees.
    spot = {t: i for i, t in enumerate(sorted(totals, key=lambda t: (-totals[t], t)))}
    counts = np.zeros((len(sources), places), np.int64)
    for source, term, n in cells:
        counts[row[source], spot[term]] = n
    forest = Forest(counts, [marks[s][1] for s in sources])
    tile = np.array([marks[s][0] for s in sources])
    one, two, prices = [], [], []
    for i in range(len(sources)):
        # Of two tiles each source of one meets each of the other; of one, the later ones.
        others = np.arange(i + 1, len(sources)) if a == b else np.flatnonzero(tile == b) if tile[i] == a else []
        if len(others):
            found = forest.prices(i, np.asarray(others))
            one += [sources[i]] * len(others)
            two += [sources[j] for j in others]
            prices.append(found)
    value = np.concatenate(prices) if prices else np.zeros(0, np.int64)
    return pa.table(
        {
            "lang": pa.array([lang] * (2 * len(one)), pa.string()),
            "source": pa.array(one + two, pa.string()),
            "item": pa.array(two + one, pa.string()),
            "value": np.concatenate([value, value]),
        }
    )


class Forest:
    """Segment trees over the same places, with equal subtrees as one node."""

    def __init__(self, counts: np.ndarray, masses: list[int]) -> None:
        """``counts`` (tree, place); nodes of a level are numbered on their own."""
        trees, places = counts.shape
        width = 1 << max(places - 1, 0).bit_length()
        values, leaves = np.unique(counts, return_inverse=True)
        # Places beyond the terms are a leaf of their own, which costs nothing.
        self.nothing = len(values)
        level = np.full((trees, width), self.nothing)
        level[:, :places] = leaves.reshape(counts.shape)
        self.shares = np.zeros((trees, len(values) + 1), np.int64)
        for tree, mass in enumerate(masses):
            for leaf in np.unique(level[tree]):
                if leaf != self.nothing:
                    # Python's numbers, as the product may pass 64 bits.
                    self.shares[tree, leaf] = 1 + WHOLE * (int(values[leaf]) + ADDED) // mass
        # Children of the nodes of each level, from the leaves up.
        self.children: list[np.ndarray] = []
        while level.shape[1] > 1:
            pairs = level[:, ::2].astype(np.int64) << 32 | level[:, 1::2]
            nodes, level = np.unique(pairs, return_inverse=True)
            level = level.reshape(pairs.shape)
            self.children.append(np.stack([nodes >> 32, nodes & 0xFFFFFFFF]))
        self.roots = level[:, 0]

    def prices(self, tree: int, others: np.ndarray) -> np.ndarray:
        """Price of one tree with each of others."""
        pairs = np.stack([np.arange(len(others)), np.full(len(others), self.roots[tree]), self.roots[others]])
        steps = []
        for children in reversed(self.children):
            (left, right), (low, high) = children[:, pairs[1]], children[:, pairs[2]]
            below = np.concatenate([np.stack([pairs[0], left, low]), np.stack([pairs[0], right, high])], axis=1)
            # Three numbers in one, which is below trees * nodes * nodes.
            ones, twos = int(below[1].max()) + 1, int(below[2].max()) + 1
            codes, back = np.unique((below[0] * ones + below[1]) * twos + below[2], return_inverse=True)
            pairs = np.stack([codes // twos // ones, codes // twos % ones, codes % twos])
            steps.append(back)
        p, q = self.shares[tree, pairs[1]], self.shares[others[pairs[0]], pairs[2]]
        found = np.where(pairs[1] == self.nothing, 0, (p - q) ** 2 // np.maximum(p + q, 1))
        for back in reversed(steps):
            both = found[back]
            found = both[: len(both) // 2] + both[len(both) // 2 :]
        return found


def term_prices(kept: DataFrame, masses: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank) of the terms that a source has more of than
    its language."""
    group = F.struct("lang", "source")
    cells = kept.withColumn("group", group)
    known = masses.filter("cells > 0").select(group.alias("group"), "mass", "lang_mass", "cells")
    near = lookup(cells, known, "group", weight="cells", spread_by=["term"])
    p, q = share(F.col("n"), F.col("mass")), share(F.col("total"), F.col("lang_mass"))
    priced = near.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (
        priced.select("lang", "source", "item", price(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
    )


def audit_sources(
    docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from every
    other one of its language (part ``pair``), and in which terms from all of the
    language (part ``term``).

    Needs (text, lang, source), nulls count as empty; other columns change nothing,
    and every row is a document, equal ones too. Ties go to the smaller item in
    UTF-8. A source alone in its language has no pair, and one without kept terms no
    terms. An empty table gives no rows.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = kept_counts(docs, scratch, min_docs)
    masses = group_masses(docs, kept, scratch)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_prices(kept, masses).withColumn("rank", F.row_number().over(order))
    terms = term_prices(kept, masses, top_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.withColumn("part", F.lit("pair"))
        .select(*columns)
        .unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
    )
