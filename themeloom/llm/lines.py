"""Line dedup by log templates, in DataFrame functions only.

A line goes down a tree of fixed depth: its number of tokens, then its first
tokens, variable ones (those with a digit) as ``<*>``. Lines of one leaf are
generalised: a token stays where enough documents have it at that place, the
rest are variable fields. Templates that recur across documents are dropped,
but for their first line, so no content is lost altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.plans.joins import lookup
from themeloom.plans.scratch import Scratch

# Leading tokens that a line is sorted by, after its number of tokens.
DEPTH = 3
# A token is part of a template, and a template is recurring, from so many documents.
MIN_DOCS = 2
# Share of the tokens of a line, variable fields aside, that its template must keep.
SIMILARITY = 0.75
# Lines with fewer tokens, variable fields aside, are never dropped.
MIN_TOKENS = 4

FIELD = "<*>"
# Rows of the bitmap, of 64 bits each, that tells which texts need not be shuffled.
SIEVE = 1 << 17


def masked(line: Column) -> Column:
    """Tokens of a line with single spaces between, those with a digit as FIELD."""
    odd = F.rlike(line, F.lit(r"[\t\x0B\f\r]|  |^ | $"))
    single = F.when(odd, F.trim(F.regexp_replace(line, r"[ \t\x0B\f\r]+", " "))).otherwise(line)
    fields = F.regexp_replace(single, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)
    return F.when(F.rlike(single, F.lit("[0-9]")), fields).otherwise(single)


def occurrences(text: Column, part: str) -> Column:
    left = F.octet_length(F.replace(text, F.lit(part), F.lit("")))
    return F.floor((F.octet_length(text) - left) / len(part))


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc, line_no, leaf, shape, words): one row per line that can be dropped.

    ``leaf`` is a hash of the line's place in the tree, ``shape`` one of its masked
    tokens; lines are the same if both are. ``words`` counts tokens that are no
    field.
    """
    # The masks are made before the rows are, else each use would make them again.
    masks = docs.select(
        "doc", F.posexplode(F.transform(F.split("text", "\n"), masked)).alias("line_no", "mask")
    ).filter("mask <> ''")
    tokens = occurrences(F.col("mask"), " ") + 1
    spaced = F.concat(F.lit(" "), F.replace("mask", F.lit(" "), F.lit("  ")), F.lit(" "))
    fields = F.when(F.contains("mask", F.lit(FIELD)), occurrences(spaced, f" {FIELD} ")).otherwise(0)
    return masks.select(
        "doc",
        "line_no",
        F.xxhash64(tokens, F.substring_index("mask", " ", DEPTH)).alias("leaf"),
        F.xxhash64("mask").alias("shape"),
        (tokens - fields).cast("int").alias("words"),
    ).filter(F.col("words") >= MIN_TOKENS)


def bit_of(name: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64({name}), 32), 64) AS INT))")


def sieve(keys: DataFrame, name: str) -> DataFrame:
    """(_word, _bits): a bitmap of the hashes of ``keys``, of at most SIEVE rows."""
    return keys.select(
        F.pmod(F.xxhash64(name), F.lit(SIEVE)).alias("_word"), bit_of(name).alias("_bit")
    ).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def sifted(rows: DataFrame, bitmap: DataFrame, name: str) -> DataFrame:
    """Adds ``_maybe``: false only for rows whose key is not in the bitmap."""
    marked = rows.withColumn("_word", F.pmod(F.xxhash64(name), F.lit(SIEVE))).join(F.broadcast(bitmap), "_word", "left")
    held = F.coalesce(F.col("_bits"), F.lit(0).cast("bigint")).bitwiseAND(bit_of(name)) != 0
    return marked.withColumn("_maybe", held).drop("_word", "_bits")


def generalise(
    docs: DataFrame, shapes: DataFrame, scratch: Scratch, min_docs: int, similarity: float
) -> DataFrame:
    """(leaf, shape, template) of the shapes whose tokens are constant often enough.

    ``shapes`` has (leaf, shape, n_docs, words, first): the shapes of leaves that
    hold several. One line of each is read again, ``first``, and its tokens are
    counted by leaf and place.
    """
    wanted = scratch.keep(
        shapes.groupBy(F.col("first.doc").alias("doc")).agg(
            F.collect_list(F.struct("first.line_no", "leaf", "shape", "n_docs", "words")).alias("wanted")
        ),
        "wanted",
    )
    some = sifted(docs, scratch.keep(sieve(wanted, "doc"), "wanted-sieve"), "doc").filter("_maybe").drop("_maybe")
    lines = F.split("text", "\n")
    masks = some.join(wanted, "doc").withColumn("lines", lines).select(
        F.explode(
            F.transform("wanted", lambda w: F.struct(w.alias("w"), masked(F.get("lines", w["line_no"])).alias("mask")))
        ).alias("m")
    )
    tokens = masks.select("m.w.*", F.posexplode(F.split("m.mask", " ")).alias("place", "token"))
    spots = tokens.filter(F.col("token") != FIELD).select(
        "leaf", "shape", "n_docs", "words", F.xxhash64("leaf", "place", "token").alias("spot")
    )
    spots = scratch.keep(spots, "spots")
    support = spots.groupBy("spot").agg(F.sum("n_docs").alias("docs"), F.count("*").alias("shapes"))
    constant = scratch.keep(support.filter(F.col("docs") >= min_docs).select("spot", "shapes"), "constant")
    kept = lookup(spots, constant, "spot", weight="shapes", spread_by=["shape"])
    return (
        kept.groupBy("leaf", "shape", "words")
        .agg(F.sort_array(F.collect_list("spot")).alias("constants"))
        .filter(F.size("constants") >= F.lit(similarity) * F.col("words"))
        .select("leaf", "shape", F.xxhash64("constants").alias("template"))
    )


def recurring_lines(
    docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY
) -> DataFrame:
    """(doc, line_no) of the lines to drop: every line of a recurring template
    but the first in the order of documents and lines."""
    lines = scratch.keep(document_lines(docs), "lines")
    # Only leaves of several documents go on: most lines stand alone.
    busy = (
        lines.groupBy("leaf")
        .agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n"),
             F.min("shape").alias("least"), F.max("shape").alias("most"))
        .filter("lo <> hi")
        .select("leaf", "n", (F.col("least") != F.col("most")).alias("mixed"))
    )
    busy = scratch.keep(busy, "busy")
    lines = scratch.keep(lookup(lines, busy, "leaf", weight="n", spread_by=["doc", "line_no"]), "busy-lines")
    by_shape = (
        lines.groupBy("leaf", "shape", "doc")
        .agg(F.min("line_no").alias("line_no"), F.count("*").alias("n"), F.max("words").alias("words"),
             F.max("mixed").alias("mixed"))
        .groupBy("leaf", "shape")
        .agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"), F.max("words").alias("words"),
             F.max("mixed").alias("mixed"), F.min(F.struct("doc", "line_no")).alias("first"))
    )
    shapes = scratch.keep(by_shape, "shapes")
    general = generalise(docs, shapes.filter("mixed"), scratch, min_docs, similarity)
    # A shape of its own, or one that shares its template with other shapes.
    named = shapes.join(general, ["leaf", "shape"], "left").select(
        "leaf", "shape", "n", "n_docs", F.coalesce("template", "shape").alias("template")
    )
    named = scratch.keep(named, "templates")
    repeated = named.groupBy("leaf", "template").agg(F.sum("n_docs").alias("n_docs")).filter(
        F.col("n_docs") >= min_docs
    )
    suspects = named.join(repeated.select("leaf", "template"), ["leaf", "template"], "left_semi").select(
        F.struct("leaf", "shape").alias("line"), "template", "n"
    )
    suspects = scratch.keep(suspects, "suspects")
    spread = lookup(
        lines.select("doc", "line_no", F.struct("leaf", "shape").alias("line")),
        suspects, "line", weight="n", spread_by=["doc", "line_no"],
    ).select("doc", "line_no", F.struct("line.leaf", "template").alias("template"))
    spread = scratch.keep(spread, "suspect-lines")
    recurring = (
        spread.groupBy("template", "doc")
        .agg(F.min("line_no").alias("line_no"), F.count("*").alias("n"))
        .groupBy("template")
        .agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"), F.min(F.struct("doc", "line_no")).alias("first"))
        .filter(F.col("n_docs") >= min_docs)
        .select("template", "n", "first")
    )
    recurring = scratch.keep(recurring, "recurring")
    hits = lookup(spread, recurring, "template", weight="n", spread_by=["doc", "line_no"])
    return hits.filter(F.struct("doc", "line_no") != F.col("first")).select("doc", "line_no")


def dedup_lines(
    docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY
) -> DataFrame:
    """The columns of ``docs`` with lines dropped from ``text``, and n_lines and
    n_dropped, BIGINT.

    ``docs`` needs (doc_id, text); other columns are kept, but for its own
    n_lines and n_dropped. Lines end at line feeds. A line whose template recurs
    in ``min_docs`` documents is dropped unless it is the template's first, by
    doc_id (null first), text and line. Repeats within one document alone stay,
    and so do lines with fewer than MIN_TOKENS tokens that are no fields. Rows
    with equal doc_id and text are one document and lose the same lines. Null
    texts stay null with 0 lines, empty ones stay empty with 1; a text that
    loses all lines is empty. An empty table gives no rows.
    """
    # The identity of a document, also where ids repeat or are missing.
    whole = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))
    keyed = docs.filter("text IS NOT NULL").select(whole.alias("doc"), "text")
    drops = recurring_lines(keyed, scratch, min_docs, similarity)
    dropped = scratch.keep(drops.groupBy("doc").agg(F.collect_set("line_no").alias("gone")), "dropped")
    bitmap = scratch.keep(sieve(dropped, "doc"), "dropped-sieve")
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = sifted(docs.select(whole.alias("doc"), F.struct(*others).alias("row")), bitmap, "doc")
    # Only documents that may lose lines are shuffled.
    cut = rows.filter("_maybe").join(dropped, "doc", "left").select("row", "gone")
    same = rows.filter("NOT _maybe").select("row", F.lit(None).cast("array<int>").alias("gone"))
    lines = F.split("row.text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    )
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size("lines"))
    return cut.unionByName(same).withColumn("lines", lines).select(
        *[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in others],
        n_lines.cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
