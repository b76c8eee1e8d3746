"""Chat formatting of reply trees, in DataFrame functions only.

Paths from the root to every leaf come from self-joins with doubled jumps, so a
reply chain of n messages takes about log2(n) joins and no task ever holds a
tree. Branches are ranked by score, and every chosen path becomes one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.plans.scratch import Scratch

# Marks of the template, and strings of other templates that a
# text must not be able to imitate either.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = [
    START, SEPARATOR, END, "<|endoftext|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
]


def quoted(text: str) -> str:
    """Regular expression for exactly this text."""
    return "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in text)


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one after the first character of every
    control string, so that none occurs in the result."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    heads = "|".join(f"{quoted(c[0])}(?={quoted(c[1:])})" for c in CONTROL)
    return F.regexp_replace(doubled, f"({heads})", "$1\\\\")


def unescape(text: Column) -> Column:
    """Inverse of ``escape``."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def reply_paths(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Every root-to-leaf path as rows (tree_id, leaf_id, node_id, back).

    ``nodes`` has (tree_id, node_id, parent_id), one row per node; ``back`` is
    the distance from the leaf. A parent that is null, or is no node of the
    tree, ends the path. A chain that runs into a cycle has no root and gives
    no path. Rows without node_id are no nodes.
    """
    nodes = nodes.select("tree_id", "node_id", "parent_id").filter("node_id IS NOT NULL")
    same_tree = F.col("a.tree_id").eqNullSafe(F.col("b.tree_id"))

    def follow(rows: DataFrame, jumps: DataFrame, by: str) -> DataFrame:
        return rows.alias("a").join(
            jumps.alias("b"), same_tree & (F.col(f"a.{by}") == F.col("b.node_id"))
        )

    up = scratch.keep(
        follow(nodes, nodes, "parent_id").select("a.tree_id", "a.node_id", F.col("a.parent_id").alias("up")),
        "jump0",
    )
    total = nodes.count()
    jumps = [up]
    while 1 << len(jumps) <= total:
        longer = follow(jumps[-1], jumps[-1], "up").select("a.tree_id", "a.node_id", "b.up")
        longer = scratch.keep(longer, f"jump{len(jumps)}")
        if longer.isEmpty():
            break
        jumps.append(longer)
    # Only a cycle still has ancestors beyond the number of nodes.
    endless = follow(jumps[-1], jumps[-1], "up").select("a.tree_id", "a.node_id")
    parents = up.select("tree_id", F.col("up").alias("node_id")).distinct()

    def without(rows: DataFrame, others: DataFrame) -> DataFrame:
        return rows.alias("a").join(
            others.alias("b"),
            same_tree & (F.col("a.node_id") == F.col("b.node_id")),
            "left_anti",
        )

    leaves = without(without(nodes, parents), endless)
    paths = leaves.select(
        "tree_id", F.col("node_id").alias("leaf_id"), "node_id", F.lit(0).cast("bigint").alias("back")
    )
    for k in reversed(range(len(jumps))):
        # A distance is a sum of distinct powers of two: each ancestor comes once.
        far = follow(paths, jumps[k], "node_id").select(
            "a.tree_id", "a.leaf_id", F.col("b.up").alias("node_id"), (F.col("a.back") + (1 << k)).alias("back")
        )
        paths = scratch.keep(paths.unionByName(far), f"paths{k}")
    return paths


def format_conversations(nodes: DataFrame, scratch: Scratch, top: int | None = 1) -> DataFrame:
    """One row per chosen path: tree_id, leaf_id, branch_rank, score, n_turns,
    formatted, loss_mask.

    ``nodes`` has (tree_id, node_id, parent_id, role, text, score); other
    columns are ignored. Branches of a tree are ranked by the mean score of
    their messages, ties to the smaller leaf_id, and the best ``top`` are kept
    (None: all). ``loss_mask`` lists the spans (start, length), in code points
    of ``formatted``, of the escaped texts of the role ``assistant``.

    Null role or text count as empty, null score as 0. Rows that repeat a
    node_id in a tree: the smallest (parent_id, role, text, score) counts. An
    empty table gives no rows.
    """
    facts = F.struct("parent_id", "role", "text", "score")
    nodes = scratch.keep(
        nodes.filter("node_id IS NOT NULL").groupBy("tree_id", "node_id").agg(F.min(facts).alias("f"))
        .select("tree_id", "node_id", "f.*"),
        "nodes",
    )
    paths = reply_paths(nodes, scratch)
    turn = (
        F.concat(
            F.lit(START), escape(F.coalesce("role", F.lit(""))),
            F.lit(SEPARATOR), escape(F.coalesce("text", F.lit(""))), F.lit(END),
        )
    )
    told = nodes.select(
        "tree_id", "node_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
        turn.alias("turn"),
        (F.coalesce("role", F.lit("")) == "assistant").alias("learn"),
        F.char_length(escape(F.coalesce("text", F.lit("")))).cast("bigint").alias("length"),
    )
    steps = (
        paths.alias("a")
        .join(
            told.alias("b"),
            F.col("a.tree_id").eqNullSafe(F.col("b.tree_id")) & (F.col("a.node_id") == F.col("b.node_id")),
        )
        .select("a.tree_id", "a.leaf_id", "a.back", "b.score", "b.turn", "b.learn", "b.length")
    )
    branches = steps.groupBy("tree_id", "leaf_id").agg(F.avg("score").alias("score"))
    if top is not None:
        order = Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf_id")
        branches = branches.withColumn("branch_rank", F.row_number().over(order)).filter(F.col("branch_rank") <= top)
        steps = steps.alias("a").join(
            branches.alias("b"),
            F.col("a.tree_id").eqNullSafe(F.col("b.tree_id")) & (F.col("a.leaf_id") == F.col("b.leaf_id")),
        ).select("a.*", "b.branch_rank")
    else:
        steps = steps.withColumn("branch_rank", F.lit(None).cast("int"))
    so_far = Window.partitionBy("tree_id", "leaf_id").orderBy(F.desc("back"))
    placed = steps.withColumn(
        "at", F.sum(F.char_length("turn")).over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("at", F.col("at") - len(END) - F.col("length"))
    whole = placed.groupBy("tree_id", "leaf_id", "branch_rank").agg(
        F.avg("score").alias("score"),
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct(-F.col("back"), "turn", "learn", "at", "length"))).alias("turns"),
    )
    return whole.select(
        "tree_id", "leaf_id", "branch_rank", "score", "n_turns",
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform(
            F.filter("turns", lambda t: t["learn"]),
            lambda t: F.struct(t["at"].alias("start"), t["length"].alias("length")),
        ).alias("loss_mask"),
    )


def parse_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    parts = F.split(formatted, quoted(END))
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        sides = F.split(F.substring(part, len(START) + 1, 1 << 30), quoted(SEPARATOR), 2)
        return F.struct(
            unescape(F.get(sides, F.lit(0))).alias("role"), unescape(F.get(sides, F.lit(1))).alias("text")
        )

    return F.transform(parts, turn)


def learned_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""

    def span(s: Column) -> Column:
        return unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))

    return F.array_join(F.transform(loss_mask, span), "")
