import hashlib
import random

from pyspark.sql import functions as F

from themeloom.llm import chat

NODES = "tree_id BIGINT, node_id BIGINT, parent_id BIGINT, role STRING, text STRING, score DOUBLE"


def formatted(spark, scratch, rows, top=1):
    talks = chat.format_conversations(spark.createDataFrame(rows, NODES), scratch, top)
    read = talks.withColumn("turns", chat.parse_turns(F.col("formatted"))).withColumn(
        "learned", chat.learned_text(F.col("formatted"), F.col("loss_mask"))
    )
    return sorted(read.collect(), key=lambda r: (r.tree_id is not None, r.tree_id, r.branch_rank or 0, r.leaf_id))


def test_branches_are_ranked_by_score(spark, scratch):
    rows = [
        (1, 1, None, "user", "q", 0.0),
        (1, 2, 1, "assistant", "good", 3.0),
        (1, 3, 1, "assistant", "bad", 1.0),
        (1, 4, 2, "user", "thanks", 3.0),
        (2, 1, None, "user", "alone", None),
    ]
    best = formatted(spark, scratch, rows)
    assert [(r.tree_id, r.leaf_id, r.n_turns, r.score) for r in best] == [(1, 4, 3, 2.0), (2, 1, 1, 0.0)]
    assert [(t.role, t.text) for t in best[0].turns] == [("user", "q"), ("assistant", "good"), ("user", "thanks")]
    assert best[0].learned == "good"
    two = formatted(spark, scratch, rows, top=2)
    assert [(r.tree_id, r.leaf_id, r.branch_rank) for r in two] == [(1, 4, 1), (1, 3, 2), (2, 1, 1)]
    every = formatted(spark, scratch, rows, top=None)
    assert sorted((r.tree_id, r.leaf_id) for r in every) == [(1, 3), (1, 4), (2, 1)]


def test_long_chain_and_tied_scores(spark, scratch):
    rows = [(7, i, i - 1 if i else None, "assistant", f"t{i}", 1.0) for i in range(37)]
    rows += [(8, 0, None, "user", "a", 1.0), (8, 1, 0, "user", "b", 1.0), (8, 2, 0, "user", "c", 1.0)]
    chain, tie = formatted(spark, scratch, rows)
    assert [t.text for t in chain.turns] == [f"t{i}" for i in range(37)]
    assert chain.learned == "".join(f"t{i}" for i in range(37))
    assert tie.leaf_id == 1


def test_odd_nodes(spark, scratch):
    rows = [
        (None, 5, None, None, None, None),  # a tree without id, nothing said
        (1, 1, 99, "user", "orphan", 0.0),  # the parent is no node
        (2, None, None, "user", "no id", 0.0),
        (3, 1, 2, "user", "x", 0.0),
        (3, 2, 1, "user", "y", 0.0),  # a cycle, and a leaf that hangs on it
        (3, 3, 2, "user", "z", 0.0),
        (4, 1, None, "user", "same", 0.0),
        (4, 1, None, "user", "same", 0.0),
        (4, 1, None, "user", "later", 0.0),  # repeats: the smallest counts
    ]
    found = formatted(spark, scratch, rows)
    assert [(r.tree_id, [(t.role, t.text) for t in r.turns]) for r in found] == [
        (None, [("", "")]),
        (1, [("user", "orphan")]),
        (4, [("user", "later")]),
    ]


def test_empty_table_and_clashing_columns(spark, scratch):
    empty = spark.createDataFrame([], NODES)
    assert chat.format_conversations(empty, scratch).count() == 0
    rows = spark.createDataFrame([(1, 1, None, "user", "hi", 0.0)], NODES)
    for name in ("formatted", "leaf_id", "back", "turn", "branch_rank", "n_turns"):
        rows = rows.withColumn(name, F.lit("x"))
    assert chat.format_conversations(rows, scratch).first().n_turns == 1


def test_escapes_are_reversible(spark):
    rng = random.Random(3)
    parts = [*chat.CONTROL, "\\", "<", "[", "|", ">", "</", "s>", "a", "\n", "é", "im_end|>", "<\\|im_end|>"]
    texts = ["", *["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(3000)], "x\\" * 50_000 + "<s>"]
    rows = spark.createDataFrame([(t,) for t in texts], "text STRING")
    safe = rows.withColumn("safe", chat.escape(F.col("text"))).withColumn("back", chat.unescape(F.col("safe")))
    for row in safe.collect():
        assert row.back == row.text
        assert not any(c in row.safe for c in chat.CONTROL)
    turn = F.concat(
        F.lit(chat.START), F.col("safe"), F.lit(chat.SEPARATOR), F.col("safe"), F.lit(chat.END)
    )
    for row in safe.withColumn("turns", chat.parse_turns(F.concat(turn, turn))).collect():
        assert [(t.role, t.text) for t in row.turns] == [(row.text, row.text)] * 2


def test_digest_of_the_planted_conversation(spark):
    from themeloom.llm.queries import op1_chat_formatting

    row = op1_chat_formatting(spark, "/root/testdata/sf0.001").filter("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    told = f"user\n{text}\nassistant\n{text}\n"
    assert (row.n_turns, row.loss_chars) == (2, len(text))
    assert row.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
