"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm import (
    ann, bpe, chat, collocations, divergence, language, licenses, lines, ngram_join, packing, suffixes, vector_dedup, warc,
)
from themeloom.plans.numbering import dense_index
from themeloom.plans.scratch import Scratch

# The tokenizer of the two queries that need one.
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is a tree of one branch: each turn replies to the one before."""
    scratch = Scratch(spark)
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sample = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(sample).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    turns = dense_index(said.unionByName(planted), order, "node_id", scratch, "turns")
    before = turns.select("conv_id", F.col("node_id").alias("parent_id"), (F.col("node_id") + 1).alias("node_id"))
    nodes = (
        turns.alias("a")
        .join(
            before.alias("b"),
            (F.col("a.node_id") == F.col("b.node_id")) & F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")),
            "left",
        )
        .select(
            F.col("a.conv_id").alias("tree_id"), "a.node_id", "b.parent_id", "a.role", "a.text",
            F.lit(0.0).alias("score"),
        )
    )
    talks = chat.format_conversations(nodes, scratch, top=1)
    read = talks.withColumn("turns", chat.parse_turns(F.col("formatted"))).withColumn(
        "learned", chat.learned_text(F.col("formatted"), F.col("loss_mask"))
    )
    line = F.lit("\n")
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line)), "")
    return read.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    path = f"{scratch.root}/archives"
    warc.write_archives(table(spark, sf_dir, "pages"), path, scratch)
    captures = warc.assemble(warc.read_records(spark, path, payloads=False))
    return captures.select(
        "metadata.page_id",
        "response.payload_bytes",
        "response.payload_digest",
        F.col("response.type").alias("record_type"),
        "response.refers_to",
    )


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, Scratch(spark))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language.held_out("doc_id"))
    model = language.fit_languages(docs.filter("NOT held_out"))
    found = language.predict_languages(docs.select("doc_id", "text", "held_out"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), Scratch(spark))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), Scratch(spark))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.filter("vec_id % 20 = 0"), Scratch(spark))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), Scratch(spark))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sizes = F.transform("spans", lambda s: s["high"] - s["low"])
    return suffixes.drop_repeats(docs, Scratch(spark)).select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"),
        F.aggregate(sizes, F.lit(0).cast("bigint"), lambda total, n: total + n).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"), Scratch(spark))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.mine_phrases(table(spark, sf_dir, "documents"), Scratch(spark))
    return found.drop("n_left", "n_right")
