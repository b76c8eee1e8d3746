"""From documents to packed training sequences: language identification, line
dedup, near-duplicate removal, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.llm import language, lines, ngram_join, packing
from themeloom.plans.scratch import Scratch

TOKENIZER = "byte_bpe_50k.json"
# Documents whose language is less certain than that are rejected.
LEAST_SCORE = 0.5

# Language models and digests of tokens cannot be written in SQL.
ORACLE_SQL = None


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a certain language; a missing ``lang`` becomes it."""
    model = language.fit_languages(docs)
    found = language.predict_languages(docs, model)
    kept = found.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines, and documents that have nothing else."""
    cut = lines.dedup_lines(docs, Scratch(spark))
    left = cut.filter((F.col("n_dropped") == 0) | F.rlike("text", F.lit(r"\P{IsWhite_Space}")))
    length = F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("bigint"))
    return left.withColumn("n_chars", length).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group of near duplicates,
    and one row of each doc_id; rows without doc_id stay."""
    scratch = Scratch(spark)
    found = ngram_join.ngram_components(docs, scratch)
    rows = found.groupBy("doc_id").agg(
        F.min("component_id").alias("component_id"), F.count("*").alias("rows")
    ).filter("doc_id <> component_id OR (rows > 1 AND doc_id IS NOT NULL)")
    rows = scratch.keep(rows.select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("stays")), "touched")
    bitmap = scratch.keep(lines.sieve(rows, "doc_id"), "touched-sieve")
    # Only documents that may go are shuffled.
    sifted = lines.sifted(docs, bitmap, "doc_id")
    near = sifted.filter("_maybe").join(rows, "doc_id", "left").filter("stays IS NULL OR stays")
    once = Window.partitionBy("doc_id").orderBy("text")
    one = near.filter("stays").withColumn("_row", F.row_number().over(once)).filter("_row = 1")
    kept = [sifted.filter("NOT _maybe"), near.filter("stays IS NULL"), one]
    first, second, third = (some.select(*docs.columns) for some in kept)
    return first.unionByName(second).unionByName(third)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; ``ids`` are little-endian unsigned 32-bit numbers."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), Scratch(spark))


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_duplicates),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents, each written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
