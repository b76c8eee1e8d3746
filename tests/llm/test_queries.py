"""Registered queries against DuckDB, or against plain Python where SQL can't say it."""

import collections
import hashlib
import inspect
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as registered
import corpus_pipeline
from themeloom.llm import registry

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")


def test_names():
    names = registry.queries()
    assert sorted(n.split("_")[0] for n in names) == sorted([*(f"op{i}" for i in range(1, 14)), "pipeline"])
    assert set(registry.oracle_sql()) <= set(names)
    assert set(names) <= set(registered.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, name):
    ours = registry.queries()[name](spark, DATA).toPandas()
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    theirs = duck.execute(registry.oracle_sql()[name]).fetch_df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    left, right = (
        t[columns].sort_values(columns).reset_index(drop=True).astype(object).where(lambda x: x.notna(), None)
        for t in (ours, theirs)
    )
    assert left.equals(right)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").collect()


@pytest.fixture(scope="module")
def ids(documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d.doc_id: library.encode(d.text or "", add_special_tokens=False).ids for d in documents}


def test_encoding(spark, documents, ids):
    found = {r.doc_id: r for r in registry.queries()["op5_bpe"](spark, DATA).collect()}
    for doc in documents:
        row = found[doc.doc_id]
        assert row.n_tokens == len(ids[doc.doc_id])
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids[doc.doc_id])).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((doc.text or "").encode()).hexdigest()


def check_packing(pieces, ids):
    by_doc = collections.defaultdict(list)
    by_sequence = collections.defaultdict(list)
    for row in pieces:
        by_doc[row.doc_id].append(row)
        by_sequence[row.sequence_id].append(row)
    for doc, told in ids.items():
        whole, at = np.array([*told, 0], "<u4"), 0
        for row in sorted(by_doc[doc], key=lambda r: r.start):
            assert row.start == at and row.doc_tokens == len(whole)
            assert row.ids_crc32 == zlib.crc32(whole[at : at + row.length].tobytes())
            at += row.length
        assert at == len(whole)
    for rows in by_sequence.values():
        at = 0
        for row in sorted(rows, key=lambda r: r.offset):
            assert row.offset == at
            at += row.length
        assert at <= 1024
    assert len(by_sequence) == -(-sum(len(x) + 1 for x in ids.values()) // 1024)


def test_packing(spark, ids):
    check_packing(registry.queries()["op3_packing"](spark, DATA).collect(), ids)


def test_languages_held_out(spark, documents):
    found = {r.doc_id: r for r in registry.queries()["op6_language_id"](spark, DATA).collect()}
    held = [d for d in documents if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert {d.doc_id for d in held} == {i for i, r in found.items() if r.held_out}
    assert sum(found[d.doc_id].lang_pred == d.lang for d in held) >= 0.98 * len(held)


def test_nearest(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    vectors = np.array([r.embedding for r in rows], float)
    names = np.array([r.vec_id for r in rows])
    found = registry.queries()["op8_ann"](spark, DATA).collect()
    hits = total = 0
    for i in np.flatnonzero(names % 20 == 0):
        scores = vectors @ vectors[i]
        others = np.flatnonzero(names != names[i])
        told = others[np.lexsort((names[others], -scores[others]))][:20]
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == names[i])
        assert [r[0] for r in own] == list(range(1, len(told) + 1))
        hits += len(set(names[told]) & {r[1] for r in own})
        total += len(told)
    assert hits >= 0.9 * total


def test_pipeline(spark, scratch, documents, monkeypatch):
    """Every stage against what plain Python or SQL makes of its own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        before = docs.collect()
        docs = scratch.keep(stage(spark, docs, DATA), name)
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "language_id":
            assert [r for r in after if not any(c.isalpha() for c in r.text or "")] == []
            assert len(after) >= 0.99 * sum(any(c.isalpha() for c in r.text or "") for r in before)
        elif name == "line_dedup":
            duck = duckdb.connect()
            duck.register("documents", spark.createDataFrame(before, docs.schema).toPandas())
            told = {r[0]: r[1] for r in duck.execute(registry.oracle_sql()["op7_line_dedup"]).fetchall()}
            texts = {r.doc_id: r.text for r in before}
            assert {r.doc_id: r.text for r in after} == {i: t for i, t in told.items() if t.strip(" ") or t == texts[i]}
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "ngram_join":
            duck = duckdb.connect()
            duck.register("documents", spark.createDataFrame(before, docs.schema).toPandas())
            told = duck.execute(registry.oracle_sql()["op4_ngram_join"]).fetch_df()
            assert {r.doc_id for r in after} == set(told.component_id)
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            own = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in before}
            from pyspark.sql import functions as F

            check_packing(docs.withColumn("ids_crc32", F.crc32("ids")).collect(), own)


def test_pipeline_on_odd_documents(spark, scratch):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    text = "the quick brown fox jumps over the lazy dog and runs away into the dark forest again"
    rows = [
        (1, text, "en", "s", len(text)), (1, text, "en", "s", len(text)), (2, text + " end", "en", "s", 0),
        (3, None, "en", "s", 0), (4, "", None, None, None), (5, "123 !", "en", "s", 5), (None, text + " x", None, "s", 1),
    ]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, DATA), name)
        if name == "ngram_join":
            assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 1]
    assert docs.groupBy("doc_id").count().count() == 2
    docs = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, DATA), f"none-{name}")
    assert docs.count() == 0


def test_pipeline_drops_copies_with_blank_lines(spark, scratch):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    parts = [
        "the quick brown fox jumps over the lazy dog and runs away into the dark forest",
        "an old man walked along the river until he came to the house of his brother",
        "nobody in the village had ever heard of the sea or of the ships that sail on it",
    ]
    apart = ["\n\n", "\n\t\n\n", "\n \r\n\u2003\n"]
    rows = [(3 * i + k, a.join(parts), "en", "s", len(a.join(parts))) for i, a in enumerate(apart) for k in range(3)]
    rows.append((100, "\n\n", "en", "s", 2))  # had nothing to lose
    docs = spark.createDataFrame(rows, schema)
    cut = corpus_pipeline.drop_lines(spark, docs, DATA)
    assert sorted(r.doc_id for r in cut.collect()) == [0, 100]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, DATA), f"blank-{name}")
    assert {r.doc_id for r in docs.collect()} == {0}
