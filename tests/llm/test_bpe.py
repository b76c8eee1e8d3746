import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from themeloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocab():
    return bpe.read_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(1)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    alphabets = [
        every, list(" \n\t'    abrstvedlm1!"), list("aaab "), list("'stvrelmd "),
        ["<|endoftext|>", " ", "a", "\n", "'s", "<|", "|>"], [chr(c) for c in range(0x250)],
    ]
    texts = [
        "".join(rng.choices(rng.choice(alphabets), k=rng.choice([1, 3, 10, 60]))) for _ in range(2000)
    ]
    return texts + ["", "x" * 5000 + "ab" * 3000, " " * 3000 + "a", "\n" * 999, "".join(rng.choices("abcdefghij", k=50_000))]


def test_every_text_is_encoded_as_by_the_library(vocab, library):
    texts = odd_texts()
    found = bpe.id_lists(bpe.Encoder(vocab), [*texts, None]).to_pylist()
    told = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert found == [*told, []]
    for ids, text in zip(told, texts, strict=True):
        assert bpe.token_bytes(np.array(ids, np.int64), vocab).tobytes().decode() == text
        assert library.decode(ids, skip_special_tokens=False) == text


def test_pieces_and_a_full_cache_change_nothing(vocab, monkeypatch):
    texts = [" ".join(odd_texts()[:300]), *odd_texts()[:50]]
    whole = bpe.id_lists(bpe.Encoder(vocab), texts)
    monkeypatch.setattr(bpe, "PIECE", 20)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 10)
    assert bpe.id_lists(bpe.Encoder(vocab), texts) == whole


def test_columns_of_a_table(spark, library):
    rows = [(1, "Hello  world's"), (1, "Hello  world's"), (2, None), (None, ""), (3, "<|endoftext|>ß")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("ids", F.lit("clash"))
    both = bpe.decode_ids(bpe.encode_texts(docs, PATH).withColumn("decoded", F.lit(1)), PATH).collect()
    for row in both:
        assert row.ids == library.encode(row.text or "", add_special_tokens=False).ids
        assert row.decoded == (row.text or "")
    assert bpe.encode_texts(docs.limit(0), PATH).count() == 0
    assert bpe.digest_texts(docs.limit(0), PATH).count() == 0


def test_ids_that_are_no_text(spark, vocab, library):
    ids = [vocab.byte_ids[b] for b in b"a\xe2\x82b\xff"]
    rows = spark.createDataFrame([([int(i) for i in ids],), (None,), ([],)], "ids ARRAY<INT>")
    assert [r.decoded for r in bpe.decode_ids(rows, PATH).collect()] == [library.decode(ids), None, ""]
    with pytest.raises(ValueError):
        bpe.token_bytes(np.array([10**6]), vocab)


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_words_are_merged_once(monkeypatch):
    vocab, merged = bpe.read_vocabulary(PATH), []
    merge = bpe.merge_words
    monkeypatch.setattr(bpe, "merge_words", lambda words, vocab: merged.append(len(words)) or merge(words, vocab))
    encoder = bpe.Encoder(vocab)
    texts = [" ".join(f"a{i}" for i in range(start, start + 50_000)) for start in range(0, 250_000, 50_000)]
    once = [bpe.id_lists(encoder, [text]).to_pylist() for text in texts]
    known = sum(merged)
    assert [bpe.id_lists(encoder, [text]).to_pylist() for text in texts] == once
    assert sum(merged) == known
