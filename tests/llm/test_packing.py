import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from themeloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def packed(spark, scratch, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    return packing.pack_documents(docs, PATH, scratch, **options).toPandas()


def check(pieces, texts, window):
    library = Tokenizer.from_file(PATH)
    for doc, text in enumerate(texts):
        told = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        own = pieces[pieces.doc_id == doc].sort_values("start")
        held = [i for ids in own.ids for i in np.frombuffer(ids, "<u4").tolist()]
        assert held == told
        assert (own.doc_tokens == len(told)).all()
        assert own.start.tolist() == [0, *own.length.cumsum()[:-1]]
    for _, sequence in pieces.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == [0, *sequence.length.cumsum()[:-1]]
    fill = pieces.groupby("sequence_id").length.sum()
    assert fill.max() <= window and (fill < window).sum() <= 1
    return fill


def test_texts_of_all_lengths(spark, scratch):
    rng = np.random.default_rng(3)
    texts = [" ".join(["word"] * int(n)) for n in rng.integers(0, 90, 300)] + [None, "", "word " * 3000, "w" * 20_000]
    check(packed(spark, scratch, texts, window=64), texts, 64)


def test_one_length_in_a_third_of_the_rows(spark, scratch):
    texts = ["word " * 40] * 100 + ["a b c"] * 100 + [f"x{i}" * (i % 30) for i in range(100)]
    check(packed(spark, scratch, texts, window=64), texts, 64)


def test_plans_use_every_document_once():
    rng = np.random.default_rng(1)
    for histogram in (rng.integers(0, 50, 256), np.eye(1, 256, 200, dtype=int)[0] * 1000, np.zeros(256, int)):
        histogram[0] = 0
        plan = packing.make_plan(histogram, 5, 256)
        fill: dict[int, list] = {}
        for n in range(1, 256):
            for rank in range(histogram[n]):
                for _, length, sequence, offset in packing.pieces_of(plan, n, rank, 0, 256):
                    fill.setdefault(sequence, []).append((offset, length))
        total = int((histogram * np.arange(256)).sum())
        assert sorted(fill) == list(range(5, 5 + -(-total // 256)))
        for parts in fill.values():
            ends = 0
            for offset, length in sorted(parts):
                assert offset == ends
                ends += length
            assert ends <= 256


def test_solver_matches_a_histogram_that_combinations_can_fill():
    lengths = np.array([10, 20, 30, 50, 70, 80, 90])
    combos = packing.combinations(lengths, 100)
    assert sorted(map(tuple, combos.tolist())) == [
        (0, 10, 90), (0, 20, 80), (0, 30, 70), (0, 50, 50), (10, 10, 80), (10, 20, 70), (20, 30, 50)
    ]
    histogram = np.zeros(101)
    for combo, times in zip(combos, (5, 0, 7, 3, 0, 2, 9), strict=True):
        for n in combo:
            histogram[n] += times * (n > 0)
    solved = packing.solve_repeats(combos, histogram)
    used = sum(np.bincount(combos[:, j], solved, 101) for j in range(3))
    assert abs(used - histogram)[1:].max() < 0.01 and (solved >= 0).all()


def test_repeated_rows_missing_ids_clashes_and_no_rows(spark, scratch):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id BIGINT, text STRING")
    for name in ("part", "rest", "n", "ids", "start", "first_rank"):
        docs = docs.withColumn(name, F.lit("clash"))
    pieces = packing.pack_documents(docs, PATH, scratch, window=16).collect()
    assert sorted((r.doc_id or 0, r.length) for r in pieces) == [(0, 2), (1, 3), (1, 3)]
    assert sorted(r.offset for r in pieces)[0] == 0 and len({r.offset for r in pieces}) == 3
    assert packing.pack_documents(docs.limit(0), PATH, scratch).count() == 0


@pytest.mark.parametrize("end_id", [0, 50256])
def test_the_id_after_a_document(spark, scratch, end_id):
    row = packed(spark, scratch, ["a"], end_id=end_id).iloc[0]
    assert np.frombuffer(row.ids, "<u4").tolist() == [64, end_id]


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    from themeloom.llm.batches import parts

    texts = ["x" * n for n in (5, 0, 4000, 10, 10, 10, 9000, 1) * 50]
    batch = pa.record_batch({"text": pa.array(texts)})
    for size in (1, 3000, 20_000, 10**9):
        found = list(parts([batch, batch.slice(0, 0)], size=size))
        assert [t for b in found for t in b.column(0).to_pylist()] == texts
        assert all(b.num_rows == 1 or b.nbytes <= 2 * size for b in found)
    assert [b.num_rows for b in parts([batch], rows=300)] == [300, 100]
