import pytest
from pyspark.sql import functions as F

from themeloom.llm import licenses

MIT = licenses.TEMPLATES[0][1]


def scanned(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    return {r.doc_id: r for r in licenses.scan_licenses(docs, **options).collect()}


def test_phrases(spark):
    found = scanned(
        spark,
        [
            "The MIT  License, the mit-license\nand (MIT) LICENSES; mit license",
            "general public license apache license general public",
            None,
            "",
            " ,.;",
            "mit éa license MİT license mİt",
            "permit license mit licenses",
        ],
    )
    first = found[0]
    assert (first.n_words, first.n_base, first.first_word, first.last_word) == (11, 3, 1, 9)
    assert (first.base_labels, first.score) == ("mit", 1.0)
    assert (found[1].n_base, found[1].base_labels) == (2, "apache,gpl")
    for i in (2, 3, 4):
        assert found[i][1:] == (0, 0, None, None, "", "", 0.0)
    assert (found[5].n_words, found[5].n_base) == (6, 0)
    assert found[6].n_base == 0


def test_templates_anywhere_in_a_text(spark):
    words = MIT.split()
    partly = " ".join(w if i % 10 else "other" for i, w in enumerate(words))
    filler = "lorem ipsum dolor " * 4000
    found = scanned(spark, [MIT, partly, filler + MIT.upper() + filler, " ".join(words[: len(words) // 2]), filler])
    assert [found[i].labels for i in range(5)] == ["mit", "mit", "mit", "", ""]
    assert found[0].score == found[2].score == 1.0
    assert 0.8 <= found[1].score < 1
    assert found[3].score == 0.0


def test_join_finds_what_all_comparisons_find(spark):
    import random

    rng = random.Random(2)
    listed = licenses.template_words(licenses.TEMPLATES)
    pool = sorted({w for _, words in listed for w in words}) + [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(150):
        _, text = rng.choice(licenses.TEMPLATES)
        own = [w if rng.random() > 0.12 else rng.choice(pool) for w in text.lower().replace(",", " ").split()]
        lead = rng.choices(pool, k=rng.choice([0, 5, 100, 300]))
        texts.append(" ".join(lead + own))
    found = scanned(spark, texts)
    for i, text in enumerate(texts):
        words = [w for w in __import__("re").split(licenses.NOT_WORD, text) if w]
        best, labels = 0.0, set()
        for start in range(0, max(len(words) - licenses.STEP, 1), licenses.STEP):
            block = set(words[start : start + licenses.BLOCK])
            for label, own in listed:
                share = len(block & set(own)) / len(own)
                if share >= licenses.CONTAINMENT:
                    best = max(best, share)
                    labels.add(label)
        assert set(filter(None, found[i].labels.split(","))) >= labels
        if not found[i].n_base:
            assert (found[i].score, found[i].labels) == (best, ",".join(sorted(labels)))


def test_no_rows_clashes_and_wrong_arguments(spark):
    assert scanned(spark, []) == {}
    docs = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, "x")], "doc_id BIGINT, text STRING")
    for name in ("words", "labels", "places", "score", "found"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert sorted(r.n_base for r in licenses.scan_licenses(docs).collect()) == [0, 1, 1]
    assert licenses.scan_licenses(docs, templates=[]).count() == 3
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs, containment=0)
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs, templates=[("x", "w " * 100)])


def test_main_path_has_no_python(spark):
    docs = spark.createDataFrame([(1, "mit license")], "doc_id BIGINT, text STRING")
    plan = licenses.scan_licenses(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
