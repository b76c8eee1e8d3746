import random

import numpy as np
from pyspark.sql import functions as F

from themeloom.llm import language

DOCS = "doc_id BIGINT, text STRING, lang STRING"
WORDS = {"xx": ["ala", "bobo", "kiki", "maru"], "yy": ["strengths", "twelfth", "glimpsed", "scrunch"], "zz": ["été", "naïve", "garçon"]}


def corpus(spark, n=60):
    rng = random.Random(0)
    rows = []
    for i in range(n):
        lang = ("xx", "yy", "zz")[i % 3]
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=20)), lang))
    return spark.createDataFrame(rows, DOCS)


def test_counts_are_those_of_plain_python(spark):
    docs = spark.createDataFrame([(1, "Ab, ab!", "xx"), (2, None, "xx"), (3, "a", None), (4, "é", "yy")], DOCS)
    counted = {(r.lang, r.bucket): r.n for r in language.count_languages(docs).collect()}
    assert counted["xx", -1] == counted["yy", -1] == 1
    held = " ab  ab   "  # lower case, others as spaces, one before and two after
    assert sum(n for (lang, bucket), n in counted.items() if lang == "xx" and bucket >= 0) == 2 * (len(held) - 2)
    starts, codes = language.flat([held])
    pairs, triples = language.ngrams(starts, codes)
    expected: dict[int, int] = {}
    for bucket in [*pairs, *triples]:
        if bucket < language.BUCKETS:
            expected[int(bucket)] = expected.get(int(bucket), 0) + 1
    assert {b: n for (lang, b), n in counted.items() if lang == "xx" and b >= 0} == expected


def test_scores_are_those_of_plain_python(spark):
    model = language.fit_languages(corpus(spark))
    texts = ["ala bobo", "twelfth ÉTÉ", "q"]
    names, scores = language.score_texts(model, texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        held = f" {text.lower()}  "
        logs = model.priors.copy()
        starts, codes = language.flat([held])
        for buckets in language.ngrams(starts, codes):
            for bucket in buckets[: len(held) - 2]:
                logs = logs + model.weights[bucket]
        odds = np.exp(logs - logs.max())
        assert name == model.languages[int(logs.argmax())]
        assert abs(score - odds.max() / odds.sum()) < 1e-9


def test_held_out_accuracy(spark):
    docs = corpus(spark, 200).select("*", language.held_out("doc_id"))
    model = language.fit_languages(docs.filter("NOT held_out"))
    found = language.predict_languages(docs.filter("held_out"), model)
    assert found.count() > 20 and found.filter("lang <> lang_pred").count() == 0


def test_long_texts_are_read_whole(spark, monkeypatch):
    model = language.fit_languages(corpus(spark))
    text = " ".join(WORDS["xx"] * 50 + WORDS["yy"] * 60)
    whole = language.score_texts(model, [text, None, "ala", text])
    monkeypatch.setattr(language, "PIECE", 16)
    parts = language.score_texts(model, [text, None, "ala", text])
    assert parts[0] == whole[0] and abs(parts[1] - whole[1]).max() < 1e-9


def test_odd_rows(spark):
    model = language.fit_languages(corpus(spark))
    rows = [(1, None, "xx"), (2, "", None), (3, "12 34 !?", "yy"), (None, "bobo", None), (None, "bobo", None), (4, "x" * 600_000, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(1))
    found = language.predict_languages(docs, model).collect()
    assert [r.lang_pred for r in found[:5]] == ["und", "und", "und", "xx", "xx"]
    assert [r.score for r in found[:3]] == [0.0] * 3 and found[3][1:] == found[4][1:]
    assert all(0 <= r.score <= 1 for r in found)
    assert language.predict_languages(docs.limit(0), model).count() == 0


def test_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, None, "xx")], DOCS)
    model = language.fit_languages(docs)
    assert model.languages == []
    assert {(r.lang_pred, r.score) for r in language.predict_languages(docs, model).collect()} == {("und", 0.0)}
