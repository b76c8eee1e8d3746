from pyspark.ml.feature import RegexTokenizer
from pyspark.sql import functions as F

from conftest import docs_frame
from themeloom.operators import vocabulary
from themeloom.sources import text


def terms(rows):
    return [(r.doc_id, r.pos, r.term) for r in rows.orderBy("doc_id", "pos").collect()]


def test_blank_documents_are_trimmed_and_have_no_tokens(spark):
    docs = text.corpus_from_table(docs_frame(spark, ["", "  \t\n", " x ", "\x00\x1f y "]))
    assert [r.text for r in docs.orderBy("doc_id").collect()] == ["", "", "x", "y "]
    assert terms(vocabulary.tokenize(docs)) == [(2, 0, "x"), (3, 0, "y ")]


def test_tokenizer_agrees_with_the_ml_one(spark):
    docs = docs_frame(spark, ["The Cat\x0b sat  on\r\nTHE mat", " lead", "Été İx a b", "x"])
    for options in (
        {},
        {"min_token_length": 2},
        {"to_lowercase": False},
        {"pattern": "[a-z]+", "gaps": False},
    ):
        ml = RegexTokenizer(
            inputCol="text",
            outputCol="words",
            pattern=options.get("pattern", r"\s+"),
            gaps=options.get("gaps", True),
            minTokenLength=options.get("min_token_length", 1),
            toLowercase=options.get("to_lowercase", True),
        )
        expected = ml.transform(docs).select("doc_id", "words").collect()
        got = vocabulary.document_words(docs, **options).collect()
        assert sorted(got) == sorted(expected), options


def test_short_tokens_are_measured_in_utf16(spark):
    docs = docs_frame(spark, ["\U0001f600 a"])
    assert terms(vocabulary.tokenize(docs, min_token_length=2)) == [(0, 0, "\U0001f600")]


def test_token_lines(spark):
    docs = docs_frame(spark, ["a\n\nb\n\n", "", "\n", "\nc\r\nD "])
    assert terms(text.read_token_lines(docs)) == [
        (0, 0, "a"),
        (0, 1, ""),
        (0, 2, "b"),
        (1, 0, ""),
        (3, 0, ""),
        (3, 1, "c\r"),
        (3, 2, "D "),
    ]


def test_files(spark, scratch, tmp_path):
    for name, content in (("b", " two\nlines "), ("a", "one\n"), ("c", "")):
        (tmp_path / name).write_text(content)
    docs = text.assign_doc_ids(text.read_corpus(spark, f"{tmp_path}/*"), ["path"], scratch)
    rows = docs.orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in rows] == [(0, "one"), (1, "two\nlines"), (2, "")]
    raw = text.assign_doc_ids(text.whole_files(spark, f"{tmp_path}/*"), ["path"], scratch)
    assert terms(text.read_token_lines(raw)) == [
        (0, 0, "one"), (1, 0, " two"), (1, 1, "lines "), (2, 0, "")
    ]


def test_tokenising_splits_each_text_once(spark):
    docs = docs_frame(spark, ["a b"])
    plan = vocabulary.tokenize(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_bag_from_counts_truncates_and_drops(spark):
    rows = [(0, 0, 2.7), (0, 1, 0.4), (0, 2, 0.0), (0, 3, -1.0), (1, 0, 0.6), (1, 0, 0.6)]
    counts = spark.createDataFrame(rows, "d INT, t INT, c DOUBLE")
    bag = text.bag_from_counts(counts, "d", "t", "c")
    assert sorted(map(tuple, bag.collect())) == [(0, 0, 2), (1, 0, 1)]
    single = text.bag_from_counts(counts.filter("d = 0"), "d", "t", "c", grouped=True)
    assert single.collect() == [(0, 0, 2)]
    assert bag.schema["cnt"].dataType.simpleString() == "bigint"


def test_missing_columns_are_named(spark, tiny):
    import pytest

    with pytest.raises(ValueError, match="body"):
        text.corpus_from_table(tiny, text="body")
    assert tiny.select(F.count("*")).first()[0] == 3


def test_files_are_listed_folder_by_folder(spark, tmp_path):
    import inspect

    from themeloom.sources import listing

    names = ["a/x.txt", "a/y.log", "a/_hidden", "a/.dot", "b/x.txt", "b/deep/x.txt", "c/empty é.txt", "top.txt"]
    for i, name in enumerate(names):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if i % 2 else f"text {i}")

    def listed(*patterns):
        rows = listing.list_files(spark, [f"{tmp_path}/{p}" for p in patterns]).collect()
        return sorted(r.path.removeprefix(f"{tmp_path}/") for r in rows)

    assert listed("*/x.txt") == ["a/x.txt", "b/x.txt"]
    assert listed("a", "top.txt", "missing") == ["a/x.txt", "a/y.log", "top.txt"]
    assert listed("{b,c}/*") == ["b/deep/x.txt", "b/x.txt", "c/empty é.txt"]
    assert listed("[a-b]/?.*") == ["a/x.txt", "a/y.log", "b/x.txt"]
    for patterns in (["*/*.txt"], ["{b,c}/*"], ["a"], ["top.txt"]):
        paths = [f"{tmp_path}/{p}" for p in patterns]
        found = {r.path: r.text for r in text.whole_files(spark, paths).collect()}
        assert sorted(found) == sorted(listing.file_uri(r.path) for r in listing.list_files(spark, paths).collect())
        assert {t for t in found.values()} <= {"", *(f"text {i}" for i in range(8))}
    assert text.whole_files(spark, f"{tmp_path}/a/y.log").count() == 1
    assert text.whole_files(spark, f"{tmp_path}/a/y.log", empty=False).count() == 0
    for module in (text, listing):
        assert "_jvm" not in inspect.getsource(module)
