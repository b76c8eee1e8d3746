from pyspark.sql import functions as F

from themeloom.llm import lines

DOCS = "doc_id BIGINT, text STRING"
BANNER = "Copyright notice all rights are reserved by the owner"


def cut(spark, scratch, rows, **options):
    docs = spark.createDataFrame(rows, DOCS)
    return sorted(
        [tuple(r) for r in lines.dedup_lines(docs, scratch, **options).collect()],
        key=lambda r: (r[0] is not None, r[0], r[1] or ""),
    )


def test_recurring_lines_stay_once(spark, scratch):
    rows = [(1, f"one\n{BANNER}\nuno"), (2, f"{BANNER}\ntwo"), (3, f"  {BANNER.replace(' ', chr(9))} \nthree\n")]
    assert cut(spark, scratch, rows) == [
        (1, f"one\n{BANNER}\nuno", 3, 0),
        (2, "two", 2, 1),
        (3, "three\n", 3, 1),
    ]


def test_fields_with_digits_and_without(spark, scratch):
    rows = [
        (1, "Posted on 12-05 by admin in news today"),
        (2, "Posted on 2024 by admin in news today"),
        (3, "Visit us at the shop of anna for more offers this week"),
        (4, "Visit us at the shop of berta for more offers this week"),
        (5, "Visit us at home where nobody ever buys anything else at all"),
    ]
    assert [r[3] for r in cut(spark, scratch, rows)] == [0, 1, 0, 1, 0]


def test_repeats_in_one_document_and_short_lines_stay(spark, scratch):
    rows = [(1, f"{BANNER}\n{BANNER}"), (2, "see you soon"), (3, "see you soon"), (4, "1 2 3 4 5"), (5, "1 2 3 4 5")]
    assert [r[3] for r in cut(spark, scratch, rows)] == [0, 0, 0, 0, 0]


def test_odd_rows(spark, scratch):
    rows = [(None, None), (None, BANNER), (1, ""), (2, BANNER), (2, BANNER), (3, BANNER + "\nx"), (3, BANNER + "\ny"), (4, None)]
    assert cut(spark, scratch, rows) == [
        (None, None, 0, 0),
        (None, BANNER, 1, 0),  # the first, as null sorts first
        (1, "", 1, 0),
        (2, "", 1, 1),
        (2, "", 1, 1),
        (3, "x", 2, 1),
        (3, "y", 2, 1),
        (4, None, 0, 0),
    ]


def test_more_documents_are_asked_for(spark, scratch):
    rows = [(i, f"{BANNER}\n{i}") for i in range(3)]
    assert [r[3] for r in cut(spark, scratch, rows, min_docs=3)] == [0, 1, 1]
    assert [r[3] for r in cut(spark, scratch, rows, min_docs=4)] == [0, 0, 0]


def test_long_texts_and_a_hot_line(spark, scratch):
    long = "\n".join(f"line {'w' * (i % 7)} number {chr(97 + i % 26)} {'q' * (i // 26)} end" for i in range(5000))
    rows = [(0, long + "\n" + "z" * 200_000), (1, long)] + [(i, f"{BANNER}\nown words of {i}") for i in range(2, 200)]
    found = cut(spark, scratch, rows)
    assert found[0][3] == 0 and found[1][1] == "" and found[1][3] == 5000
    assert [r[3] for r in found[2:]] == [0] + [1] * 197


def test_empty_table_and_clashing_columns(spark, scratch):
    assert cut(spark, scratch, []) == []
    docs = spark.createDataFrame([(1, f"{BANNER}\na"), (2, BANNER)], DOCS)
    for name in ("doc", "row", "gone", "lines", "n_lines", "n_dropped", "_word", "_maybe", "leaf"):
        docs = docs.withColumn(name, F.lit("clash"))
    found = {r.doc_id: r for r in lines.dedup_lines(docs, scratch).collect()}
    assert found[2].text == "" and found[2].n_dropped == 1 and found[1].gone == found[2].lines == "clash"


def test_main_path_has_no_python(spark, scratch):
    docs = spark.createDataFrame([(1, BANNER), (2, BANNER)], DOCS)
    plan = lines.dedup_lines(docs, scratch)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
