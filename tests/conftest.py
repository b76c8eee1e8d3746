import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("themeloom-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def scratch(spark):
    from themeloom import Scratch

    return Scratch(spark)


def docs_frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")


@pytest.fixture(scope="session")
def tiny(spark):
    return docs_frame(spark, ["a b a", "b c", "c c c d"])


@pytest.fixture(scope="session")
def words_corpus(spark):
    """Forty documents over thirty words; document 7 holds a third of the
    tokens and word w0 another third."""
    import random

    rng = random.Random(5)
    texts = []
    for doc in range(40):
        length = 300 if doc == 7 else rng.randint(5, 25)
        texts.append(
            " ".join("w0" if rng.random() < 0.33 else f"w{rng.randint(1, 29)}" for _ in range(length))
        )
    return docs_frame(spark, texts)
