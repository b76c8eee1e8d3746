import os
import pathlib

import duckdb
import pytest

import __spark_entry__ as registered
from themeloom import LDA
from themeloom.__main__ import main
from themeloom.plans.job import train_directory
from themeloom.plans.scratch import shared_folder

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    texts = {"a": "x y x\n", "b": "y z\nz", "c": "", "d": " \n"}
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / name).write_text(text)
    return tmp_path


def test_directory_of_texts(spark, folder):
    corpus, model = train_directory(spark, f"{folder}/in/", LDA(k=2, iterations=2, seed=1))
    assert corpus.summary().first() == (4, 3, 6)
    assert {r.doc_id for r in model.theta().collect()} == {0, 1}
    assert model.theta(corpus.docs).count() == 8


def test_directory_of_token_lines(spark, folder):
    lda = LDA(k=2, iterations=1, alpha=0.3, beta=0.5, seed=1)
    corpus, _ = train_directory(spark, f"{folder}/in", lda, token_lines=True)
    terms = {r.term for r in corpus.vocab.collect()}
    assert terms == {"x y x", "y z", "z", "", " "}


def test_command_line(spark, folder, capsys):
    out = folder / "out"
    done = main(
        f"-d {folder}/in -o {out} -m tri -a 0.3 -b 0.5 -K 2 -n 2 -t 2 -wm words --seed 3".split()
    )
    assert done == 0
    assert sorted(os.listdir(out)) == [
        "tri.others", "tri.phi", "tri.tassign", "tri.theta", "tri.twords", "words"
    ]
    told = capsys.readouterr().out
    for word in ("perplexity", "preprocessing: ", "training: "):
        assert word in told


def test_command_line_checks(capsys):
    for args in ("", "-d x -a 1 -b 1 -K 2", "-a 1 -b 1 -K 2 -n 1", "-d x -a -1 -b 1 -K 2 -n 1"):
        assert main(args.split()) == 2
        assert "usage" in capsys.readouterr().out


def test_shared_folder_is_the_one_of_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_no_local_checkpoint_or_cross_join_in_the_library():
    root = pathlib.Path(registered.__file__).parent / "themeloom"
    for path in root.rglob("*.py"):
        text = path.read_text()
        for forbidden in ("localCheckpoint", "crossJoin", ".toPandas", "collect()"):
            assert forbidden not in text, (path, forbidden)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")
@pytest.mark.parametrize(
    "name",
    [
        "tokenize", "fit_vocabulary", "bag_from_counts", "topic_weights", "fit_lda", "fit_lda_edge", "log_sum_exp",
        "decode_terms", "gibbs_sweep_k24", "edge_sweep_k24", "iteration_metrics_edge", "topic_shares_edge",
        "topic_assignments_edge", "log_prior_doc_term", "perplexity", "tassign_file", "phi_file",
    ],
)
def test_registered_queries_against_duckdb(spark, name):
    ours = registered.queries()[name](spark, DATA).toPandas()
    duck = duckdb.connect()
    for table in ("documents", "lineitem", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    theirs = duck.execute(registered.oracle_sql()[name]).fetch_df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    left = ours[columns].sort_values(columns).reset_index(drop=True)
    right = theirs[columns].sort_values(columns).reset_index(drop=True)
    assert left.equals(right)


def test_every_query_has_an_oracle():
    assert set(registered.model_queries()) <= set(registered.oracle_sql())
    assert set(registered.oracle_sql()) <= set(registered.queries())
