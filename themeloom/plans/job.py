"""The whole job on a directory of text files: read, train, report, write."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession

from themeloom.plans.corpus import Corpus, prepare_corpus, prepare_lines
from themeloom.plans.model import LdaModel
from themeloom.plans.scratch import Scratch
from themeloom.plans.training import LDA
from themeloom.sources.text import assign_doc_ids, read_corpus, whole_files


def train_directory(
    spark: SparkSession,
    directory: str,
    lda: LDA,
    token_lines: bool = False,
    seconds: dict[str, float] | None = None,
) -> tuple[Corpus, LdaModel]:
    """Train on every file of a directory; documents are numbered by path.

    ``token_lines`` reads one token per line, as it stands, instead of free text.
    ``seconds`` gets the times that preprocessing and training took.
    """
    started = time.monotonic()
    scratch = Scratch(spark)
    paths = f"{directory.rstrip('/')}/*"
    files = whole_files(spark, paths) if token_lines else read_corpus(spark, paths)
    # Only the names are sorted and stored; the texts come by a join.
    numbered = assign_doc_ids(files.select("path"), ["path"], scratch)
    docs = files.join(numbered, "path").select("doc_id", "text")
    corpus = prepare_lines(docs, scratch) if token_lines else prepare_corpus(docs, scratch)
    prepared = time.monotonic()
    model = lda.fit_packed(corpus.packed, corpus.vocab)
    if seconds is not None:
        seconds |= {"preprocessing": prepared - started, "training": time.monotonic() - prepared}
    return corpus, model
