"""A trained model and the questions it answers."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.operators import counts, diagnostics, estimates, ranking, sampling
from themeloom.operators.buckets import document_vectors, no_vectors, term_vectors
from themeloom.operators.packed import cell_rows, document_topics, held_terms, term_topics, token_rows, with_topics
from themeloom.operators.state import expand_cells
from themeloom.plans.layout import Layout
from themeloom.plans.scratch import Scratch


class LdaModel:
    """Final state of a training run. Every method returns a DataFrame."""

    def __init__(
        self,
        *,
        spark: SparkSession,
        scratch: Scratch,
        layout: Layout,
        mode: str,
        k: int,
        alpha: float,
        eta: float,
        seed: int,
        iterations: int,
        vocab: DataFrame,
        vocab_size: int,
        stored: DataFrame,
        totals: list[int],
        history: list[tuple[int, float, int, float | None]],
        words: DataFrame | None = None,
        routes: DataFrame | None = None,
    ) -> None:
        self.spark = spark
        self.scratch = scratch
        self.layout = layout
        self.mode = mode
        self.k = k
        self.alpha = alpha
        self.eta = eta
        self.seed = seed
        self.iterations = iterations
        self.vocab = vocab
        self.vocab_size = vocab_size
        self.stored = stored
        self.totals = totals
        self.history = history
        self._words = words
        self._routes = routes

    # -- state and counts ------------------------------------------------------

    @property
    def state(self) -> DataFrame:
        """Topic of every token, (doc_id, pos, term_id, topic); in edge mode the
        counts of every cell, (doc_id, term_id, cnt, n)."""
        return self._rows().drop("bucket", "chunk")

    @cached_property
    def table(self) -> DataFrame:
        """``state`` with bucket and chunk, as a table bucketed by ``bucket``. Training stores
        documents with arrays, so this writes their tokens or cells as rows."""
        return self.scratch.keep_bucketed(self._rows(), "rows", self.layout.buckets, ["bucket"])

    def _rows(self) -> DataFrame:
        return cell_rows(self.stored, self.k) if self.mode == "edge" else token_rows(self.stored)

    @property
    def tokens(self) -> DataFrame:
        """(doc_id, pos, term_id, topic) of every token; in edge mode ``pos`` numbers
        the copies of a term in its document, by topic."""
        return expand_cells(self.state) if self.mode == "edge" else self.state

    @cached_property
    def words(self) -> DataFrame:
        """(term_id, n ARRAY): tokens of each term by topic."""
        if self._words is not None:
            return self._words
        return counts.topic_sums(term_topics(self.stored, self.k), ["term_id"], self.k)

    @cached_property
    def docs(self) -> DataFrame:
        """(doc_id, n ARRAY): tokens of each document by topic."""
        # A document is one row, unless it is split.
        by_row = document_topics(self.stored, self.k)
        return counts.add_vectors(by_row, ["doc_id"], self.k) if self.layout.split else by_row

    @cached_property
    def cells(self) -> DataFrame:
        """(doc_id, term_id, cnt, n ARRAY): tokens of each term in each document."""
        return self._placed_cells().select("doc_id", "term_id", "cnt", "n")

    def _placed_cells(self) -> DataFrame:
        """``cells`` with the keys of the layout."""
        keys = [*self.layout.doc_keys, "term_id"]
        if self.mode == "edge":
            return self._rows().select(*keys, "cnt", "n")
        return counts.topic_vector(self.table, keys, self.k).select(
            *keys, counts.vector_sum("n").alias("cnt"), "n"
        )

    def placed_rows(self, cells: bool = False) -> DataFrame:
        """Tokens, or ``cells``, with ``nd``, the topic counts of their document. They are
        counted where the rows lie, and only joined for corpora with split documents."""
        if self.mode == "edge":
            return cell_rows(self._documents(), self.k)
        rows = self._placed_cells() if cells else self.table
        if self.layout.split:
            return rows.join(self.docs.withColumnRenamed("n", "nd"), "doc_id")
        document = Window.partitionBy(*self.layout.doc_keys)
        if not cells:
            told = [F.count_if(F.col("topic") == topic) for topic in range(self.k)]
        else:
            told = [F.sum(F.get("n", F.lit(topic))) for topic in range(self.k)]
        known = rows.filter(F.col("doc_id").isNotNull())
        return known.withColumn("nd", F.array(*[n.over(document) for n in told]))

    def _documents(self) -> DataFrame:
        """Stored rows of known documents with ``nd``, the topic counts of the document."""
        known = self.stored.filter(F.col("doc_id").isNotNull())
        if self.layout.split:
            return known.join(self.docs.withColumnRenamed("n", "nd"), "doc_id")
        return with_topics(known, self.k)

    @cached_property
    def routes(self) -> DataFrame:
        """(term_id, bucket): the terms that each bucket holds."""
        if self._routes is not None:
            return self._routes
        return self.scratch.keep_pairs(held_terms(self.stored), "model_routes", "term_id")

    def vectors(self, terms: bool = True) -> DataFrame:
        """The count vectors that every bucket of the table needs."""
        sent = term_vectors(self.words, self.routes, self.k) if terms else no_vectors(self.stored)
        if not self.layout.split:
            return sent
        places = self.stored.groupBy("bucket", "doc_id").agg(F.lit(0).alias("_"))
        return sent.unionByName(document_vectors(self.docs, places.drop("_"), self.k))

    def edge_rows(self) -> DataFrame:
        """Cells with what the edge weight needs: n and factor."""
        factor = sampling.edge_factor("nd", self.totals, self.alpha, self.eta, self.vocab_size)
        if self.mode != "edge":
            return self.placed_rows(cells=True).select("doc_id", "term_id", "cnt", "n", factor.alias("factor"))
        # The factor is the same for all cells of a document.
        rows = cell_rows(self._documents().withColumn("factor", factor).drop("nd"), self.k)
        return rows.select("doc_id", "term_id", "cnt", "n", "factor")

    def word_topic_counts(self, grain: str = "term") -> DataFrame:
        keys = counts.grain_keys(grain)
        if grain == "doc_term" and self.mode == "edge":
            return token_rows(self.stored).select(*keys, "topic", F.col("cnt").alias("n"))
        vectors = self.words if grain == "term" else self.cells
        return counts.spread(vectors.select(*keys, "n")).filter("n > 0")

    def doc_topic_counts(self) -> DataFrame:
        return counts.spread(self.docs).filter("n > 0")

    def topic_totals(self) -> DataFrame:
        return counts.numbers(self.spark, self.totals)

    # -- estimates -------------------------------------------------------------

    def theta(self, all_docs: DataFrame | None = None) -> DataFrame:
        return estimates.theta(self.docs, self.k, self.alpha, all_docs)

    def phi(self, grain: str = "term") -> DataFrame:
        vectors = self.words if grain == "term" else self.cells
        return estimates.phi(vectors, self.totals, self.eta, self.vocab_size, self.vocab, grain)

    def topics_matrix(self) -> DataFrame:
        return estimates.topics_matrix(self.words, self.vocab, self.k)

    def topic_distributions(self, normalize: bool = False) -> DataFrame:
        return estimates.topic_distributions(self.docs, normalize)

    # -- rankings --------------------------------------------------------------

    def describe_topics(self, terms: int | None = None) -> DataFrame:
        return ranking.describe_topics(
            self.words, self.vocab, self.totals, self.eta, self.vocab_size, self.scratch, terms
        )

    def top_documents_per_topic(self, documents: int) -> DataFrame:
        return ranking.top_documents_per_topic(self.docs, documents, self.scratch)

    def top_topics_per_document(self, topics: int) -> DataFrame:
        return ranking.top_topics_per_document(self.docs, topics)

    def topic_assignments(self) -> DataFrame:
        """Most likely topic of each (document, term): (doc_id, term_id, topic)."""
        edge = self.mode == "edge"
        found = ranking.topic_assignments(
            self.stored, self.vectors(terms=not edge), self.totals, alpha=self.alpha, eta=self.eta,
            vocab_size=self.vocab_size,
        )
        # The tokens of a term in a split document may lie in several buckets.
        return found.distinct() if self.layout.split and not edge else found

    def assignment_arrays(self) -> DataFrame:
        return ranking.assignment_arrays(self.topic_assignments(), self.scratch)

    # -- diagnostics -----------------------------------------------------------

    def log_likelihood(self, smoothing: str = "mean", grain: str = "term") -> DataFrame:
        return self._likelihood(smoothing, grain).select("log_likelihood")

    def perplexity(
        self, smoothing: str = "mean", grain: str = "term", tokens: int | None = None
    ) -> DataFrame:
        return diagnostics.perplexity(self._likelihood(smoothing, grain), tokens)

    def log_prior(self, grain: str = "term") -> DataFrame:
        """At grain ``doc_term`` every term of a document is a topic entry of its own."""
        counts.grain_keys(grain)
        dense = estimates.dense_words(self.words, self.vocab, self.k)
        return diagnostics.log_prior(
            dense if grain == "term" else self.cells,
            self.docs,
            self.totals,
            alpha=self.alpha,
            eta=self.eta,
            vocab_size=self.vocab_size,
        )

    def _likelihood(self, smoothing: str, grain: str) -> DataFrame:
        if grain == "term":
            return diagnostics.bucket_likelihood(
                self.stored, self.vectors(), self.totals, alpha=self.alpha, eta=self.eta,
                vocab_size=self.vocab_size, smoothing=smoothing,
            )
        return diagnostics.log_likelihood(
            self.placed_rows(cells=True),
            self.words,
            None,
            self.totals,
            alpha=self.alpha,
            eta=self.eta,
            vocab_size=self.vocab_size,
            smoothing=smoothing,
            grain=grain,
        )

    def iteration_metrics(self) -> DataFrame:
        """One row per sweep: (iteration, seconds, tokens_changed, log_likelihood).

        In edge mode the tokens of a cell have no names, and those count as changed by
        which its counts differ. The likelihood is that of the state before the sweep,
        and NULL unless the training was asked for it.
        """
        return self.spark.createDataFrame(
            self.history,
            "iteration INT, seconds DOUBLE, tokens_changed BIGINT, log_likelihood DOUBLE",
        )

    def release(self) -> None:
        """Delete the tables of the run; the model cannot be used afterwards."""
        self.scratch.release()
