"""The training job: initial state, sweeps, final model."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from themeloom.operators.buckets import document_vectors, no_vectors, term_vectors
from themeloom.operators.counts import add_vectors, topic_sums
from themeloom.operators.packed import (
    document_topics,
    held_terms,
    one_by_one,
    pack,
    packed_cells,
    packed_lengths,
    term_topics,
)
from themeloom.operators.sampling import edge_sweep, gibbs_sweep
from themeloom.operators.state import BLOCK, expand_bag, init_cells, init_packed, init_packed_cells
from themeloom.plans.layout import SPLIT_TOKENS, TOKEN_BYTES, Layout, place, place_packed, plan_layout
from themeloom.plans.model import LdaModel
from themeloom.plans.scratch import Scratch

MODES = ("collapsed", "edge")

# Defaults of the trainer; -1 or 0 asks for the automatic prior.
DEFAULT_TOPICS = 10
DEFAULT_ITERATIONS = 20
DEFAULT_CHECKPOINT_INTERVAL = 10
AUTO_ALPHA_MASS = 50.0
AUTO_ETA = 1.1

# Generations of the state that exist at a time: the one read, the one
# written, and one in reserve.
GENERATIONS = 3


class LDA:
    """Latent Dirichlet allocation by synchronous Gibbs sweeps.

    ``collapsed`` draws each token without its own count, from counts of the
    term over all documents. ``edge`` draws all tokens of a (document, term)
    cell from the counts of that cell, and needs alpha and eta above 1.

    Every sweep reads one generation of the state and writes the next to the
    shared folder, so plans stay small and a lost executor costs a re-read.
    Every ``checkpoint_interval``-th generation is kept until the next one of
    its kind; -1 keeps none. The counts by term of the last generation are kept
    with it, as ``state<n>-words``, and so is the table ``routes`` of the terms of
    each bucket; of earlier generations no counts stay.

    With ``likelihood`` every sweep also reports the log likelihood of the state it
    starts from.
    """

    def __init__(
        self,
        k: int = DEFAULT_TOPICS,
        iterations: int = DEFAULT_ITERATIONS,
        alpha: float | Sequence[float] = -1.0,
        beta: float = -1.0,
        seed: int | None = None,
        checkpoint_interval: int = DEFAULT_CHECKPOINT_INTERVAL,
        keep_last_checkpoint: bool = True,
        mode: str = "collapsed",
        bucket_tokens: int | None = None,
        split_tokens: int = SPLIT_TOKENS,
        likelihood: bool = False,
    ) -> None:
        if k <= 0:
            raise ValueError(f"the number of topics must be positive, not {k}")
        if iterations < 0:
            raise ValueError(f"the number of iterations must not be negative, not {iterations}")
        if checkpoint_interval != -1 and checkpoint_interval <= 0:
            raise ValueError(
                f"the checkpoint interval must be -1 or positive, not {checkpoint_interval}"
            )
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
        alpha = symmetric(alpha, k)
        self.k = k
        self.iterations = iterations
        self.alpha = alpha if alpha > 0 else AUTO_ALPHA_MASS / k
        self.eta = float(beta) if beta > 0 else AUTO_ETA
        if mode == "edge" and (self.alpha <= 1 or self.eta <= 1):
            raise ValueError("edge mode needs alpha > 1 and beta > 1")
        self.seed = random.getrandbits(62) if seed is None else seed
        self.checkpoint_interval = checkpoint_interval
        self.keep_last_checkpoint = keep_last_checkpoint
        self.mode = mode
        self.bucket_tokens = bucket_tokens
        self.split_tokens = split_tokens
        self.likelihood = likelihood

    def fit(self, tokens: DataFrame, vocab: DataFrame, vocab_size: int | None = None) -> LdaModel:
        """Train on encoded tokens (doc_id, pos, term_id).

        ``tokens`` is read twice; pass a stored table rather than a long plan.
        ``vocab_size`` saves counting ``vocab``, and must be its number of terms.
        """
        return self.fit_packed(one_by_one(tokens), vocab, vocab_size)

    def fit_packed(self, packed: DataFrame, vocab: DataFrame, vocab_size: int | None = None) -> LdaModel:
        """Train on tokens in arrays, (doc_id, pos, term_id), as a corpus holds them."""
        run = _Run(self, packed.sparkSession, vocab, vocab_size)
        lengths = packed_lengths(packed)
        layout = self._layout(run, lengths)
        if self.mode == "edge":
            placed = place_packed(packed_cells(packed), lengths, layout, ["term_id"])
            return self._edge(run, layout, init_packed_cells(placed, self.k, self.seed))
        return self._collapsed(run, layout, place_packed(packed, lengths, layout, ["pos", "term_id"]))

    def fit_bag(self, bag: DataFrame, vocab: DataFrame, vocab_size: int | None = None) -> LdaModel:
        """Train on term counts (doc_id, term_id, cnt)."""
        run = _Run(self, bag.sparkSession, vocab, vocab_size)
        bag = run.scratch.keep(bag, "bag")
        lengths = bag.groupBy("doc_id").agg(F.sum("cnt").alias("n"))
        layout = self._layout(run, lengths)
        largest = int(bag.agg(F.coalesce(F.max("cnt"), F.lit(0))).first()[0])
        if self.mode == "edge":
            first = init_cells(place(bag, lengths, layout, ["term_id"]), self.k, self.seed, largest)
            if largest > BLOCK:
                # Counts of huge cells come from all over.
                first = first.repartition(layout.buckets, "bucket")
            return self._edge(run, layout, pack(first))
        # A cell of a long document may itself be long: cut first, then place.
        tokens = one_by_one(expand_bag(bag, largest))
        return self._collapsed(run, layout, place_packed(tokens, lengths, layout, ["pos", "term_id"]))

    def _layout(self, run: _Run, lengths: DataFrame) -> Layout:
        return plan_layout(run.spark, lengths, TOKEN_BYTES, self.bucket_tokens, self.split_tokens)

    def _collapsed(self, run: _Run, layout: Layout, placed: DataFrame) -> LdaModel:
        return run.train(init_packed(placed, self.k, self.seed), layout, True, gibbs_sweep)

    def _edge(self, run: _Run, layout: Layout, first: DataFrame) -> LdaModel:
        return run.train(first, layout, self.likelihood, edge_sweep)


class _Run:
    """The loop over generations, the same for both modes."""

    def __init__(
        self, lda: LDA, spark: SparkSession, vocab: DataFrame, vocab_size: int | None
    ) -> None:
        self.lda = lda
        self.spark = spark
        self.vocab = vocab
        self.vocab_size = vocab.count() if vocab_size is None else vocab_size
        self.scratch = Scratch(spark)

    def train(
        self,
        first: DataFrame,
        layout: Layout,
        by_term: bool,
        sweep: Callable[..., DataFrame],
    ) -> LdaModel:
        """``by_term`` says whether sweeps need the counts of a state by term."""
        lda = self.lda
        kept: list[str] = []
        history: list[tuple[int, float, int, float | None]] = []
        state, words, counted, _ = self._store(first, "state0", layout, by_term, {})
        routes = places = None
        if by_term:
            routes = self.scratch.keep_pairs(held_terms(state), "routes", "term_id")
        if layout.split:
            places = self.scratch.keep_routes(state, "places", "doc_id")
        watched = {"changed": F.coalesce(F.sum("_moved"), F.lit(0))}
        if lda.likelihood:
            watched["likelihood"] = F.coalesce(F.sum("_log"), F.lit(0.0))
        name = "state0"
        rolling: list[str] = [name]
        for iteration in range(1, lda.iterations + 1):
            started = time.monotonic()
            every = lda.checkpoint_interval
            checkpoint = every > 0 and iteration % every == 0
            name = f"state{iteration}"
            before = f"state{iteration - 1}-words"
            vectors = no_vectors(state)
            if routes is not None:
                vectors = term_vectors(words, routes, lda.k)
            if places is not None:
                by_document = add_vectors(document_topics(state, lda.k), ["doc_id"], lda.k)
                whole = document_vectors(by_document, places, lda.k)
                vectors = whole if routes is None else vectors.unionByName(whole)
            swept = sweep(
                state, vectors, counted, alpha=lda.alpha, eta=lda.eta, vocab_size=self.vocab_size,
                seed=lda.seed, iteration=iteration, likelihood=lda.likelihood,
            )
            state, words, counted, seen = self._store(swept, name, layout, by_term, watched)
            self.scratch.drop(before)
            if checkpoint:
                kept.append(name)
                for old in kept[:-1]:
                    self.scratch.drop(old)
                del kept[:-1]
            else:
                rolling.append(name)
            while len(rolling) > GENERATIONS - 1:
                self.scratch.drop(rolling.pop(0))
            history.append((iteration, time.monotonic() - started, seen["changed"], seen.get("likelihood")))
        for old in rolling + ([] if lda.keep_last_checkpoint else kept):
            if old != name:
                self.scratch.drop(old)
        self.scratch.drop("places")
        return LdaModel(
            spark=self.spark,
            scratch=self.scratch,
            layout=layout,
            mode=lda.mode,
            k=lda.k,
            alpha=lda.alpha,
            eta=lda.eta,
            seed=lda.seed,
            iterations=lda.iterations,
            vocab=self.vocab,
            vocab_size=self.vocab_size,
            stored=state,
            totals=counted,
            history=history,
            words=words,
            routes=routes,
        )

    def _store(
        self,
        rows: DataFrame,
        name: str,
        layout: Layout,
        by_term: bool,
        watched: dict[str, Column],
    ) -> tuple[DataFrame, DataFrame | None, list[int], dict]:
        """Write one generation, and the counts by term that the next sweep and the
        totals are taken from. What is watched is seen by the job that writes."""
        watch = Observation(name)
        if watched:
            rows = rows.observe(watch, *[value.alias(column) for column, value in watched.items()])
        table = self.scratch.keep_bucketed(
            rows.drop("_moved", "_log"), name, layout.buckets, ["bucket"]
        )
        k, words = self.lda.k, None
        if by_term:
            words = self.scratch.keep(topic_sums(term_topics(table, k), ["term_id"], k), f"{name}-words")
        totals = add_vectors(document_topics(table, k) if words is None else words, [], k)
        counted = [int(n) for n in totals.first()["n"]]
        return table, words, counted, watch.get if watched else {}


def symmetric(alpha: float | Sequence[float], k: int) -> float:
    """One number for a symmetric prior given as a number or a vector of size 1 or k."""
    if isinstance(alpha, (int, float)):
        return float(alpha)
    values = [float(value) for value in alpha]
    if len(values) not in (1, k):
        raise ValueError(f"the prior must have 1 or {k} values, not {len(values)}")
    if any(value != values[0] for value in values):
        raise ValueError("only symmetric priors are supported")
    return values[0]
