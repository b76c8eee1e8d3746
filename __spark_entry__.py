"""Registered queries, one per operator, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracles
from themeloom import LDA, Corpus, LdaModel, Scratch, prepare_corpus
from themeloom.functions.special import dirichlet_expectation, log_sum_exp
from themeloom.operators import counts, graph, sampling, state, vocabulary
from themeloom.sinks import files, lines
from themeloom.sources import text

try:
    from themeloom.llm import registry as llm
except ImportError:  # the library works without that subpackage
    llm = None

K, SEED = oracles.K, oracles.SEED
ALPHA, BETA = oracles.ALPHA, oracles.BETA
EDGE_ALPHA, EDGE_BETA = oracles.EDGE_ALPHA, oracles.EDGE_BETA

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.corpus_from_table(table(spark, sf_dir, "documents"))


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return prepare_corpus(documents(spark, sf_dir), Scratch(spark))


def trained(
    spark: SparkSession, sf_dir: str, iterations: int = 1, k: int = K, likelihood: bool = False
) -> LdaModel:
    prepared = corpus(spark, sf_dir)
    lda = LDA(k=k, iterations=iterations, alpha=ALPHA, beta=BETA, seed=SEED, likelihood=likelihood)
    return lda.fit_packed(prepared.packed, prepared.vocab)


def edge_trained(
    spark: SparkSession, sf_dir: str, iterations: int = 1, k: int = K, likelihood: bool = False
) -> LdaModel:
    prepared = corpus(spark, sf_dir)
    lda = LDA(
        k=k, iterations=iterations, alpha=EDGE_ALPHA, beta=EDGE_BETA, seed=SEED, mode="edge",
        likelihood=likelihood,
    )
    return lda.fit_packed(prepared.packed, prepared.vocab)


def started(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State before the first sweep, stored: several counts are taken from it."""
    prepared = corpus(spark, sf_dir)
    return state.init_assignments(prepared.tokens, K, SEED)


def on_model(ask: Callable[[LdaModel], DataFrame]) -> Query:
    return lambda spark, sf_dir: ask(trained(spark, sf_dir))


def on_edge_model(ask: Callable[[LdaModel], DataFrame]) -> Query:
    return lambda spark, sf_dir: ask(edge_trained(spark, sf_dir))


def on_start(ask: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: ask(started(spark, sf_dir))


def rounded(rows: DataFrame, column: str, places: int = 6) -> DataFrame:
    return rows.withColumn(column, F.round(column, places))


def permille(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Small probabilities times 1000, so that six places mean something."""
    return rows.withColumn(name, F.round(F.col(column) * 1e3, 6)).drop(column)


# -- sources, tokens, vocabulary ------------------------------------------------


def assign_doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return text.assign_doc_ids(pages, ["url", "page_id"], Scratch(spark)).select(
        "doc_id", "page_id", "url"
    )


def fit_vocabulary_min_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary.running_words(documents(spark, sf_dir))
    return vocabulary.fit_vocabulary(words, Scratch(spark), vocab_size=1000, min_df=3)


def distinct_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.line_words(table(spark, sf_dir, "documents"))
    return vocabulary.distinct_vocabulary(words, Scratch(spark))


def decode_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = corpus(spark, sf_dir)
    return vocabulary.decode_terms(prepared.tokens, prepared.vocab, prepared.vocab_bytes)


def bag_from_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    amounts = table(spark, sf_dir, "lineitem").withColumn(
        "amount", F.col("l_quantity") * 0.25 - 3
    )
    return text.bag_from_counts(amounts, "l_suppkey", "l_partkey", "amount")


def edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    prepared = corpus(spark, sf_dir)
    size = prepared.vocab.count()
    return graph.doc_term_edges(prepared.bag, size), size


# -- state and sweeps -----------------------------------------------------------


def init_assignments_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = state.expand_bag(corpus(spark, sf_dir).bag)
    return state.init_assignments(tokens, K, SEED).select("doc_id", "pos", "term_id", "topic")


def topic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = trained(spark, sf_dir, iterations=0)
    rows = sampling.join_counts(
        model.placed_rows(), model.words, None, model.totals, eta=BETA, vocab_size=model.vocab_size
    )
    weights = sampling.topic_weights(rows, sampling.collapsed_weight(ALPHA), K, ["doc_id", "pos"])
    return weights.withColumn("weight", F.round(F.col("weight") * 1e6, 6))


def edge_weights(spark: SparkSession, sf_dir: str, normalize: bool) -> DataFrame:
    model = edge_trained(spark, sf_dir, iterations=0)
    weight = sampling.edge_weight(EDGE_BETA)
    return sampling.topic_weights(model.edge_rows(), weight, K, ["doc_id", "term_id"], normalize)


def topic_weights_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = edge_weights(spark, sf_dir, normalize=False)
    return weights.withColumn("weight", F.round(F.col("weight") * 1e6, 6))


def metrics(model: LdaModel) -> DataFrame:
    """Without the times, which are other ones each time."""
    return rounded(model.iteration_metrics().drop("seconds"), "log_likelihood", 2)


def many_topics(k: int) -> dict[str, Query]:
    return {
        f"gibbs_sweep_k{k}": lambda s, d: token_topics(trained(s, d, k=k)),
        f"edge_sweep_k{k}": lambda s, d: cell_topics(edge_trained(s, d, k=k)),
    }


def cell_topics(model: LdaModel) -> DataFrame:
    return model.word_topic_counts("doc_term").select("doc_id", "term_id", "topic", "n")


def token_topics(model: LdaModel) -> DataFrame:
    return model.state.select("doc_id", "pos", "term_id", "topic")


# -- sinks ----------------------------------------------------------------------


def write_wordmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    words = vocabulary.running_words(documents(spark, sf_dir))
    path = f"{scratch.root}/wordmap"
    files.write_wordmap(vocabulary.fit_vocabulary(words, scratch), path)
    return spark.read.text(path, lineSep="\n").select(F.col("value").alias("line"))


def write_assignments(model: LdaModel) -> DataFrame:
    parts = lines.assignment_lines(model.state, model.scratch)
    return parts.select("line_no", F.col("part.pos").alias("part"), "line")


def theta_lines(model: LdaModel) -> DataFrame:
    rows = lines.theta_lines(model.docs, K, ALPHA, model.scratch)
    values = F.posexplode(F.split(F.rtrim("line"), " ")).alias("topic", "value")
    return rows.select("line_no", values).withColumn(
        "value", F.round(F.col("value").cast("double"), 6)
    )


def phi_lines(model: LdaModel) -> DataFrame:
    rows = lines.phi_lines(model.words, model.totals, BETA, model.vocab_size, model.vocab)
    values = F.posexplode(F.split("line", " ")).alias("_at", "value")
    return rows.select("line_no", "part", values).select(
        F.col("line_no").cast("int").alias("line_no"),
        (F.col("part") * lines.PART + F.col("_at")).cast("bigint").alias("term_id"),
        F.round(F.col("value").cast("double") * 1e3, 6).alias("value_permille"),
    )


def written(model: LdaModel) -> str:
    """Folder of the text files of a model, just written."""
    folder = f"{model.scratch.root}/text"
    files.write_model(model, folder, "model", top_words=10, wordmap="wordmap")
    return folder


def others_lines(model: LdaModel) -> DataFrame:
    path = f"{written(model)}/model{files.OTHERS}"
    return model.spark.read.text(path).select(F.col("value").alias("line"))


def twords_lines(model: LdaModel) -> DataFrame:
    rows = lines.twords_lines(model.describe_topics(10))
    word = F.regexp_extract("line", r"^\t(.*) (\S+)$", 1)
    value = F.regexp_extract("line", r"^\t(.*) (\S+)$", 2)
    title = F.col("rank") == 0
    return rows.select(
        "topic",
        "rank",
        F.when(title, F.col("line")).otherwise(word).alias("word"),
        F.round(value.try_cast("double"), 6).alias("phi"),
    )


def read_back(suffix: str) -> Query:
    """Lines of a file of a model, as any reader of lines finds them."""
    return on_model(lambda model: model.spark.read.text(f"{written(model)}/model{suffix}"))


def assignment_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(files.ASSIGNMENTS)(spark, sf_dir).select(F.col("value").alias("line"))


def value_file(suffix: str, key: str, factor: float, name: str) -> Query:
    """Values of the lines of a file, by their place in the line."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        values = F.posexplode(F.split(F.rtrim("value"), " ")).alias(key, "_text")
        rows = read_back(suffix)(spark, sf_dir).select(values)
        return rows.select(key, F.round(F.col("_text").cast("double") * factor, 6).alias(name))

    return query


def top_words_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_back(files.TOP_WORDS)(spark, sf_dir)
    part = [F.regexp_extract("value", r"^\t(.*) (\S+)$", i) for i in (1, 2)]
    word = F.when(F.startswith("value", F.lit("\t")), part[0]).otherwise(F.col("value"))
    return rows.select(word.alias("word"), F.round(part[1].try_cast("double"), 6).alias("phi"))


def entry(spark: SparkSession) -> DataFrame:
    """Top ten words of each topic after two sweeps over the smallest corpus."""
    return trained(spark, "/root/testdata/sf0.001", iterations=2).describe_topics(10)


def queries() -> dict[str, Query]:
    return model_queries() | (llm.queries() if llm else {})


def model_queries() -> dict[str, Query]:
    return {
        "read_corpus": documents,
        "read_token_lines": lambda s, d: text.read_token_lines(table(s, d, "documents")),
        "assign_doc_ids": assign_doc_ids,
        "tokenize": lambda s, d: vocabulary.tokenize(documents(s, d)),
        "encode_tokens": lambda s, d: corpus(s, d).tokens,
        "decode_terms": decode_terms,
        "fit_vocabulary": lambda s, d: corpus(s, d).vocab,
        "fit_vocabulary_min_df": fit_vocabulary_min_df,
        "distinct_vocabulary": distinct_vocabulary,
        "count_vectorize": lambda s, d: corpus(s, d).bag,
        "bag_from_counts": bag_from_counts,
        "corpus_summary": lambda s, d: corpus(s, d).summary(),
        "doc_term_edges": lambda s, d: edges(s, d)[0],
        "decode_edges": lambda s, d: graph.decode_edges(*edges(s, d)),
        "graph_counts": lambda s, d: graph.graph_counts(edges(s, d)[0]),
        "init_assignments": on_start(lambda rows: rows),
        "init_assignments_bag": init_assignments_bag,
        "word_topic_counts": on_start(counts.word_topic_counts),
        "word_topic_counts_doc_term": on_start(
            lambda rows: counts.word_topic_counts(rows, "doc_term")
        ),
        "doc_topic_counts": on_start(counts.doc_topic_counts),
        "doc_lengths": on_start(counts.doc_lengths),
        "topic_totals": on_start(lambda rows: counts.topic_totals(rows, K)),
        "topic_weights": topic_weights,
        "topic_weights_edge": topic_weights_edge,
        "topic_shares_edge": lambda s, d: rounded(edge_weights(s, d, normalize=True), "weight"),
        "gibbs_sweep": on_model(token_topics),
        "edge_sweep": on_edge_model(cell_topics),
        "fit_lda": lambda s, d: token_topics(trained(s, d, iterations=2)),
        "fit_lda_edge": lambda s, d: cell_topics(edge_trained(s, d, iterations=2)),
        "iteration_metrics": lambda s, d: metrics(trained(s, d, iterations=2, likelihood=True)),
        "iteration_metrics_edge": lambda s, d: metrics(edge_trained(s, d, iterations=2, likelihood=True)),
        "tokens_changed": lambda s, d: trained(s, d, iterations=2)
        .iteration_metrics()
        .select("iteration", "tokens_changed"),
        "theta": on_model(lambda m: rounded(m.theta(), "theta")),
        "theta_all_documents": lambda s, d: rounded(
            trained(s, d).theta(documents(s, d)), "theta"
        ),
        "phi": on_model(lambda m: permille(m.phi(), "phi", "phi_permille")),
        "phi_doc_term": on_model(lambda m: permille(m.phi("doc_term"), "phi", "phi_permille")),
        "topics_matrix": on_model(lambda m: m.topics_matrix()),
        "topic_distributions": on_model(lambda m: m.topic_distributions()),
        "topic_distributions_normalized": on_model(
            lambda m: rounded(m.topic_distributions(normalize=True), "weight")
        ),
        "topic_assignments": on_model(lambda m: m.topic_assignments()),
        "topic_assignments_edge": on_edge_model(lambda m: m.topic_assignments()),
        "describe_topics": on_model(lambda m: rounded(m.describe_topics(10), "phi")),
        "describe_topics_all": on_model(lambda m: m.describe_topics().drop("phi")),
        "top_documents_per_topic": on_model(lambda m: m.top_documents_per_topic(20)),
        "top_documents_per_topic_5000": on_model(lambda m: m.top_documents_per_topic(5000)),
        "assignment_arrays": on_model(lambda m: m.assignment_arrays()),
        "top_topics_per_document": on_model(
            lambda m: rounded(m.top_topics_per_document(3), "weight")
        ),
        "log_likelihood": on_model(lambda m: rounded(m.log_likelihood(), "log_likelihood", 2)),
        "log_likelihood_map": on_edge_model(
            lambda m: rounded(m.log_likelihood("map", "doc_term"), "log_likelihood", 2)
        ),
        "perplexity": on_model(lambda m: rounded(m.perplexity(), "perplexity", 4)),
        "perplexity_map": on_edge_model(
            lambda m: rounded(m.perplexity("map", "doc_term"), "perplexity", 4)
        ),
        "log_prior": on_edge_model(lambda m: rounded(m.log_prior(), "log_prior", 2)),
        "log_prior_doc_term": on_edge_model(lambda m: rounded(m.log_prior("doc_term"), "log_prior", 2)),
        "log_sum_exp": lambda s, d: rounded(
            log_sum_exp(
                table(s, d, "embeddings").select("vec_id", F.explode("embedding").alias("x")),
                "vec_id",
                "x",
            ),
            "log_sum_exp",
        ),
        "log_sum_exp_large": lambda s, d: rounded(
            log_sum_exp(table(s, d, "lineitem"), "l_suppkey", "l_extendedprice"), "log_sum_exp"
        ),
        "dirichlet_expectation": lambda s, d: rounded(
            dirichlet_expectation(
                table(s, d, "lineitem").select(
                    F.col("l_orderkey").alias("row_id"),
                    F.col("l_linenumber").alias("k"),
                    F.col("l_quantity").alias("alpha"),
                )
            ),
            "e_log_theta",
        ),
        "write_wordmap": write_wordmap,
        "write_assignments": on_model(write_assignments),
        "theta_lines": on_model(theta_lines),
        "phi_lines": on_model(phi_lines),
        "others_lines": on_model(others_lines),
        "twords_lines": on_model(twords_lines),
        "tassign_file": assignment_file,
        "theta_file": value_file(files.THETA, "topic", 1.0, "theta"),
        "phi_file": value_file(files.PHI, "term_id", 1e3, "phi_permille"),
        "twords_file": top_words_file,
    } | {name: query for k in oracles.MANY for name, query in many_topics(k).items()}


def oracle_sql() -> dict[str, str]:
    return oracles.statements() | (llm.oracle_sql() if llm else {})
