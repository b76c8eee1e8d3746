"""Times the headline queries and prints one JSON line.

Reads the tables in $BENCH_SF_DIR on local[$BENCH_CPUS]. The corpus is prepared
once, the models are trained once, and each question is timed on its own; every
result is written in full to a sink that discards it.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from themeloom import LDA, Scratch, prepare_corpus
from themeloom.sources.text import bag_from_counts, corpus_from_table

SWEEPS = 8


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("themeloom-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    times: dict[str, float] = {}

    def clock(name: str, work: Callable):
        started = time.monotonic()
        result = work()
        if isinstance(result, DataFrame):
            result.write.format("noop").mode("overwrite").save()
        times[name] = round(time.monotonic() - started, 3)
        return result

    docs = corpus_from_table(spark.read.parquet(f"{folder}/documents.parquet"))
    corpus = clock("prepare_corpus", lambda: prepare_corpus(docs, Scratch(spark)))
    tokens = corpus.tokens.count()
    clock("corpus_summary", corpus.summary)
    clock("count_vectorize", lambda: corpus.bag)

    rates: dict[str, int] = {}

    def train(name: str, k: int, mode: str, sweeps: int = SWEEPS):
        alpha, beta = (0.3, 0.5) if mode == "collapsed" else (1.3, 1.5)
        lda = LDA(k=k, iterations=sweeps, alpha=alpha, beta=beta, seed=42, mode=mode)
        model = clock(f"fit_{name}", lambda: lda.fit(corpus.tokens, corpus.vocab))
        # The first sweeps also compile code; the median of the rest is the rate.
        seconds = [row[1] for row in model.history]
        steady = statistics.median(seconds[len(seconds) // 2 :])
        times[f"sweep_{name}"] = round(steady, 3)
        rates[name] = int(tokens / steady)
        return model

    model = train("collapsed_k5", 5, "collapsed")
    for name in ("theta", "phi", "topics_matrix", "topic_distributions", "topic_assignments"):
        clock(name, getattr(model, name))
    clock("describe_topics", lambda: model.describe_topics(10))
    clock("top_documents_per_topic", lambda: model.top_documents_per_topic(10))
    clock("top_topics_per_document", lambda: model.top_topics_per_document(3))
    clock("log_likelihood", model.log_likelihood)
    perplexity = clock("perplexity", model.perplexity).first()[0]
    model.release()
    train("collapsed_k10", 10, "collapsed").release()
    train("collapsed_k20", 20, "collapsed").release()
    train("collapsed_k64", 64, "collapsed", sweeps=4).release()
    edge = train("edge_k5", 5, "edge")
    clock("log_prior", edge.log_prior)
    edge.release()
    train("edge_k10", 10, "edge").release()
    corpus.release()

    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    clock(
        "bag_from_counts", lambda: bag_from_counts(lines, "l_suppkey", "l_partkey", "l_quantity")
    )
    print(
        json.dumps(
            {
                "metric": "total_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "tokens_per_second": rates,
                "tokens": tokens,
                "perplexity": perplexity,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
