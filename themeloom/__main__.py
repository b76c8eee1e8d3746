"""Command line: ``spark-submit`` or ``python -m themeloom -d DIR -K 5 -a 0.3 -b 0.5 -n 100``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from themeloom.plans.job import train_directory
from themeloom.plans.training import DEFAULT_CHECKPOINT_INTERVAL, LDA
from themeloom.sinks.files import write_model


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="themeloom", description="Train a topic model.")
    parser.add_argument("-d", "--directory", help="directory of text files")
    parser.add_argument("-o", "--output", help="directory for the model files")
    parser.add_argument("-m", "--modelname", default="model", help="name of the model files")
    parser.add_argument("-a", "--alpha", type=float, default=-1.0, help="document prior, 0 = auto")
    parser.add_argument("-b", "--beta", type=float, default=-1.0, help="word prior, 0 = auto")
    parser.add_argument("-K", "--ntopics", type=int, default=-1, help="number of topics")
    parser.add_argument("-n", "--niters", type=int, default=-1, help="number of sweeps")
    parser.add_argument("-t", "--twords", type=int, default=0, help="top words per topic")
    parser.add_argument("-wm", "--wordmap", help="name of the word map file")
    parser.add_argument("--mode", choices=("collapsed", "edge"), default="collapsed")
    parser.add_argument("--seed", type=int, help="seed; random if not given")
    parser.add_argument("--token-lines", action="store_true", help="one token per line")
    parser.add_argument(
        "--checkpoint-interval", type=int, default=DEFAULT_CHECKPOINT_INTERVAL, help="-1 = none"
    )
    return parser


def main(argv: list[str] | None = None) -> int:
    parser = arguments()
    given = parser.parse_args(argv)
    if min(given.alpha, given.beta, given.ntopics, given.niters) < 0 or not given.directory:
        parser.print_help()
        return 2
    lda = LDA(
        k=given.ntopics,
        iterations=given.niters,
        alpha=given.alpha,
        beta=given.beta,
        seed=given.seed,
        mode=given.mode,
        checkpoint_interval=given.checkpoint_interval,
    )
    spark = SparkSession.builder.appName("themeloom").getOrCreate()
    seconds: dict[str, float] = {}
    corpus, model = train_directory(spark, given.directory, lda, given.token_lines, seconds)
    corpus.summary().show()
    for step, time in seconds.items():
        print(f"{step}: {time:.1f} seconds")
    model.iteration_metrics().show(given.niters)
    model.perplexity().show()
    if given.twords > 0:
        words = model.describe_topics(given.twords).orderBy("topic", "rank")
        words.select("topic", "term", "phi").show(given.ntopics * given.twords, truncate=False)
    if given.output:
        write_model(
            model, given.output, given.modelname, given.twords, given.wordmap, corpus.docs
        )
    model.release()
    corpus.release()
    return 0


if __name__ == "__main__":
    sys.exit(main())
