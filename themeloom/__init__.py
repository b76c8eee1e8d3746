"""Topic models of large text collections, trained and queried as Spark jobs."""

from themeloom.plans.corpus import Corpus, prepare_corpus, prepare_lines
from themeloom.plans.model import LdaModel
from themeloom.plans.scratch import Scratch
from themeloom.plans.training import LDA

__all__ = ["LDA", "Corpus", "LdaModel", "Scratch", "prepare_corpus", "prepare_lines"]
