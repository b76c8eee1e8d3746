"""Registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from themeloom.llm import queries as q
from themeloom.llm import sql

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    operators = {name: function for name, function in vars(q).items() if name.startswith("op")}
    return operators | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return sql.STATEMENTS
