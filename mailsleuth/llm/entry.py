"""What ``__spark_entry__`` adds while this subpackage is there: the queries, their statements, the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpus_pipeline import ORACLE_SQL, run

from .queries import QUERIES
from .statements import STATEMENTS


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**QUERIES, "pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {**STATEMENTS, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}
