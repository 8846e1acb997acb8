"""The named queries of the core operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans import assembly, dedup, distributions, embedding, evaluation, extras, gates, judging, ledgers, movement, pairing, projections, ranks, reports, retrieval, scoring, significance, statistics, texts  # noqa: F401
from corpusmill.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
