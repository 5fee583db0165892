"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestra.plans import check_queries, queue_queries, region_queries, scoring_queries, set_queries, stream_queries, text_queries, truth_queries, write_queries

_ALL = (text_queries, check_queries, queue_queries, region_queries, scoring_queries, set_queries, stream_queries, truth_queries, write_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _ALL for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _ALL for k, s in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of extraction errors by run and field."""
    return scoring_queries.score_rates_by_run(spark, sf_dir)
