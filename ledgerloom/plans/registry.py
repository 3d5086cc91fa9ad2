"""All registered queries of the library and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.functions.shipping import ship
from ledgerloom.plans import behavior_queries, document_queries, enrich_queries, reconcile_queries, sequential_sql, source_queries

GROUPS = (behavior_queries, document_queries, enrich_queries, reconcile_queries, sequential_sql, source_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def sent(q):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return q(spark, sf_dir)

        return run

    return {name: sent(q) for g in GROUPS for name, q in g.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for g in GROUPS for name, q in g.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked behavioural events over the ledger."""
    return behavior_queries.QUERIES["B12_top_events"](spark, sf_dir)
