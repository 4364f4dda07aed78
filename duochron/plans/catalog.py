"""Registry of runnable queries: name -> (plan over a folder of parquet tables, check SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        QUERIES[name] = plan
        if sql is not None:
            ORACLE[name] = sql
        return plan

    return add


def load_all() -> None:
    from . import core, curves, features, graphs, inference, places, reports  # noqa: F401
