"""All queries of the time-state operators, with SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tempora.plans import demos, suite


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return suite.QUERIES | demos.QUERIES


def oracle_sql() -> dict[str, str]:
    return suite.ORACLES | demos.ORACLES
