"""Every query by name, with its SQL oracle: QUERIES and ORACLES of the modules listed here, merged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files, hindsight, modeling, relational, selection, streams, temporal, writes

MODULES = [temporal, relational, modeling, selection, hindsight, writes, files, streams]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship"](spark, sf_dir)
