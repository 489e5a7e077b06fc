"""Every registered query of the engine and, where SQL can express it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meridia.plans import answers, campaigns, composites, experiments, retrieval

Query = Callable[[SparkSession, str], DataFrame]

#: Modules with QUERIES (name -> callable) and ORACLE (name -> SQL).
MODULES = (retrieval, answers, experiments, composites, campaigns)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
