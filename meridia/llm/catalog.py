"""Queries and SQL twins of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from meridia.llm import queries as own
from meridia.llm import sql


def queries() -> dict:
    return own.QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in sql.ORACLE.items() if k in own.QUERIES}
