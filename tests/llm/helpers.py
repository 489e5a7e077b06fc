"""Small tables for the operators' tests."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string"


def docs(spark, texts, schema=DOCS):
    rows = texts.items() if isinstance(texts, dict) else texts
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def prose(seed: int, words: int, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(words)]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
