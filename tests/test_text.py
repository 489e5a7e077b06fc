"""Text functions against hand-made cases and plain Python."""

import re
import string

import pytest
from pyspark.sql import functions as F

from meridia.functions import text as tx
from meridia.plans.answers import code_facts


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("said", "abstains"),
    [("", True), (None, True), ("   ", True), ("unknown", True), ("N/A.", True), ("No idea!", True), ("Unknown Pleasures", False), ("I don't know.", True), ("don’t", False), ("The passage does not say.", True), ("Paris", False), ("no", False), ("none", False),
     ("word " * 21 + "cannot answer", False), ("It is not mentioned", True), ("Insufficient context", True), ("unable to  determine", True), ("Notable", False)],
)
def test_abstention(spark, said, abstains):
    assert value(spark, tx.is_abstention(F.lit(said).cast("string"))) is abstains


@pytest.mark.parametrize(
    ("said", "clean"),
    [("A: Paris", "Paris"), ("Answer. Paris ", "Paris"), ("Answer : A: x", "A: x"), ("Paris\nQuestion 2: And?", "Paris"), ("Paris Context: more", "Paris"), (None, ""), ("Apple", "Apple"), ("Context: all", "")],
)
def test_sanitize(spark, said, clean):
    assert value(spark, tx.sanitize_answer(F.lit(said).cast("string"))) == clean


def _normal(text):
    plain = "".join(c for c in text.lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", plain).split())


@pytest.mark.parametrize("said", ["The  Cat, a dog!", "Été à la naïve — “the”", "an\tan\nan", "", "a", "U.S.A.", "x_y-z", "theatre the"])
def test_normalize(spark, said):
    assert value(spark, tx.normalize_answer(F.lit(said))) == _normal(said)
    assert value(spark, tx.normalize_passage(F.lit(said))) == " ".join(said.lower().split())


@pytest.mark.parametrize("said", ["One. Two! Three?\nFour; five", "", "no end", "a.b c.  d", " x;y ; z ", "End.\n\n\nNext"])
def test_sentences(spark, said):
    want = [p.strip() for p in re.split(r"(?<=[.!?])\s+|\n+|;\s+", said.strip()) if p.strip()]
    assert value(spark, tx.sentences(F.lit(said))) == want


@pytest.mark.parametrize(
    ("answer", "gold", "f1", "exact"),
    [("the cat sat", "cat sat", 1.0, 1.0), ("cat cat", "cat", 2 / 3, 0.0), ("dog", "cat", 0.0, 0.0), ("", "", 1.0, 1.0), ("I don't know", "", 1.0, 1.0), ("Paris", "", 0.0, 0.0), ("unknown", "Paris", 0.0, 0.0), ("the", "a", 0.0, 1.0), ("big red dog", "red dog runs", 2 / 3, 0.0)],
)
def test_token_f1(spark, answer, gold, f1, exact):
    got = value(spark, tx.token_f1(F.lit(answer), F.lit(gold)))
    assert got["f1"] == pytest.approx(f1) and got["exact_match"] == exact


def test_best_f1_takes_each_maximum_by_itself(spark):
    got = value(spark, tx.best_token_f1(F.lit("red dog"), F.array(F.lit("red dog runs far"), F.lit("dog red"), F.lit(""))))
    assert (got["f1"], got["exact_match"], got["is_answerable"]) == (1.0, 0.0, 1.0)
    none = value(spark, tx.best_token_f1(F.lit("not sure"), F.array(F.lit(" "))))
    assert (none["f1"], none["is_answerable"]) == (1.0, 0.0)


@pytest.mark.parametrize(("a", "b", "at"), [("x y z", "x q z", 1), ("x y", "x y z", 2), ("x y", "x y", None), ("", "x", 0), ("p", "q", 0)])
def test_first_divergence(spark, a, b, at):
    assert value(spark, tx.first_divergence(tx.words(F.lit(a)), tx.words(F.lit(b)))) == at


def test_jaccard(spark):
    assert value(spark, tx.jaccard(F.lit("A b, c"), F.lit("b c d"))) == pytest.approx(0.5)
    assert value(spark, tx.jaccard(F.lit(""), F.lit("b"))) == 0.0


def test_prompts(spark):
    contexts = F.array(F.lit("one"), F.lit(""), F.lit("three"))
    assert value(spark, tx.qa_prompt(F.lit("Q?"), contexts, "Do.\n\n")) == "Do.\nContext 1: one\n\nContext 3: three\n\nQuestion: Q?\nAnswer:"
    history = F.array(F.struct(F.lit("hi").alias("user"), F.lit("ho").alias("assistant")))
    assert value(spark, tx.multi_turn_prompt(F.lit("Q?"), F.array().cast("array<string>"), history)) == "User: hi\nAssistant: ho\nUser: Q?\nAssistant:"


@pytest.mark.parametrize(("said", "code"), [("x", "x"), ("a ```python\nx = 1\n``` b", "x = 1\n"), ("```y```", "y"), ("", ""), ("``` ", " ")])
def test_code_block(spark, said, code):
    assert value(spark, tx.code_block(F.lit(said))) == code


def test_code_facts():
    got = code_facts("import os\nfrom sys import path\nif path:\n    os.system('x')\nfor a in path:\n    pass")
    assert got == {"valid": True, "n_imports": 2, "loc": 6, "complexity": 3, "n_unsafe": 1}
    assert code_facts("x = (")["valid"] is False and code_facts("")["loc"] == 0 and not code_facts("a\x00b")["valid"]


def test_stale(spark):
    import hashlib

    ids = [f"q{k}" for k in range(50)]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select("id", tx.stale_selected("id", 0.3).alias("s")).collect()
    assert {r["id"]: r["s"] for r in rows} == {i: int(hashlib.sha1(f"42:{i}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF < 0.3 for i in ids}
    contexts = F.array(F.lit("It is PARIS (fr)."), F.lit("other"))
    assert value(spark, tx.stale_contexts(contexts, F.lit("paris (FR)"))) == ["It is [redacted].", "other"]
    assert value(spark, tx.stale_contexts(contexts, F.lit("Rome"))) == ["other"]
    assert value(spark, tx.stale_contexts(contexts, F.lit(" "))) == ["It is PARIS (fr).", "other"]


def test_token_estimate(spark):
    assert [value(spark, tx.token_estimate(F.lit(x))) for x in ("", "a", "a b c", " a  b ")] == [0, 1, 4, 2]
