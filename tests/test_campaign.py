import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from meridia import catalog
from meridia.operators import campaign as cp
from meridia.sources import sinks, trials


def test_registry(spark):
    reg = cp.classify(cp.contrasts(spark)).collect()
    assert [r["contrast_id"] for r in reg] == list(range(1, 21))
    assert {r["contrast_id"]: r["reason"] for r in reg if r["contrast_id"] in (4, 10, 12, 15, 20)} == {4: None, 10: "one-sided-selector", 12: "falsification-suite", 15: "window-unit", 20: "no-baseline-pair"}
    assert [r["contrast_id"] for r in cp.resolve_ids(cp.contrasts(spark), [7, 4, 7]).collect()] == [7, 4]
    with pytest.raises(ValueError, match="unknown"):
        cp.resolve_ids(cp.contrasts(spark), [21])
    assert cp.direction("f1_score") and not cp.direction("ttft_ms")
    with pytest.raises(ValueError, match="unknown metric"):
        cp.direction("nope")


def test_pairs_with_null_axes_and_ambiguity(spark):
    rows = [(0.5, "B1", "k1", "d1"), (0.5, "B1", "k1", "d2"), (0.5, "B6", "k2", "d2"), (None, "B1", "k3", "d1"), (None, "B6", "k4", "d1"), (1.0, "B1", "k5", "d1")]
    index = spark.createDataFrame(rows, "r double, baseline string, row_key string, dataset string")
    got = sorted((r["cell"], r["reference"], r["datasets"]) for r in cp.match_pairs(index, "B1", "B6", ["r"]).collect())
    assert got == [("k1", "k2", ["d2"]), ("k3", "k4", ["d1"])]
    with pytest.raises(Exception, match="ambiguous"):
        cp.match_pairs(index.union(spark.createDataFrame([(0.5, "B6", "k9", "d1")], index.schema)), "B1", "B6", ["r"]).collect()


def test_verdicts_and_requests(spark):
    one = lambda v: spark.range(1).select(cp.verdict_value(F.lit(v).cast("string")).alias("v")).first()["v"]
    assert [one("True"), one("0"), one(" "), one(None), one("0.5")] == [1.0, 0.0, None, None, 0.5]
    with pytest.raises(Exception, match="not a verdict"):
        one("maybe")
    req = spark.createDataFrame([("a", True), ("b", False)], "id string, ok boolean")
    assert [r["veridical"] for r in cp.request_predicates(req, spark.createDataFrame([("a", True)], "id string, predicate boolean"), ["id"]).orderBy("id").collect()] == [True, False]
    with pytest.raises(Exception, match="no verdict"):
        cp.request_predicates(req, spark.createDataFrame([("b", True)], "id string, predicate boolean"), ["id"]).collect()


def test_unblind_and_scramble(spark):
    rows, good = spark.createDataFrame([("t1",), ("t2",)], "token string"), [("t1", "x"), ("t2", "y")]
    assert [r["label"] for r in cp.unblind(rows, spark.createDataFrame(good, "token string, label string")).orderBy("token").collect()] == ["x", "y"]
    with pytest.raises(ValueError, match="one to one"):
        cp.unblind(rows, spark.createDataFrame([("t1", "x"), ("t2", "x")], "token string, label string"))
    with pytest.raises(Exception, match="unknown token"):
        cp.unblind(rows, spark.createDataFrame(good[:1], "token string, label string")).collect()
    assert sorted(cp.scrambled(["b", "a", "b"], 1).values()) == ["ARM-01", "ARM-02"]


def test_manifest_build_and_selection(spark):
    examples = pd.DataFrame({"id": [f"q{k}" for k in range(40)], "context": [[f"paragraph {k // 2} " + "word " * 20] for k in range(40)]})
    one, two = (cp.build_manifest(examples, queries=5, trials=3, seed=9, budget=100) for _ in range(2))
    assert one == two and one["disjoint"] and len({x for t in one["trials"].values() for x in t}) == 15
    assert all(one["question_to_block"][f"q{k}"] == one["question_to_block"][f"q{k + 1}"] for k in range(0, 40, 2) if f"q{k}" in one["question_to_block"])
    with pytest.raises(ValueError, match="smaller"):
        cp.build_manifest(examples.head(2), queries=5, trials=1, seed=1)
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    assert [r["x"] for r in cp.select_manifest(df, ["b", "a"]).collect()] == [2, 1]
    with pytest.raises(Exception, match="not in the dataset: z"):
        cp.select_manifest(df, ["z"]).collect()


def test_guards(spark):
    same = spark.createDataFrame([(0.0,)] * 9 + [(1.0,)], "value double")
    cp.guard_injection(same, "flip")
    with pytest.raises(ValueError, match="collide"):
        cp.guard_injection(same, "shift")
    with pytest.raises(ValueError, match="binary"):
        cp.guard_injection(spark.createDataFrame([(0.5,)], "value double"), "flip")
    with pytest.raises(ValueError, match="arrivals"):
        cp.no_replay(same, 9)
    with pytest.raises(Exception, match="without requests"):
        cp.probe_attainment(spark.createDataFrame([(0, 0)], "intended int, completed int")).collect()
    assert cp.split_half_interval(12, 200)[2]


def test_answer_changing(spark):
    one = lambda a, b, gold=None: spark.range(1).select(cp.answer_changing(F.lit(a), F.lit(b), None if gold is None else F.lit(gold)).alias("c")).first()["c"]
    assert [one("A: The Paris", "paris!"), one("Paris", "Rome"), one("unknown", "I don't know"), one("unknown", "Paris")] == [False, True, False, True]
    assert [one("big dog", "dog big", "dog"), one("dog", "big dog", "dog"), one("x", "unknown", "dog")] == [False, True, True]
    blocks = F.array(F.lit("red dog"), F.lit("blue sky"))
    assert spark.range(1).select(cp.relevance_share(blocks, F.lit("red dog runs")).alias("s")).first()["s"] == 0.5


def test_reports(spark):
    rng = np.random.default_rng(0)
    rows = [("e1" if k % 2 else "anchor", k, "IN_REGIME", 0.9, 0.9 - (0.3 if k % 2 else 0.1) - float(rng.normal(0, 0.01))) for k in range(24)] + [("e1", 99, "PAST_CLIFF", 0.9, 0.0)]
    got = cp.truth_tax(spark.createDataFrame(rows, "engine string, window_id int, regime string, goodput_frac double, yield_frac double"), "anchor").collect()
    assert [r["engine"] for r in got] == ["e1"] and got[0]["mean_diff"] == pytest.approx(0.2, abs=0.02) and got[0]["p_max"] < 0.001
    legs = cp.fingerprint(spark.createDataFrame([("evict", 0.01), ("compress", 0.02)], "leg string, p double")).collect()
    assert {r["p_max"] for r in legs} == {1.0} and sorted(r["p_holm"] for r in legs) == [pytest.approx(0.03), pytest.approx(0.04)]
    rows = [("d", k, float(x), 0.0) for k, x in enumerate([1] * 12)]
    stats = cp.pair_statistics(spark.createDataFrame(rows, "dataset string, example_id int, a double, b double"), metric="ttft_ms").first()
    assert (stats["wins"], stats["losses"]) == (0, 12) and stats["p"] < 0.01
    assert [r["x"] for r in cp.in_order(spark.createDataFrame([("z",), ("b",), ("a",), ("c",)], "x string"), "x", ["c", "b"]).collect()] == ["c", "b", "a", "z"]


def test_more_sources(spark, tmp_path):
    df = spark.createDataFrame([("1", 0.5, 1, 10.0), ("2", 0.1, 0, 20.0)], "item_id string, score double, label int, context_length double")
    assert trials.anchor(df).count() == 2
    for bad, word in ((df.union(df.limit(1)), "twice"), (df.withColumn("label", F.lit(3)), "bad rows"), (df.drop("score"), "lacks"), (df.limit(0), "empty")):
        with pytest.raises(ValueError, match=word):
            trials.anchor(bad)
    good = {"run_id": "r-1", "campaign": "c", "model": "m", "engine": "e", "seed": 0, "datasets": ["d"]}
    sinks.write_text(spark, f"{tmp_path}/m.json", json.dumps(good))
    assert trials.manifest(spark, f"{tmp_path}/m.json") == good
    sinks.write_text(spark, f"{tmp_path}/m.json", json.dumps(good | {"run_id": "a b"}))
    with pytest.raises(ValueError, match="run_id"):
        trials.manifest(spark, f"{tmp_path}/m.json")
    raw = spark.createDataFrame([("1", "q", None, "b")], "id string, question string, answer_text string, answer string")
    assert trials.either_spelling(raw, {"answer": ["answer_text", "answer"], "absent": ["nope"]}).first().asDict() == {"answer": "b", "absent": None}
    pages = spark.createDataFrame([("1", "q", [("T", "x"), ("U", " ")], "a", ["a", "b"])], "id string, question string, pages array<struct<title:string,text:string>>, answer string, aliases array<string>")
    row = trials.entity_pages(pages).first()
    assert (row["context"], row["all_answers"]) == (["T: x"], ["a", "b"])
    root = f"{tmp_path}/run"
    sinks.write_campaign(spark.createDataFrame([("k", "d", 0, 1.0)], "row_key string, dataset string, window int, x double"), root, good)
    found = trials.tree_findings(spark, root, spark.createDataFrame([("k", "d", 1)], "row_key string, dataset string, window int"))
    assert sorted((r["window"], r["finding"]) for r in found.collect()) == [(0, "EXTRA"), (1, "MISSING")]


def test_every_oracle_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(catalog.queries()) > 100
