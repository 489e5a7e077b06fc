"""Registration gates, predicate trees, draws, numbering, and functions that no query calls."""

import hashlib

import pytest
from pyspark.sql import functions as F

from meridia.operators import campaign as cp
from meridia.operators import inference as st
from meridia.operators import integrity as ig
from meridia.operators import results as rs
from meridia.operators import retrieval as rt
from meridia.operators import serving as sv
from meridia.sources import trials

TEXT = "alpha 0.05, two metrics"
REGISTERED = {"sha256": hashlib.sha256(TEXT.encode()).hexdigest(), "alpha": 0.05, "metrics": ["f1", "goodput"], "margins": {"f1": 0.02}}
USED = {"alpha": 0.05, "metrics": ["goodput", "f1"], "equivalence_metric": "f1", "margin": None}


@pytest.mark.parametrize(
    ("registered", "used", "text", "reason"),
    [({}, {}, TEXT, None), ({}, {"margin": 0.02}, TEXT, None), ({}, {"equivalence_metric": None}, TEXT, None), ({}, {}, TEXT + " ", "differs"), ({"sha256": "main"}, {}, TEXT, "no SHA-256"), ({}, {"alpha": 0.1}, TEXT, "alpha"),
     ({}, {"metrics": ["f1"]}, TEXT, "metrics"), ({}, {"margin": 0.03}, TEXT, "margin is not"), ({}, {"equivalence_metric": "goodput"}, TEXT, "no margin"), ({}, {"equivalence_metric": None, "margin": 0.02}, TEXT, "without its metric")],
)
def test_registration_gates(registered, used, text, reason):
    found = cp.registration_gates(REGISTERED | registered, USED | used, text=text)
    assert (found == []) if reason is None else (len(found) == 1 and reason in found[0])
    assert cp.registered_margin(REGISTERED, USED) == 0.02 and cp.registered_margin(REGISTERED, {}) is None


def test_predicate_trees(spark):
    ledgers = spark.createDataFrame([("r1", "aa"), ("r2", "bb"), ("r3", "cc")], "run string, sha256 string")
    kind = "run string, tree string, raw_sha256 string, own_sha256 string, sealed_sha256 string"
    good = [("r1", "t1", "aa", "x", "x")]
    ask = lambda rows, **o: {r["run"]: r["tree"] for r in cp.resolve_predicates(spark.createDataFrame(rows, kind), ledgers, **o).collect()}
    assert ask(good) == {"r1": "t1", "r2": None, "r3": None}
    for rows, options, why in (([*good, ("r1", "t2", "aa", "x", "x")], {}, "several"), ([("r2", "t", "aa", "x", "x")], {}, "other evidence"), ([("r2", "t", "bb", "x", "y")], {}, "seal"), ([("r2", "t", "bb", "x", None)], {}, "seal"), (good, {"wanted": "t9"}, "no such")):
        with pytest.raises(Exception, match=why):
            ask(rows, **options)
    every = [(r, t, s, "x", "x") for r, s in (("r1", "aa"), ("r2", "bb"), ("r3", "cc")) for t in ("t1", "t2")]
    assert ask(every, wanted="t2") == {"r1": "t2", "r2": "t2", "r3": "t2"}


def test_draws_are_keyed_disjoint_and_repeatable():
    pool = [f"q{k}" for k in range(40)]
    cut, disjoint = cp._draws(pool, 10, 4, 7)
    assert disjoint and sorted(x for t in cut.values() for x in t) == sorted(pool)
    assert cp._draws(list(reversed(pool)), 10, 4, 7)[0] == cut and cp._draws(pool, 10, 4, 8)[0] != cut
    more, disjoint = cp._draws(pool, 30, 3, 7)
    assert not disjoint and all(len(set(t)) == 30 for t in more.values()) and len({tuple(t) for t in more.values()}) == 3


@pytest.mark.parametrize("by", [[], ["g"]])
def test_numbers_run_through_ranges(spark, by):
    rows = [(None if k % 3 == 2 else k % 3, (k * 37) % 101, k) for k in range(300)]
    found = rs.numbered(spark.createDataFrame(rows, "g int, x int, id int").repartition(5), by, ["x", "id"], "n").collect()
    groups = {}
    for r in found:
        groups.setdefault(r["g"] if by else 0, []).append((r["n"], r["x"], r["id"]))
    for own in groups.values():
        own.sort()
        assert [n for n, _, _ in own] == list(range(1, len(own) + 1)) and [(x, i) for _, x, i in own] == sorted((x, i) for _, x, i in own)
    assert rs.numbered(spark.createDataFrame([], "g int, x int, id int"), by, ["x"], "n").count() == 0


def test_keep_last_has_no_arbitrary_ties(spark):
    rows = [(1, 5, "a"), (1, 5, "b"), (1, 4, "c"), (2, 1, None)]
    for seed in range(3):
        df = spark.createDataFrame(rows, "k int, at int, x string").orderBy(F.rand(seed)).repartition(3)
        assert sorted((r["k"], r["x"], r["n_dropped"]) for r in ig.keep_last(df, ["k"], "at").collect()) == [(1, "b", 2), (2, None, 0)]


def test_split_half_refuses_what_is_too_large(spark, monkeypatch):
    monkeypatch.setattr(st, "MOST_VALUES", 5)
    with pytest.raises(ValueError, match="too many"):
        st.split_half(spark.range(6).withColumnRenamed("id", "value"), splits=2, seed=1)


def test_code_sets(spark):
    one = trials.human_eval(spark.createDataFrame([("HumanEval/0", "def f():\n", "  return 1\n", "assert f() == 1", "f")], "task_id string, prompt string, canonical_solution string, test string, entry_point string")).first()
    assert (one["id"], one["context"], one["answer"], one["entry_point"], one["test_code"]) == ("HumanEval/0", ["def f():\n"], "  return 1\n", "f", "assert f() == 1") and one["question"].endswith("def f():\n")
    rows = trials.mbpp(spark.createDataFrame([(2, "add two", "x", ["t1", "t2"]), (3, None, "y", None)], "task_id int, text string, code string, test_list array<string>")).orderBy("id").collect()
    assert rows[0]["context"] == ["Test cases:\nt1\nt2"] and rows[0]["id"] == "2" and rows[1]["context"] == [] and rows[1]["test_list"] == []
    raw = spark.createDataFrame([("x", "cuda"), ("y", "mpi")], "id string, category string")
    assert [r["id"] for r in trials.by_category(raw, "mpi").collect()] == ["y"]


def test_names_and_masks(spark):
    df = spark.createDataFrame([("run-squad_v2-3", "TRUE"), ("a-nq", "0"), ("none", "x")], "name string, flag string")
    assert [r["d"] for r in df.select(cp.dataset_of(F.col("name")).alias("d")).collect()] == ["squad_v2", "nq", None]
    assert [r["m"] for r in df.select(cp.event_mask(F.col("flag")).alias("m")).collect()] == [1.0, 0.0, None]


def test_overlap_and_metrics_by_label(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a"), (3, None), (4, "a b")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(7, "b A a"), (8, "z"), (9, None)], "query_id bigint, query string")
    for size in (1, 8 << 20):
        found = rt.overlap_search(asked, docs, k=2, block_bytes=size).collect()
        assert [(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in sorted(found, key=lambda r: r["rank"])] == [(7, 1, 2.0, 1), (7, 4, 2.0, 2)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id bigint, label int")
    run = spark.createDataFrame([(0, 3, 1), (0, 2, 2), (0, 4, 3), (1, 0, 1)], "query_id bigint, doc_id bigint, rank int")
    queries = spark.createDataFrame([(0, 0), (1, 1)], "query_id bigint, label int")
    pairs = queries.join(labels, "label").filter("query_id <> doc_id").select("query_id", "doc_id", F.lit(1).alias("rel"))
    by_label = {r["query_id"]: r for r in rt.metrics_by_label(queries, labels, run, 3).collect()}
    for r in rt.retrieval_metrics(pairs, run, 3).collect():
        assert all(abs(float(r[c]) - float(by_label[r["query_id"]][c])) < 1e-12 for c in ("n_relevant", "recall", "ndcg", "rr", "complete"))


def test_serving_times(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 2.5), (2, 10.0)], "w int, arrival_s double")
    assert sorted(tuple(r) for r in sv.arrival_span(df, "w").collect()) == [(1, 2.5), (2, 0.0)]
    times = spark.createDataFrame([(1.0, 1.5, 2.0, 4.0)], "a double, b double, c double, d double")
    found = sv.dispatch_latencies(*map(F.col, "abcd"))
    assert times.select(*[c.alias(n) for n, c in found.items()]).first().asDict() == {"lag_s": 0.5, "latency_s": 3.0, "ttft_s": 1.0, "send_latency_s": 2.5, "send_ttft_s": 0.5}
    assert sv.rate_ladder(2.0, factor=2.0, steps=3) == [2.0, 4.0, 8.0]
    with pytest.raises(ValueError, match="ladder"):
        sv.rate_ladder(0.0)
