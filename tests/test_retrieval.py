import math

import pytest
from pyspark.sql import functions as F

from meridia.operators import retrieval as rt
from meridia.sources import sinks

CORPUS = ["apple banana apple", "banana cherry", "cherry cherry cherry durian"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k + 1, t) for k, t in enumerate(CORPUS)], "doc_id bigint, text string")


def _ask(spark, docs, query, k=5):
    q = spark.createDataFrame([(0, query)], "query_id bigint, query string")
    return [(r["doc_id"], r["score"]) for r in rt.bm25_search(q, docs, k=k).orderBy("rank").collect()]


def test_bm25_scores_and_order(spark, docs):
    assert _ask(spark, docs, "apple") == [(1, pytest.approx(1.401184, abs=1e-6))]
    assert [d for d, _ in _ask(spark, docs, "cherry")] == [3, 2]
    assert _ask(spark, docs, "banana cherry")[0][0] == 2 and _ask(spark, docs, "unseen") == [] and _ask(spark, docs, "") == []
    assert _ask(spark, docs, "cherry cherry") == _ask(spark, docs, "cherry")


def test_bm25_ties_go_by_id(spark):
    same = spark.createDataFrame([(9, "x y"), (3, "x y"), (5, "x z")], "doc_id bigint, text string")
    assert [d for d, _ in _ask(spark, same, "x")] == [3, 5, 9]


def test_index_saves_loads_and_rebuilds(spark, docs, tmp_path):
    path = f"{tmp_path}/index"
    meta, built = sinks.ensure_index(docs, path)
    assert built and not sinks.ensure_index(docs, path)[1]
    postings, meta = sinks.load_index(spark, path)
    q = spark.createDataFrame([(0, "cherry banana")], "query_id bigint, query string")
    assert sinks.search_index(q, postings, meta, k=3).collect() == rt.bm25_search(q, docs, k=3).collect()
    with pytest.raises(ValueError, match="other parameters"):
        sinks.load_index(spark, path, k1=2.0)
    assert sinks.ensure_index(docs.filter("doc_id > 1"), path)[1]


def test_rrf(spark):
    rows = [("a", 1, "d1"), ("b", 2, "d1"), ("a", 2, "d2"), ("a", 3, "d3"), ("b", 1, "d3"), ("b", 4, "d3")]
    fused = rt.rrf(spark.createDataFrame([(0, s, r, d) for s, r, d in rows], "query_id int, source string, rank int, doc_id string")).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in fused] == [("d1", pytest.approx(1 / 61 + 1 / 62)), ("d3", pytest.approx(1 / 63 + 1 / 61)), ("d2", pytest.approx(1 / 62))]


def test_stages_and_metrics(spark):
    qrels = spark.createDataFrame([("q1", "d1", 1), ("q2", "d4", 1), ("q3", "d7", 1)], "query_id string, doc_id string, rel int")

    def run(lists):
        return spark.createDataFrame([(q, d, k + 1) for q, ds in lists.items() for k, d in enumerate(ds)], "query_id string, doc_id string, rank int")

    mean = lambda lists, k: rt.mean_metrics(rt.retrieval_metrics(qrels, run(lists), k)).first()
    assert mean({"q1": ["d9", "d1", "d2"], "q2": ["d4", "d5"], "q3": ["d8", "d7"]}, 100)["recall"] == 1
    best = mean({"q1": ["d1", "d9"], "q2": ["d4"], "q3": ["d7", "d8"]}, 10)
    assert (best["mrr"], best["ndcg"]) == (1, 1)
    assert mean({"q1": ["d1"], "q2": ["d4"], "q3": ["d8"]}, 5)["recall"] == pytest.approx(2 / 3)
    both = qrels.union(spark.createDataFrame([("q1", "d2", 2)], qrels.schema))
    got = {r["query_id"]: r for r in rt.retrieval_metrics(both, run({"q1": ["d1", "d3"]}), 2).collect()}
    assert not got["q1"]["complete"] and got["q1"]["recall"] == 0.5 and got["q2"]["rr"] == 0
    assert got["q1"]["ndcg"] == pytest.approx(1 / (2 + 1 / math.log2(3)))


def test_gold_rank(spark):
    def rank(gold, hits, gold_texts=None, hit_texts=None):
        arr = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        e = rt.gold_rank(arr(gold), arr(hits), None if gold_texts is None else arr(gold_texts), None if hit_texts is None else arr(hit_texts))
        return spark.range(1).select(e.alias("r")).first()["r"]

    assert [rank("ab", "ax"), rank("ab", "xba"), rank("ab", "xy"), rank("", "ab")] == [1, 2, None, None]
    assert rank([], ["h1", "h2"], ["The  Gold text"], ["nothing", "here the gold TEXT is"]) == 2
    assert rank(["z"], ["h1"], ["gold"], ["gold"]) == 1


def test_dense_blocks_and_ties(spark):
    vectors = spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(12)], "vec_id bigint, embedding array<float>")
    queries = vectors.filter("vec_id < 4").selectExpr("vec_id AS query_id", "embedding AS query")
    one = rt.dense_search(queries, vectors, k=4, doc_id="vec_id").orderBy("query_id", "rank").collect()
    many = rt.dense_search(queries, vectors, k=4, doc_id="vec_id", block_bytes=20).orderBy("query_id", "rank").collect()
    assert one == many and [r["doc_id"] for r in one if r["query_id"] == 2] == [2, 5, 8, 11]


def test_corpus_distractors_and_packing(spark):
    pool = spark.createDataFrame([(0, "a b"), (1, ""), (2, "a b"), (3, "c d e"), (4, None), (5, "f")], "at bigint, text string")
    assert rt.corpus(pool, order="at").count() == 3
    first = rt.corpus_fingerprint(rt.corpus(pool, order="at")).first()
    assert first == rt.corpus_fingerprint(rt.corpus(pool, order="at").repartition(3)).first() and first["n_docs"] == 3
    deep = [rt.corpus_fingerprint(pool.filter("text <> ''").repartition(k), "at", most=n).first() for k, n in ((1, 1), (4, 1))]
    assert deep[0] == deep[1] and deep[0]["n_docs"] == 4
    picked = rt.distractors(pool, pool.filter("at = 3"), 5, order="at").collect()
    assert [r["text"] for r in picked] == ["a b", "f"]
    assert [r["total"] for r in rt.packed(pool, 6, order="at").orderBy("total").collect()] == [2, 6]
    assert [r["total"] for r in rt.packed(pool, 5, order="at").orderBy("total").collect()] == [2]


def test_resolve_refuses_unknown(spark, docs):
    hits = spark.createDataFrame([(0, 1, 1), (0, 99, 2)], "query_id int, doc_id bigint, rank int")
    assert rt.resolve(hits.filter("doc_id = 1"), docs).first()["text"] == CORPUS[0]
    with pytest.raises(Exception, match="unknown document 99"):
        rt.resolve(hits, docs).collect()


def test_rerank_keeps_former_rank_on_ties(spark):
    hits = spark.createDataFrame([(0, "a", 3.0, 1), (0, "b", 2.0, 2), (0, "c", 1.0, 3)], "query_id int, doc_id string, score double, rank int")
    pairs = spark.createDataFrame([(0, "a", 0.1), (0, "b", 0.9), (0, "c", 0.9)], "query_id int, doc_id string, pair_score double")
    stages = rt.staged(hits.join(pairs, ["query_id", "doc_id"]), served_k=2, pair_score="pair_score").orderBy("stage", "rank").collect()
    assert [(r["stage"], r["doc_id"]) for r in stages] == [("pool", "a"), ("pool", "b"), ("pool", "c"), ("reranked", "b"), ("reranked", "c"), ("reranked", "a"), ("served", "b"), ("served", "c")]
