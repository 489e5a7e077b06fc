"""Retrieval queries over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import text as tx
from meridia.operators import retrieval as rt
from meridia.session import spread, table

K = 10


def _search(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rt.bm25_search(queries, spread(table(spark, sf_dir, "documents").select("doc_id", "text")), k=k)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25_idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.bm25_terms(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("term", "df", F.round("idf", 9).alias("idf"))


def bm25_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.bm25_stats(table(spark, sf_dir, "documents")).select("n_docs", F.round("avgdl", 9).alias("avgdl"))


def _dense(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """Queries: every vector whose id is divisible by 20, against all."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return rt.dense_search(queries, vectors, k=k, doc_id="vec_id")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same label, another vector: relevant."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    run = rt.top_k(_dense(spark, sf_dir, K + 1).filter("query_id <> doc_id"), K)
    return rt.metrics_by_label(queries, vectors.withColumnRenamed("vec_id", "doc_id"), run, K).select("query_id", "n_relevant", *[F.round(c, 9).alias(c) for c in ("recall", "ndcg", "rr")], "complete")


def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = rt.mean_metrics(retrieval_metrics(spark, sf_dir))
    return means.select("n_queries", *[F.round(c, 6).alias(c) for c in ("recall", "ndcg", "mrr", "complete_evidence")])


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    bm25 = _search(spark, sf_dir).select("query_id", F.lit("bm25").alias("source"), "doc_id", "rank")
    overlap = _overlap(spark, sf_dir).select("query_id", F.lit("overlap").alias("source"), "doc_id", "rank")
    return bm25.unionByName(overlap)


def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared distinct terms, the k best documents."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rt.overlap_search(queries, spread(table(spark, sf_dir, "documents").select("doc_id", "text")), k=K)


def rrf_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.rrf(_sources(spark, sf_dir), top=K).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank", F.size("trace").cast("bigint").alias("n_sources"))


def stage_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool by BM25, reranked by Jaccard overlap of the texts, five served."""
    pool = _search(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("doc_text"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item_text"))
    pairs = pool.join(docs, "doc_id").join(items, "query_id")
    one, two = F.array_distinct(tx.bm25_tokens("doc_text")), F.array_distinct(tx.bm25_tokens("item_text"))
    pairs = pairs.select("query_id", "doc_id", "score", "rank", F.round(F.size(F.array_intersect(one, two)) / F.size(F.array_union(one, two)), 9).alias("pair_score"))
    return rt.staged(pairs, served_k=5, pair_score="pair_score").select("stage", "query_id", "doc_id", "rank")


def corpus_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rt.corpus(table(spark, sf_dir, "documents"), order="doc_id")
    return docs.select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.corpus_fingerprint(rt.corpus(table(spark, sf_dir, "documents"), order="doc_id"))


def hit_rate_and_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold of an item: documents that hold its whole normalized text."""
    hits = _search(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    ranked = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "text"))).alias("hits"))  # k at most
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("gold"))
    rank = rt.gold_rank(F.array().cast("array<bigint>"), F.col("hits.doc_id"), F.array("gold"), F.col("hits.text"))
    found = items.join(ranked, "query_id", "left").select("query_id", rank.alias("rank"))
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), F.col("rank").isNotNull().cast("double").alias("hit"), F.round(F.coalesce(1 / F.col("rank"), F.lit(0.0)), 9).alias("rr"))


def distractor_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rt.distractors(docs.filter("lang = 'en'"), docs.filter("lang = 'en' AND source = 'src0'"), 50, order="doc_id").select("doc_id", F.col("_order").alias("first_doc"))


def corpus_block_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.packed(table(spark, sf_dir, "documents"), 20_000, order="doc_id").select("doc_id", F.col("_order").alias("first_doc"), "tokens", "total")


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_idf_table, bm25_index_stats, dense_topk, retrieval_metrics, retrieval_summary, rrf_fused, stage_ranks, corpus_dedup, corpus_fingerprint, hit_rate_and_rank, distractor_select, corpus_block_pack)}

_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\x1c-\x1f\x{{85}}\x{{a0}}\x{{2028}}\x{{2029}}\x{{3000}}]+'), lambda w: w <> '')".replace("{{", "{").replace("}}", "}")
_NORMAL = f"array_to_string({_TOKENS}, ' ')"

_BM25 = f"""
d AS (SELECT doc_id, {_TOKENS} AS tokens FROM documents),
stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d),
postings AS (SELECT doc_id, term, len(tokens) AS dl, count(*) AS tf FROM (SELECT doc_id, tokens, unnest(tokens) AS term FROM d) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark),
scored AS (
  SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
  FROM asked JOIN postings USING (term) JOIN dfs USING (term), stats GROUP BY ALL
),
bm25 AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10)
"""
_DENSE = """
hits AS (
  SELECT q.vec_id AS query_id, v.vec_id AS doc_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0
),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hits)
"""
_METRICS = f"""
{_DENSE},
run AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense WHERE rank <= 11 AND query_id <> doc_id),
qrels AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id FROM embeddings q JOIN embeddings v USING (label) WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
best AS (SELECT query_id, count(*) AS n_relevant, (SELECT sum(1 / log2(r + 1)) FROM range(1, 11) t(r) WHERE r <= count(qrels.doc_id)) AS ideal FROM qrels GROUP BY query_id),
found AS (SELECT query_id, count(*) AS found, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first FROM run JOIN qrels USING (query_id, doc_id) WHERE rank <= 10 GROUP BY query_id),
by_query AS (
  SELECT query_id, n_relevant, round(coalesce(found, 0) / n_relevant, 9) AS recall, round(coalesce(dcg, 0) / ideal, 9) AS ndcg,
    round(coalesce(1 / first, 0), 9) AS rr, coalesce(found, 0) = n_relevant AS complete
  FROM best LEFT JOIN found USING (query_id)
)
"""
_OVERLAP = f"""
overlap AS (
  SELECT * FROM (
    SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS rank
    FROM (SELECT query_id, doc_id, count(*) AS n FROM asked JOIN postings USING (term) GROUP BY ALL)
  ) WHERE rank <= 10
)
"""

ORACLE = {
    "bm25_topk": f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM bm25",
    "bm25_idf_table": f"WITH {_BM25} SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 9) AS idf FROM dfs, stats",
    "bm25_index_stats": f"WITH {_BM25} SELECT n AS n_docs, round(avgdl, 9) AS avgdl FROM stats",
    "dense_topk": f"WITH {_DENSE} SELECT query_id, doc_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM dense WHERE rank <= 10",
    "retrieval_metrics": f"WITH {_METRICS} SELECT * FROM by_query",
    "retrieval_summary": f"WITH {_METRICS} SELECT count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, CASE WHEN max(n_relevant) = 1 THEN round(avg(rr), 6) END AS mrr, round(avg(complete::INT), 6) AS complete_evidence FROM by_query",
    "rrf_fused": f"""
WITH {_BM25}, {_OVERLAP},
ranks AS (SELECT query_id, doc_id, rank FROM bm25 UNION ALL SELECT query_id, doc_id, rank FROM overlap),
fused AS (SELECT query_id, doc_id, sum(1::DOUBLE / (60 + rank)) AS score, count(*) AS n_sources FROM ranks GROUP BY ALL)
SELECT query_id, doc_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank, n_sources
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM fused) WHERE rank <= 10
""",
    "stage_ranks": f"""
WITH {_BM25},
pairs AS (
  SELECT query_id, bm25.doc_id, rank, round(len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q))), 9) AS pair_score
  FROM bm25 JOIN (SELECT doc_id, list_distinct(tokens) AS t FROM d) USING (doc_id)
  JOIN (SELECT query_id, list(term) AS q FROM asked GROUP BY query_id) USING (query_id)
),
again AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY pair_score DESC, rank) AS rank FROM pairs)
SELECT stage, query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT 'pool' AS stage, query_id, doc_id, rank FROM bm25
  UNION ALL SELECT 'reranked', query_id, doc_id, rank FROM again UNION ALL SELECT 'served', query_id, doc_id, rank FROM again WHERE rank <= 5
)
""",
    "corpus_dedup": "SELECT sha1(text) AS doc_id, CAST(any_value(length(text)) AS BIGINT) AS n_chars FROM documents WHERE text <> '' GROUP BY sha1(text)",
    "corpus_fingerprint": """
WITH ids AS (SELECT DISTINCT sha1(text) AS id FROM documents WHERE text <> ''),
folded AS (SELECT sha1(id)[1:3] AS g, sha1(string_agg(id, chr(10) ORDER BY id)) AS h, count(*) AS n FROM ids GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_docs, sha1(string_agg(h, chr(10) ORDER BY g)) AS fingerprint FROM folded
""",
    "hit_rate_and_rank": f"""
WITH {_BM25},
normal AS (SELECT doc_id, {_NORMAL} AS said FROM documents),
golds AS (SELECT item_id AS query_id, {_NORMAL} AS gold FROM benchmark),
found AS (SELECT query_id, min(rank) AS rank FROM bm25 JOIN normal USING (doc_id) JOIN golds USING (query_id) WHERE said <> '' AND gold <> '' AND (contains(said, gold) OR contains(gold, said)) GROUP BY query_id)
SELECT query_id, rank, CASE WHEN rank IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS hit, round(coalesce(1 / rank, 0), 9) AS rr FROM golds LEFT JOIN found USING (query_id)
""",
    "distractor_select": """
SELECT id AS doc_id, min(doc_id) AS first_doc FROM (SELECT sha1(text) AS id, doc_id FROM documents WHERE lang = 'en' AND text <> '')
WHERE id NOT IN (SELECT sha1(text) FROM documents WHERE lang = 'en' AND source = 'src0') GROUP BY id ORDER BY first_doc, id LIMIT 50
""",
    "corpus_block_pack": f"""
WITH p AS (
  SELECT sha1(text) AS doc_id, min(doc_id) AS first_doc, CAST(any_value(len({_TOKENS})) * 4 // 3 AS BIGINT) AS tokens
  FROM documents WHERE text <> '' GROUP BY sha1(text)
)
SELECT * FROM (SELECT doc_id, first_doc, tokens, CAST(sum(tokens) OVER (ORDER BY first_doc, doc_id) AS BIGINT) AS total FROM p WHERE tokens > 0) WHERE total <= 20000
""",
}
