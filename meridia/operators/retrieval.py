"""Retrieval: corpora, inverted index, dense search, fusion, stages, metrics.

Rankings are DataFrames (query_id, doc_id, score, rank). Every order is total:
score descending, then doc_id ascending. A query set is stated by the caller and
joins by term, so nothing is crossed but vectors, which go block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import text as tx

K1, B = 1.5, 0.75
RRF_K = 60
#: Most bytes of query vectors that are broadcast at once.
VECTOR_BYTES = 64 << 20
#: Most bytes of query terms that are broadcast at once, and most scores (documents by queries) held at once.
QUERY_BYTES, SCORES = 8 << 20, 1 << 22


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row of every key: the first in `order`. A partial aggregate, so a hot key doesn't meet in one task."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*key).agg(first).select(*key, "_first.*").select(*df.columns)


def corpus(passages: DataFrame, *, order: str, text: str = "text") -> DataFrame:
    """Distinct non-empty passages by content id, the first kept: doc_id, text."""
    own = passages.filter(tx.text(text) != "").select(tx.stable_id(text).alias("doc_id"), F.col(text).alias("text"), F.col(order).alias("_order"))
    return own.groupBy("doc_id").agg(F.min_by("text", "_order").alias("text"))


def corpus_fingerprint(docs: DataFrame, doc_id: str = "doc_id", *, most: int = 10_000) -> DataFrame:
    """n_docs and a digest that doesn't depend on order.

    A tree of digests: sorted ids are folded by the leading digits of their hash,
    these digests by fewer digits, and so on, 4096 to one. The more ids, the more
    digits, so no task gathers more than about `most` ids.
    """
    digits, n = 3, docs.count()
    while n > most * 16**digits:
        digits += 3
    own = docs.select(F.col(doc_id).cast("string").alias("x")).withColumn("g", F.substring(F.sha1("x"), 1, digits))
    folded = own.groupBy("g").agg(F.sha1(F.array_join(F.sort_array(F.collect_list("x")), "\n")).alias("h"), F.count("*").alias("n"))
    digest = F.sha1(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), "\n"))
    while digits > 3:
        digits -= 3
        folded = folded.groupBy(F.substring("g", 1, digits).alias("p")).agg(digest.alias("h"), F.sum("n").alias("n")).withColumnRenamed("p", "g")
    return folded.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), digest.alias("fingerprint"))


def bm25_postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """term, doc_id, tf, dl: one row for each term of each document."""
    tokens = docs.select(F.col(doc_id).alias("doc_id"), tx.bm25_tokens(text).alias("_tokens"))
    tokens = tokens.withColumn("dl", F.size("_tokens").cast("bigint"))
    return tokens.select("doc_id", "dl", F.explode("_tokens").alias("term")).groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf")).select("term", "doc_id", "tf", "dl")


def bm25_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """n_docs and avgdl over all documents, empty ones included: one row."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(tx.bm25_tokens(text))).alias("avgdl"))


def idf(df: F.Column, n: F.Column) -> F.Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_terms(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """term, df, idf."""
    n = docs.agg(F.count("*").alias("n_docs"))
    counted = docs.select(F.explode(F.array_distinct(tx.bm25_tokens(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counted.join(F.broadcast(n)).select("term", "df", idf(F.col("df"), F.col("n_docs")).alias("idf"))


def bm25_search(queries: DataFrame, docs: DataFrame, *, k: int, k1: float = K1, b: float = B, query_id: str = "query_id", query: str = "query", doc_id: str = "doc_id", text: str = "text", block_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k best documents of every query: query_id, doc_id, score, rank.

    One pass over the documents counts the queries' terms, another scores; no
    posting and no pair is shuffled, only k rows of each task for each query.
    """

    def weigh(tf, dl, term, df, n_docs, avgdl):
        rarity = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        return rarity[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))

    return _term_search(queries, docs, k, weigh, (query_id, query, doc_id, text), block_bytes)


def overlap_search(queries: DataFrame, docs: DataFrame, *, k: int, query_id: str = "query_id", query: str = "query", doc_id: str = "doc_id", text: str = "text", block_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k documents that share the most distinct terms with each query."""
    return _term_search(queries, docs, k, None, (query_id, query, doc_id, text), block_bytes)


class _Asked:
    """A block of queries: their ids, their distinct terms, and which queries ask for each term."""

    def __init__(self, rows: list):
        self.ids = [r[0] for r in rows]
        number = {t: k for k, t in enumerate(sorted({t for r in rows for t in r[1]}))}
        self.terms = list(number)
        pairs = sorted((number[t], q) for q, r in enumerate(rows) for t in r[1])
        self.owners = np.array([q for _, q in pairs], dtype=np.int64)
        self.many = np.bincount([t for t, _ in pairs], minlength=len(number)) if pairs else np.zeros(len(number), dtype=np.int64)
        self.first = np.cumsum(self.many) - self.many

    def postings(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and count of the asked terms in a batch, and every row's length."""
        dl = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = pc.fill_null(pc.index_in(tokens.flatten(), value_set=pa.array(self.terms, pa.string())), -1).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(dl)), dl)[at >= 0]
        keys, tf = np.unique(rows * max(1, len(self.terms)) + at[at >= 0], return_counts=True)
        row, term = np.divmod(keys, max(1, len(self.terms)))
        return row, term, tf, dl


def _term_search(queries: DataFrame, docs: DataFrame, k: int, weigh, names: tuple[str, str, str, str], block_bytes: int) -> DataFrame:
    """Documents by summed weights of the terms they share with a query; queries go out in blocks of a checked size."""
    query_id, query, doc_id, text = names
    spark = queries.sparkSession
    asked = queries.select(F.col(query_id).alias("query_id"), F.array_distinct(tx.bm25_tokens(query)).alias("terms"))
    size = asked.agg(F.sum(F.octet_length(F.array_join("terms", " ")) + 16).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    own = docs.select(F.col(doc_id).alias("doc_id"), tx.bm25_tokens(text).alias("tokens"))
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, doc_id {own.schema['doc_id'].dataType.simpleString()}, score double"
    found = None
    for block in range(blocks):
        sent = spark.sparkContext.broadcast(_Asked((asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else asked).collect()))
        stats = _term_stats(own, sent) if weigh else None
        part = own.mapInArrow(_scorer(sent, stats, weigh, k, schema), schema)
        found = part if found is None else found.unionByName(part)
    return top_k(found, k)


def _term_stats(own: DataFrame, sent: Broadcast) -> tuple[np.ndarray, int, float]:
    """How many documents have each asked term; how many there are, and their mean length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, n, length = sent.value, 0, 0
        df = np.zeros(len(asked.terms), dtype=np.int64)
        for batch in batches:
            _, term, _, dl = asked.postings(batch.column("tokens"))
            df += np.bincount(term, minlength=len(df))
            n, length = n + len(dl), length + int(dl.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()], pa.int32()), pa.array([length, n, *df[at].tolist()], pa.int64())], names=["term", "n"])

    totals = {r["term"]: r["n"] for r in own.select("tokens").mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    df = np.array([totals.get(t, 0) for t in range(len(sent.value.terms))], dtype=np.float64)
    n = totals.get(-1, 0)
    return df, n, totals.get(-2, 0) / n if n else 0.0


def _scorer(sent: Broadcast, stats, weigh, k: int, schema: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        wide = len(asked.ids)
        best: list[list[tuple]] = [[] for _ in asked.ids]
        rows = max(1, SCORES // max(1, wide))
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            row, term, tf, dl = asked.postings(batch.column("tokens"))
            if not len(row):
                continue
            weight = np.ones(len(row)) if weigh is None else weigh(tf, dl[row], term, *stats)
            many = asked.many[term]
            pair = np.arange(int(many.sum())) + np.repeat(asked.first[term] - (np.cumsum(many) - many), many)
            cell = np.repeat(row, many) * wide + asked.owners[pair]
            # sums of doubles depend on their order: round, so that ties are ties
            scores = np.round(np.bincount(cell, weights=np.repeat(weight, many), minlength=batch.num_rows * wide), 9).reshape(-1, wide)
            docs = batch.column("doc_id").to_pylist()
            for q in range(wide):
                own = scores[:, q]
                edge = best[q][-1][0] if len(best[q]) == k else 0.0
                at = np.flatnonzero((own > 0) & (own >= -edge))
                if len(at) > k:
                    at = at[own[at] >= np.partition(own[at], len(at) - k)[len(at) - k]]
                if len(at):
                    best[q] = sorted([*best[q], *((-float(own[j]), docs[j]) for j in at)])[:k]
        flat = [(asked.ids[q], doc, -score) for q, kept in enumerate(best) for score, doc in kept]
        yield pa.RecordBatch.from_pylist([dict(zip(("query_id", "doc_id", "score"), x)) for x in flat], schema=_types(schema))

    return run


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of every query; Spark prunes each task's rows to k before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def dense_search(queries: DataFrame, vectors: DataFrame, *, k: int, query_id: str = "query_id", query: str = "query", doc_id: str = "doc_id", vector: str = "embedding", normalize: bool = False, block_bytes: int = VECTOR_BYTES) -> DataFrame:
    """The k vectors of greatest inner product (double) for every stated query.

    Query vectors go out in blocks of a checked size; each task keeps k of its
    rows for each query, so what is shuffled is queries x tasks x k rows.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query).alias("query"))
    size = asked.agg(F.sum(8 * F.size("query")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, doc_id {vectors.schema[doc_id].dataType.simpleString()}, score double"
    found = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow() if blocks > 1 else asked.toArrow()
        sent = spark.sparkContext.broadcast((rows["query_id"].to_pylist(), _matrix(rows["query"], normalize)))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            best: list[list[tuple]] = [[] for _ in ids]
            for batch in batches:
                if not batch.num_rows or not ids:
                    continue
                docs = batch.column("doc_id").to_pylist()
                scores = matrix @ _matrix(batch.column("vector"), normalize).T
                for q, row in enumerate(scores):
                    at = np.argpartition(-row, min(k, len(row)) - 1)[:k] if len(row) > k else np.arange(len(row))
                    edge = row[at].min()
                    at = np.flatnonzero(row >= edge)  # ties at the edge are settled by doc_id
                    best[q] = sorted([*best[q], *((-float(row[j]), docs[j]) for j in at)])[:k]
            flat = [(ids[q], doc, -score) for q, kept in enumerate(best) for score, doc in kept]
            yield pa.RecordBatch.from_pylist([dict(zip(("query_id", "doc_id", "score"), x)) for x in flat], schema=_types(schema))

        part = vectors.select(F.col(doc_id).alias("doc_id"), F.col(vector).alias("vector")).mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    return top_k(found, k)


def _types(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])


def _matrix(column, normalize: bool) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    matrix = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300) if normalize else matrix


def rrf(rankings: DataFrame, *, k: int = RRF_K, top: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, source, doc_id, rank); a document counts once in each source, at its best rank."""
    best = rankings.groupBy("query_id", "source", "doc_id").agg(F.min("rank").alias("rank"))
    share = 1 / (F.lit(float(k)) + F.col("rank"))
    trace = F.sort_array(F.collect_list(F.struct("source", "rank", share.alias("contribution"))))  # as many as there are sources
    fused = best.groupBy("query_id", "doc_id").agg(trace.alias("trace"))
    fused = fused.withColumn("score", F.round(F.aggregate("trace", F.lit(0.0), lambda s, x: s + x["contribution"]), 12))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = fused.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def rerank(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hits ordered anew by a pair score (query_id, doc_id, pair_score); the former rank settles ties."""
    joined = hits.join(pairs, ["query_id", "doc_id"])
    order = Window.partitionBy("query_id").orderBy(F.desc("pair_score"), "rank")
    return joined.select("query_id", "doc_id", F.col("pair_score").alias("score"), F.row_number().over(order).alias("rank"))


def staged(pool: DataFrame, *, served_k: int, pair_score: str | None = None) -> DataFrame:
    """stage, query_id, doc_id, score, rank for pool, reranked (by a column of the pool, if one is named) and served.

    One pass over the pool: every hit says in which stages it is. A hit without a
    pair score is in the pool alone; former ranks settle ties.
    """
    stage = lambda name, score, rank: F.struct(F.lit(name).alias("stage"), score.cast("double").alias("score"), rank.cast("int").alias("rank"))
    own, stages = pool, [stage("pool", F.col("score"), F.col("rank"))]
    score, rank = F.col("score"), F.col("rank")
    if pair_score is not None:
        order = Window.partitionBy("query_id").orderBy(F.col(pair_score).desc_nulls_last(), "rank")
        own = pool.withColumn("_again", F.when(F.col(pair_score).isNotNull(), F.row_number().over(order)))
        score, rank = F.col(pair_score), F.col("_again")
        stages.append(F.when(rank.isNotNull(), stage("reranked", score, rank)))
    stages.append(F.when(rank <= served_k, stage("served", score, rank)))
    return own.select("query_id", "doc_id", F.explode(F.filter(F.array(*stages), lambda x: x.isNotNull())).alias("s")).select("s.stage", "query_id", "doc_id", "s.score", "s.rank")


def retrieval_metrics(qrels: DataFrame, run: DataFrame, k: int) -> DataFrame:
    """By query: n_relevant, recall, ndcg, rr (reciprocal rank) and complete (all relevant found), at k.

    qrels: query_id, doc_id, rel. A query without hits scores 0; relevance 0 is none.
    """
    wanted = qrels.filter("rel > 0")
    ideal = Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
    gain = lambda rel, rank: rel / F.log2(rank + 1)
    best = wanted.withColumn("r", F.row_number().over(ideal)).groupBy("query_id").agg(F.count("*").alias("n_relevant"), F.sum(F.when(F.col("r") <= k, gain(F.col("rel"), F.col("r")))).alias("ideal"))
    hits = run.filter(F.col("rank") <= k).join(wanted, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("found"), F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"), F.min("rank").alias("first"))
    both = best.join(hits, "query_id", "left")
    found = F.coalesce("found", F.lit(0))
    return both.select(
        "query_id", "n_relevant", (found / F.col("n_relevant")).alias("recall"), (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (found == F.col("n_relevant")).alias("complete"),
    )


def metrics_by_label(queries: DataFrame, docs: DataFrame, run: DataFrame, k: int) -> DataFrame:
    """`retrieval_metrics` where a document is relevant if it has the query's label and isn't the query itself.

    queries: query_id, label; docs: doc_id, label, the queries among them. Labels
    are counted and hits looked up; the pairs of equal labels are never built.
    """
    many = docs.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    best = queries.join(many, "label").filter("n_relevant > 0")
    share = lambda r: 1 / F.log2(r + 1)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k).cast("bigint"), F.col("n_relevant")).cast("int")), F.lit(0.0), lambda total, r: total + share(r))
    hits = run.filter((F.col("rank") <= k) & (F.col("query_id") != F.col("doc_id"))).join(docs.withColumnRenamed("label", "_label"), "doc_id").join(queries, "query_id").filter("label = _label")
    found = hits.groupBy("query_id").agg(F.count("*").alias("found"), F.sum(share(F.col("rank"))).alias("dcg"), F.min("rank").alias("first"))
    n = F.coalesce("found", F.lit(0))
    return best.join(found, "query_id", "left").select(
        "query_id", "n_relevant", (n / F.col("n_relevant")).alias("recall"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (n == F.col("n_relevant")).alias("complete"),
    )


def mean_metrics(by_query: DataFrame) -> DataFrame:
    """One row of means; mrr only if every query has one relevant document."""
    single = F.max("n_relevant") == 1
    return by_query.agg(
        F.count("*").alias("n_queries"), F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"), F.when(single, F.avg("rr")).alias("mrr"),
        F.avg(F.col("complete").cast("double")).alias("complete_evidence"),
    )


def gold_rank(gold_ids: F.Column, hit_ids: F.Column, gold_texts: F.Column | None = None, hit_texts: F.Column | None = None) -> F.Column:
    """Rank of the first gold hit: by id over all hits, else by normalized text (equal, or one within the other). Null if none or no gold."""
    ids = F.nullif(F.array_position(F.transform(hit_ids, lambda h: F.array_contains(gold_ids, h)), True), F.lit(0))
    if gold_texts is None:
        return F.when(F.size(gold_ids) > 0, ids)
    golds = F.filter(F.transform(gold_texts, tx.normalize_passage), lambda g: g != "")
    hits = F.transform(hit_texts, tx.normalize_passage)
    match = F.transform(hits, lambda h: (h != "") & F.exists(golds, lambda g: F.contains(h, g) | F.contains(g, h)))
    texts = F.nullif(F.array_position(match, True), F.lit(0))
    known = (F.size(gold_ids) > 0) | (F.size(golds) > 0)
    return F.when(known, F.coalesce(ids, texts))


def resolve(hits: DataFrame, docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Hits with their documents, refused if one is unknown."""
    joined = hits.join(docs.withColumn("_known", F.lit(True)), doc_id, "left")
    checked = F.when(F.col("_known"), F.col("rank")).otherwise(F.raise_error(F.concat(F.lit("unknown document "), F.col(doc_id).cast("string"))).cast("int"))
    return joined.withColumn("rank", checked).drop("_known")


def distractors(pool: DataFrame, exclude: DataFrame, n: int, *, order: str, text: str = "text") -> DataFrame:
    """The first n distinct passages of the pool, in its order, that aren't excluded: doc_id, text, _order."""
    own = pool.filter(tx.text(text) != "").select(tx.stable_id(text).alias("doc_id"), F.col(text).alias("text"), F.col(order).alias("_order"))
    known = exclude.select(tx.stable_id(text).alias("doc_id")).distinct()
    distinct = own.join(known, "doc_id", "left_anti").groupBy("doc_id").agg(F.min_by("text", "_order").alias("text"), F.min("_order").alias("_order"))
    return distinct.orderBy("_order", "doc_id").limit(n)


def packed(passages: DataFrame, budget: int, *, order: str, text: str = "text", header: int = 0) -> DataFrame:
    """The prefix of distinct passages whose token estimates fit the budget, with running totals.

    A passage that doesn't fit closes the block. Totals run over buckets of the
    order first, so that no single task sums all rows.
    """
    own = passages.filter(tx.text(text) != "").groupBy(tx.stable_id(text).alias("doc_id")).agg(F.min(order).alias("_order"), F.min_by(tx.token_estimate(text), order).alias("tokens"))
    # no prefix of more than budget - header passages fits if each has a token; those without are free
    counted = own.filter("tokens > 0").orderBy("_order", "doc_id").limit(max(0, budget - header) + 1)
    running = F.sum("tokens").over(Window.orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(header)
    return counted.withColumn("total", running).filter(F.col("total") <= budget).select("doc_id", "_order", "tokens", "total")
