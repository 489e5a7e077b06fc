"""Composite reports, model-backed scores, sessions and streams as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import text as tx
from meridia.operators import inference as st
from meridia.operators import models as md
from meridia.operators import results as rs
from meridia.plans import experiments as ex
from meridia.sources import sinks, trials
from meridia.session import table
from meridia.streaming import windows as stream


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with all user turns of their conversation as contexts (a few rows a conversation)."""
    said = table(spark, sf_dir, "conversations")
    asked = said.filter("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list("text")).alias("contexts"))
    return said.filter("role = 'assistant'").join(asked, "conv_id").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("answer"), "contexts")


def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return md.faithfulness(_answers(spark, sf_dir)).select("id", F.round("faithfulness", 9).alias("faithfulness"), F.round("supported_ratio", 9).alias("supported_ratio"), "n_claims")


def rouge_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _answers(spark, sf_dir)
    return own.select("id", F.round(md.rouge_l("answer", F.get("contexts", F.lit(0))), 9).alias("rouge_l"))


def span_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two windows of flagged spans for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n_chars"))
    n = F.col("n_chars")
    half, third = F.floor(n / 2).cast("int"), F.floor(n / 3).cast("int")
    spans = F.array(
        F.struct(F.lit(0).alias("window"), F.lit(0).alias("start"), third.alias("end")), F.struct(F.lit(0).alias("window"), (third - 3).alias("start"), half.alias("end")),
        F.struct(F.lit(1).alias("window"), F.lit(5).alias("start"), (half + 9).alias("end")),
    )
    flags = docs.filter("n_chars > 60").select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.*")
    return md.grounding(flags, docs, "doc_id").select("doc_id", "n_flagged", F.round("grounding", 9).alias("grounding"))


def context_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "benchmark")
    return own.select("item_id", F.size(tx.words(md.compress(F.col("text"), 0.5))).cast("bigint").alias("n_kept"), F.size(tx.words("text")).cast("bigint").alias("n_words"))


def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(md.sentence_windows(F.col("text"), 20)).alias("k", "said")).select("item_id", "k", F.size(tx.words("said")).cast("bigint").alias("n_words"))


def prefix_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replica and cache node of every order's first digits as tokens."""
    tokens = F.array(F.col("o_custkey") % 97, F.col("o_orderkey") % 13)
    own = table(spark, sf_dir, "orders").select("o_orderkey", md.prefix_route(tokens, 7).alias("replica"), md.kv_placement(tokens, 5, size=F.col("o_totalprice"), bandwidth=1000.0).alias("kv"))
    return own.select("o_orderkey", "replica", F.col("kv.node").alias("node"), F.round("kv.remote_bytes", 4).alias("remote_bytes"))


def replica_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_routing(spark, sf_dir).groupBy("replica").agg(F.count("*").alias("n_requests"), F.count_distinct("node").alias("n_nodes"))


def first_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = trials.share_gpt(table(spark, sf_dir, "conversations"))
    return own.select("conv_id", F.sha1("question").alias("question_sha1"), F.sha1("answer").alias("answer_sha1"))


def retrieval_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live hits and misses of the benchmark's queries in a cache of every third, written at different times."""
    queries = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query")).withColumn("key", sinks.cache_key("docs", "bm25", 10))
    cache = queries.filter("item_id % 3 = 0").select("key", F.col("item_id").alias("value"), (F.col("item_id") * 10.0).alias("written_at"), F.lit(500.0).alias("ttl"))
    hits, misses = sinks.cache_lookup(queries, cache, now=700.0)
    return hits.select("item_id", F.lit(True).alias("hit")).unionByName(misses.select("item_id", F.lit(False).alias("hit")))


def needle_haystacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.needles(spark, 50, sentences=40, needles=3).select("id", F.size(tx.sentences("context")).cast("bigint").alias("n_sentences"), F.size("depths").cast("bigint").alias("n_needles"))


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.seeded_sample(table(spark, sf_dir, "customer"), 40, key="c_custkey").select("c_custkey", "c_nationkey")


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 16 turns, in order, within each role."""
    turns = table(spark, sf_dir, "conversations").select("role", "conv_id", "turn")
    own = rs.numbered(turns, ["role"], ["conv_id", "turn"], "n").withColumn("chunk", F.floor((F.col("n") - 1) / 16))
    return own.groupBy("role", "chunk").agg(F.count("*").alias("n"), F.min("conv_id").alias("first_conv"))


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of every cell against N by group of examples: W/L/T, the signed-rank z, and the mean's standard error."""
    estimand = rs.per_example(ex._long(spark, sf_dir), "price")
    reference = estimand.filter("cell = 'N'").select("example_id", F.col("value").alias("b"))
    pairs = estimand.filter("cell <> 'N'").withColumnRenamed("value", "a").join(reference, "example_id").withColumn("delta", F.col("a") - F.col("b")).withColumn("dataset", F.col("example_id") % 3)
    counts = rs.win_loss_tie(pairs, "dataset", "cell", tolerance=0.0)
    ranks = st.signed_rank_sums(pairs, "dataset", "cell").select("dataset", "cell", "z")
    spread_of = pairs.groupBy("dataset", "cell").agg((F.stddev_samp("delta") / F.sqrt(F.count("*"))).alias("se"))
    return counts.join(ranks, ["dataset", "cell"]).join(spread_of, ["dataset", "cell"])


def forest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forest(spark, sf_dir).select("dataset", "cell", "n_pairs", "wins", "losses", "ties", F.round("median_delta", 6).alias("median_delta"), F.round("z", 6).alias("z"), F.round("mean_delta", 6).alias("mean_delta"), F.round("se", 6).alias("se"))


def forest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`forest_counts` with the test's two-sided p, Holm within the group, and a 95 % interval of the mean delta."""
    tested = st.with_normal_p(_forest(spark, sf_dir), "z").withColumn("seq", F.col("cell"))
    half = F.lit(1.959963984540054) * F.col("se")
    interval = [F.round(F.col("mean_delta") - half, 6).alias("low"), F.round(F.col("mean_delta") + half, 6).alias("high")]
    return st.holm(tested, "dataset").select("dataset", "cell", "n_pairs", "wins", "losses", "ties", F.round("median_delta", 6).alias("median_delta"), F.round("z", 6).alias("z"), *interval, F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


def run_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex._long(spark, sf_dir).agg(F.count_distinct("example_id").alias("n_examples"), F.count_distinct("trial").alias("n_trials"), F.count_distinct("cell").alias("n_cells"))


def required_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least grid size that reaches the power, by effect; the power is made from customers' balances."""
    grid = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 5).alias("effect"), (F.col("c_custkey") % 8 * 10).cast("int").alias("n")).agg(F.round(F.avg("c_acctbal") / 6000, 9).alias("power"))
    return st.required_n(grid, "effect", target=0.8)


def stale_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of stale examples by fraction."""
    own = table(spark, sf_dir, "events")
    return own.agg(*[F.count_if(tx.stale_selected("event_id", f)).alias(f"n_{int(100 * f)}") for f in (0.0, 0.1, 0.5, 1.0)])


def streaming_goodput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed stream, run to the end of the event table."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    ok = F.col("event_id") % 19 != 0
    requests = events.select(F.col("ts").cast("timestamp").alias("arrival"), ok.alias("ok"), (F.col("value") / 100).alias("ttft_s"), (F.col("value") / 2000).alias("tpot_s"), (F.col("event_id") % 7 != 0).alias("veridical"))
    name = f"goodput_{uuid.uuid4().hex}"
    query = stream.goodput(requests, window="6 hours", late="1 hour", base_ttft=0.1, base_tpot=0.02).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.table(name)
    return found.select(F.unix_timestamp("t_start").alias("t_start"), "n_issued", "n_completed", "n_timely", "n_yield", F.round("goodput_frac", 9).alias("goodput_frac"), F.round("truth_tax_frac", 9).alias("truth_tax_frac"))


QUERIES = {
    f.__name__: f
    for f in (
        faithfulness, rouge_completeness, span_grounding, context_compression, context_windows, prefix_routing, replica_distribution, first_exchange, retrieval_cache, needle_haystacks, seeded_sample, chunked, forest_counts, forest_summary, run_shape,
        required_windows, stale_selection, streaming_goodput,
    )
}

_MOD = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({h}, ''), lambda d: CAST(instr('0123456789abcdef', d) - 1 AS BIGINT))), lambda r, d: (r * 16 + d) % {n})"
_ROUTED = f"""
routed AS (
  SELECT o_orderkey, {_MOD.format(h="sha1('[' || (o_custkey % 97) || ', ' || (o_orderkey % 13) || ']')", n=7)} AS replica, {_MOD.format(h="md5((o_custkey % 97) || ',' || (o_orderkey % 13))", n=5)} AS node,
    round(o_totalprice * 0.8::DOUBLE, 4) AS remote_bytes
  FROM orders
)
"""
from meridia.plans.experiments_sql import _LONG as _LONG_SQL  # noqa: E402

ORACLE = {
    "span_grounding": """
WITH d AS (SELECT doc_id, length(text) AS n FROM documents)
SELECT doc_id, CAST(CASE WHEN n > 60 THEN n // 2 - 5 ELSE 0 END AS BIGINT) AS n_flagged, round(1 - CASE WHEN n > 60 THEN n // 2 - 5 ELSE 0 END / n, 9) AS grounding FROM d
""",
    "context_compression": r"SELECT item_id, CAST(greatest(1, ceil(len(w) * 0.5)) AS BIGINT) AS n_kept, CAST(len(w) AS BIGINT) AS n_words FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark)",
    "prefix_routing": f"WITH {_ROUTED} SELECT * FROM routed",
    "replica_distribution": f"WITH {_ROUTED} SELECT replica, count(*) AS n_requests, count(DISTINCT node) AS n_nodes FROM routed GROUP BY replica",
    "first_exchange": """
WITH u AS (SELECT conv_id, min(turn) AS asked_at, min_by(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, sha1(any_value(question)) AS question_sha1, sha1(min_by(text, turn)) AS answer_sha1 FROM conversations JOIN u USING (conv_id) WHERE role = 'assistant' AND turn > asked_at GROUP BY conv_id
""",
    "retrieval_cache": "SELECT item_id, text IN (SELECT text FROM benchmark WHERE item_id % 3 = 0 AND item_id * 10 + 500 > 700) AS hit FROM benchmark",
    "needle_haystacks": "SELECT CAST(range AS BIGINT) AS id, CAST(43 AS BIGINT) AS n_sentences, CAST(3 AS BIGINT) AS n_needles FROM range(50)",
    "chunked": "SELECT role, chunk, count(*) AS n, min(conv_id) AS first_conv FROM (SELECT role, conv_id, (row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1) // 16 AS chunk FROM conversations) GROUP BY ALL",
    "forest_counts": f"""
WITH {_LONG_SQL},
pairs AS (SELECT example_id % 3 AS dataset, p.cell, p.value - r.value AS delta FROM per_example p JOIN per_example r USING (example_id) WHERE r.cell = 'N' AND p.cell <> 'N'),
ranked AS (SELECT *, rank() OVER (PARTITION BY dataset, cell ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY dataset, cell, abs(delta)) - 1) / 2 AS r FROM pairs),
tied AS (SELECT dataset, cell, sum(t * t * t - t) AS ties FROM (SELECT dataset, cell, CAST(count(*) AS DOUBLE) AS t FROM pairs WHERE delta <> 0 GROUP BY dataset, cell, abs(delta)) GROUP BY ALL),
sums AS (SELECT dataset, cell, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (delta = 0) AS DOUBLE) AS z, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses, count(*) FILTER (delta = 0) AS ties0, median(delta) AS median_delta, avg(delta) AS mean_delta, stddev_samp(delta) / sqrt(count(*)) AS se, coalesce(sum(r) FILTER (delta > 0), 0) AS w FROM ranked GROUP BY ALL),
zs AS (SELECT *, greatest(abs(w - (n * (n + 1) - z * (z + 1)) / 4) - 0.5::DOUBLE, 0) / sqrt((n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - ties / 2) / 24) AS zz FROM sums JOIN tied USING (dataset, cell))
SELECT dataset, cell, CAST(n AS BIGINT) AS n_pairs, wins, losses, ties0 AS ties, round(median_delta, 6) AS median_delta, round(zz, 6) AS z, round(mean_delta, 6) AS mean_delta, round(se, 6) AS se FROM zs
""",
    "seeded_sample": "SELECT c_custkey, c_nationkey FROM customer ORDER BY sha1('42:' || c_custkey), c_custkey LIMIT 40",
    "context_windows": r"""
WITH RECURSIVE cut AS (
  SELECT item_id, list_transform(list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), '\x01|\n+|;\s+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x: len(regexp_split_to_array(x, '\s+'))) AS sizes FROM benchmark
),
windows(item_id, sizes, k, a, b) AS (
  SELECT item_id, sizes, CAST(0 AS BIGINT), CAST(1 AS BIGINT), list_max(list_filter(range(1, len(sizes) + 1), lambda e: e = 1 OR list_sum(sizes[1:e]) <= 20)) FROM cut WHERE len(sizes) > 0
  UNION ALL
  SELECT item_id, sizes, k, a, list_max(list_filter(range(a, len(sizes) + 1), lambda e: e = a OR list_sum(sizes[a:e]) <= 20)) FROM (
    SELECT item_id, sizes, k + 1 AS k, coalesce(list_min(list_filter(range(a + 1, b + 1), lambda s: list_sum(sizes[s:b]) <= 10)), b + 1) AS a FROM windows WHERE b < len(sizes)
  )
)
SELECT item_id, CAST(k AS INTEGER) AS k, CAST(list_sum(sizes[a:b]) AS BIGINT) AS n_words FROM windows
""",
    "run_shape": "SELECT count(DISTINCT l_partkey) AS n_examples, count(DISTINCT l_linenumber) AS n_trials, count(DISTINCT l_returnflag) AS n_cells FROM lineitem",
    "required_windows": """
WITH g AS (SELECT c_custkey % 5 AS effect, CAST(c_custkey % 8 * 10 AS INTEGER) AS n, round(avg(c_acctbal) / 6000, 9) AS power FROM customer GROUP BY ALL)
SELECT effect, min(n) FILTER (power >= 0.8::DOUBLE) AS required_n, CASE WHEN min(n) FILTER (power >= 0.8::DOUBLE) IS NULL THEN 'NOT_REACHED' ELSE 'REACHED' END AS status FROM g GROUP BY effect
""",
    "stale_selection": "WITH h AS (SELECT CAST('0x' || sha1('42:' || event_id)[1:8] AS BIGINT) / 4294967295.0::DOUBLE AS f FROM events) SELECT CAST(0 AS BIGINT) AS n_0, count(*) FILTER (f < 0.1::DOUBLE) AS n_10, count(*) FILTER (f < 0.5::DOUBLE) AS n_50, count(*) AS n_100 FROM h",
    "streaming_goodput": """
WITH r AS (SELECT epoch_us(ts) // 21600000000 * 21600 AS t_start, event_id % 19 <> 0 AS ok, event_id % 19 <> 0 AND value / 100 <= 1 AND value / 2000 <= 0.1::DOUBLE AS timely, event_id % 7 <> 0 AS v FROM events)
SELECT t_start, count(*) AS n_issued, count(*) FILTER (ok) AS n_completed, count(*) FILTER (timely) AS n_timely, count(*) FILTER (timely AND v) AS n_yield, round(count(*) FILTER (timely) / count(*), 9) AS goodput_frac, round((count(*) FILTER (timely) - count(*) FILTER (timely AND v)) / count(*), 9) AS truth_tax_frac FROM r GROUP BY t_start
""",
}
