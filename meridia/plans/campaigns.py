"""Campaign queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators import campaign as cp
from meridia.operators import integrity as ig
from meridia.plans import experiments as ex
from meridia.plans.experiments_sql import _SCORED
from meridia.session import table


def contrast_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 20 + 1).alias("contrast_id")).distinct()
    return cp.classify(cp.contrasts(spark)).join(wanted, "contrast_id").select("contrast_id", "tier", "unit", "reason")


def cell_reference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations as axes: B1 against B6."""
    own = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey")).alias("engine"), F.col("c_mktsegment").alias("dataset"), F.when(F.col("c_custkey") % 2 == 0, "B1").otherwise("B6").alias("baseline")
    ).filter("engine IS NOT NULL")
    index = own.withColumn("row_key", F.concat_ws("|", "baseline", "engine"))
    return cp.match_pairs(index, "B1", "B6", ["engine"]).select("engine", "cell", "reference", F.array_join("datasets", ",").alias("datasets"))


def pooled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 2 == 0).alias("flag"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("price"))
    return cp.pooled_fields([orders, customers], ["key"]).select("key", "field", F.round("value", 6).alias("value"), "n")


def request_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 5 != 0).alias("ok"))
    verdicts = events.filter("ok").select("id", (F.col("id") % 3 == 0).alias("predicate"))
    return cp.request_predicates(events, verdicts, ["id"])


def window_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 5 != 0).alias("ok"), F.when(F.col("event_id") % 13 == 0, "HTTP 500").otherwise("0").alias("error"), F.when(F.col("event_id") % 17 == 0, " TRUE ").otherwise("").alias("empty_generation"))
    return cp.window_accounting(own, "event_type")


def reproducibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select((F.col("doc_id") % 400).alias("key"), F.col("lang").alias("answer"))
    return cp.reproducibility(own, "key")


def realized_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.realized_n(table(spark, sf_dir, "events"), "event_type", accepted=1600)


def truth_tax_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select(F.col("event_id").alias("example_id"), F.col("value").alias("ttft_ms"), (F.col("event_id") % 3 != 0).cast("double").alias("exact_match"))
    return cp.truth_tax_pool(own)


def instrument_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ex._scored(spark, sf_dir).select(F.col("doc_id").alias("item_id"), "score", F.col("quality").alias("label"), F.col("n_chars").alias("context_length"))
    return cp.calibrate(own, floor=0.85, auc_floor=0.3, edges=(0, 1000)).select("n_pos", "n_neg", *[F.round(c, 9).alias(c) for c in ("auc", "worst_bin_auc", "tau", "precision", "recall")], "n_unusable_bins", "passed")


def equivalence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("example_id"), (F.col("l_linenumber") % 3).alias("window_id"), F.when(F.col("l_returnflag") == "N", "none").when(F.col("l_returnflag") == "A", "evict").otherwise("other").alias("policy"), F.col("l_extendedprice").alias("value"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey") % 2).alias("event"))
    return cp.equivalence_pairs(own, "evict")


def specification_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal") - 4500, 6).alias("estimate"))
    return cp.specification_curve(own).select("c_nationkey", "estimate", F.col("rank").cast("bigint").alias("rank"), "opposes")


def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return cp.newest(own, 3, by="user_id", ts="ts").select("user_id", "event_id")


def binding_requirement(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 6).alias("family"), F.when(F.col("s_suppkey") % 37 != 0, F.col("s_suppkey") * 10).alias("required_n"))
    return cp.binding(own, "family")


def pair_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ex._contrasts(spark, sf_dir).withColumnRenamed("contrast", "dataset")
    return cp.pair_statistics(own, metric="f1_score")


def scored_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"), F.array("text").alias("golds"), F.when(F.col("conv_id") % 9 == 0, "Timeout").otherwise("").alias("error"))
    return cp.scoring_pass(said, ["conv_id"], "turn").select("conv_id", "turn", "n_dropped", "exact_match", F.round("f1", 9).alias("f1"))


def registered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    contrasts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("contrast_id"), F.lit("secondary").alias("tier")).filter("contrast_id < 10")
    families = ig.family_map(contrasts, ["ttft_ms"], ["squad_v2", "qasper"])
    rows = table(spark, sf_dir, "supplier").select((F.col("s_nationkey")).alias("contrast_id"), F.lit("ttft_ms").alias("metric"), F.when(F.col("s_suppkey") % 3 == 0, "squad_v2").when(F.col("s_suppkey") % 3 == 1, "qasper").otherwise("hpc").alias("dataset"), "s_suppkey")
    kept, out = cp.registered(rows, families)
    return kept.withColumn("registered", F.lit(True)).unionByName(out.withColumn("registered", F.lit(False))).select("s_suppkey", "contrast_id", "dataset", "registered")


QUERIES = {
    f.__name__: f
    for f in (
        contrast_reasons, cell_reference_pairs, pooled_fields, request_verdicts, window_accounting, reproducibility, realized_n, truth_tax_pool, instrument_calibration, equivalence_pairs, specification_curve, newest_events, binding_requirement,
        pair_statistics, scored_evidence, registered_rows,
    )
}

_REGISTRY = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in cp.CONTRASTS)
_AUC = "(sum(r) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2) / (sum(quality) * (count(*) - sum(quality)))"
ORACLE = {
    "contrast_reasons": f"""
SELECT contrast_id, tier, unit, CASE WHEN tier = 'falsification' THEN 'falsification-suite' WHEN a IS NULL AND b IS NULL THEN 'no-baseline-pair' WHEN b IS NULL THEN 'one-sided-selector' WHEN unit = 'window' THEN 'window-unit' END AS reason
FROM (VALUES {_REGISTRY}) t(contrast_id, a, b, family, tier, sided, unit) WHERE contrast_id IN (SELECT n_nationkey % 20 + 1 FROM nation)
""",
    "cell_reference_pairs": """
WITH i AS (SELECT c_nationkey AS engine, c_mktsegment AS dataset, CASE WHEN c_custkey % 2 = 0 THEN 'B1' ELSE 'B6' END AS baseline FROM customer WHERE c_nationkey % 4 <> 0)
SELECT engine, 'B1|' || engine AS cell, 'B6|' || engine AS reference, (SELECT coalesce(string_agg(d, ',' ORDER BY d), '') FROM (SELECT dataset AS d FROM i x WHERE x.engine = i.engine GROUP BY dataset HAVING count(DISTINCT baseline) = 2)) AS datasets
FROM i GROUP BY engine HAVING count(DISTINCT baseline) = 2
""",
    "pooled_fields": """
WITH l AS (SELECT o_custkey AS key, 'price' AS field, o_totalprice AS v FROM orders UNION ALL SELECT c_custkey, 'price', c_acctbal FROM customer UNION ALL SELECT o_custkey, 'flag', (o_orderkey % 2 = 0)::INT::DOUBLE FROM orders)
SELECT key, field, round(avg(v), 6) AS value, count(*) AS n FROM l GROUP BY ALL
""",
    "request_verdicts": "SELECT event_id AS id, event_id % 5 <> 0 AS ok, event_id % 5 <> 0 AND event_id % 3 = 0 AS veridical FROM events",
    "window_accounting": "SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 13 = 0) AS n_error, count(*) FILTER (event_id % 7 <> 0 AND event_id % 5 = 0) AS n_failed, count(*) FILTER (event_id % 17 = 0) AS n_empty, count(*) FILTER (event_id % 7 = 0) AS n_unknown, count(*) FILTER (event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0) AS n_valid FROM events GROUP BY event_type",
    "reproducibility": "SELECT count(*) AS n_repeated, count(*) FILTER (d > 1) AS n_violations FROM (SELECT doc_id % 400 AS k, count(*) AS n, count(DISTINCT lang) AS d FROM documents GROUP BY 1) WHERE n >= 2",
    "realized_n": "SELECT event_type, n, CASE WHEN n >= 2000 THEN 2000 WHEN n >= 1600 THEN 1600 WHEN n >= 1200 THEN 1200 END AS step, n >= 1600 AS ok FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)",
    "truth_tax_pool": "WITH m AS (SELECT quantile_cont(value, 0.5) AS m FROM events) SELECT event_id AS example_id, (value <= 10 * m)::INT::DOUBLE AS g, (event_id % 3 <> 0)::INT::DOUBLE AS y, (value <= 10 * m)::INT::DOUBLE - (event_id % 3 <> 0)::INT::DOUBLE AS tax FROM events, m",
    "instrument_calibration": f"""
WITH {_SCORED}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM scored),
b AS (SELECT *, rank() OVER (PARTITION BY n_chars >= 1000 ORDER BY score) + (count(*) OVER (PARTITION BY n_chars >= 1000, score) - 1) / 2 AS r FROM scored),
bins AS (SELECT CASE WHEN sum(quality) * (count(*) - sum(quality)) > 0 THEN {_AUC} END AS auc FROM b GROUP BY n_chars >= 1000),
c AS (SELECT score, count(*) AS t, sum(quality) AS pos FROM scored GROUP BY score),
tail AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(t) OVER (ORDER BY score DESC) AS n, sum(pos) OVER () AS p FROM c),
best AS (SELECT score AS tau, tp / n AS precision, tp / p AS recall FROM tail WHERE tp / n >= 0.85::DOUBLE - 1e-12 ORDER BY score LIMIT 1),
whole AS (SELECT CAST(sum(quality) AS BIGINT) AS n_pos, CAST(count(*) - sum(quality) AS BIGINT) AS n_neg, {_AUC} AS auc FROM r),
worst AS (SELECT min(auc) AS worst, count(*) FILTER (auc IS NULL) AS n_unusable_bins FROM bins)
SELECT n_pos, n_neg, round(auc, 9) AS auc, round(worst, 9) AS worst_bin_auc, round(tau, 9) AS tau, round(precision, 9) AS precision, round(recall, 9) AS recall, n_unusable_bins, tau IS NOT NULL AND n_unusable_bins = 0 AND worst >= 0.3::DOUBLE AS passed FROM whole, worst LEFT JOIN best ON true
""",
    "equivalence_pairs": """
WITH r AS (SELECT l_partkey AS example_id, l_linenumber % 3 AS window_id, l_returnflag AS f, l_extendedprice AS v, CASE WHEN l_suppkey % 5 <> 0 THEN l_suppkey % 2 END AS event FROM lineitem WHERE l_returnflag IN ('N', 'A')),
b AS (SELECT example_id, window_id, max(v) FILTER (f = 'A') AS a, max(v) FILTER (f = 'N') AS b, max(event) AS event FROM r GROUP BY ALL)
SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN 'UNPAIRED' WHEN event IS NULL THEN 'NO_MASK' ELSE 'PAIRED' END AS status FROM b
""",
    "specification_curve": "WITH e AS (SELECT c_nationkey, round(avg(c_acctbal) - 4500, 6) AS estimate FROM customer GROUP BY 1), m AS (SELECT median(estimate) AS m FROM e) SELECT c_nationkey, estimate, row_number() OVER (ORDER BY estimate, c_nationkey) AS rank, sign(estimate) = -sign(m) AS opposes FROM e, m",
    "newest_events": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events) WHERE k <= 3",
    "binding_requirement": "WITH r AS (SELECT s_nationkey % 6 AS family, CASE WHEN s_suppkey % 37 <> 0 THEN s_suppkey * 10 END AS n FROM supplier) SELECT family, CASE WHEN NOT bool_or(n IS NULL) THEN max(n) END AS required_n, CASE WHEN bool_or(n IS NULL) THEN 'NOT_REACHED' ELSE 'REACHED' END AS status FROM r GROUP BY family",
    "scored_evidence": "SELECT conv_id, max(turn) AS turn, count(*) - 1 AS n_dropped, CASE WHEN conv_id % 9 <> 0 THEN 1.0::DOUBLE END AS exact_match, CASE WHEN conv_id % 9 <> 0 THEN 1.0::DOUBLE END AS f1 FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
    "registered_rows": "SELECT s_suppkey, s_nationkey AS contrast_id, CASE s_suppkey % 3 WHEN 0 THEN 'squad_v2' WHEN 1 THEN 'qasper' ELSE 'hpc' END AS dataset, s_nationkey < 10 AND s_suppkey % 3 <> 2 AS registered FROM supplier",
}
