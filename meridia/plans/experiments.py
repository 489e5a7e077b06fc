"""Result tables, serving windows, statistics and integrity over the star schema and events.

Stand-ins: a cell is a return flag, an example a part, a metric an extended price;
event values serve as latencies, users as request sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.operators import inference as st
from meridia.operators import integrity as ig
from meridia.operators import results as rs
from meridia.operators import serving as sv
from meridia.plans.experiments_sql import ORACLE  # noqa: F401
from meridia.session import table


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trial rows: strings, some failed, some empty, some repeats."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("cell"), F.col("l_partkey").alias("example_id"), F.col("l_linenumber").alias("trial"), F.col("l_extendedprice").cast("string").alias("price"), F.col("l_suppkey").alias("suppkey"),
        F.when(key % 17 == 0, "Timeout").otherwise("None").alias("error"), F.when(key % 23 == 0, "True").otherwise("false").alias("empty_generation"), F.when(key % 11 == 0, "1").otherwise("0").alias("repeat_index"),
    )


def validity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _long(spark, sf_dir)
    return own.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(rs.is_error(F.col("error"))).alias("n_error"), F.count_if(rs.is_empty_generation(F.col("empty_generation"))).alias("n_empty")).join(rs.headline_rows(own).groupBy("cell").agg(F.count("*").alias("n_headline")), "cell")


def per_example_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.per_example(_long(spark, sf_dir), "price").select("cell", "example_id", F.round("value", 6).alias("value"), "n_rows")


def cell_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.cell_summary(_long(spark, sf_dir), "price").select("cell", "n_examples", "n_rows", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std")])


def mean_of_trial_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.mean_of_trial_means(_long(spark, sf_dir), "price").select("cell", F.round("mean_of_trial_means", 4).alias("mean_of_trial_means"), "n_trials")


def trial_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rs.trial_aggregate(rs.valid_rows(_long(spark, sf_dir)), F.col("price").cast("double"), "trial")
    return own.select("trial", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")], "n")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.paired(rs.per_example(_long(spark, sf_dir), "price"), "A", "N")


def paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("example_id", *[F.round(c, 7).alias(c) for c in ("a", "b", "delta")])


def win_loss_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rs.win_loss_tie(_pairs(spark, sf_dir), tolerance=100.0)
    return own.select("n_pairs", "wins", "losses", "ties", "n_dropped", *[F.round(c, 4).alias(c) for c in ("mean_delta", "median_delta")])


def sign_flip_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _pairs(spark, sf_dir).filter("delta IS NOT NULL")
    return rs.sign_flip_share(own, "delta").select(F.round("median", 4).alias("median"), F.round("flip_share", 9).alias("flip_share"))


def wilcoxon_pratt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences in hundreds, so that there are ties and zeros; one contrast for each size class of part."""
    own = _pairs(spark, sf_dir).filter("delta IS NOT NULL").select((F.col("example_id") % 4).alias("contrast"), F.round(F.col("a") / 1000).alias("a"), F.round(F.col("b") / 1000).alias("b"))
    return st.signed_rank_sums(own, "contrast").select("contrast", "n_pairs", "n_zero", *[F.round(c, 6).alias(c) for c in ("w_plus", "w_minus", "w_mean", "w_var", "z")])


def _contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).filter("delta IS NOT NULL").select((F.col("example_id") % 4).alias("contrast"), "example_id", F.round(F.col("a") / 1000).alias("a"), F.round(F.col("b") / 1000).alias("b"))


def wilcoxon_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.wilcoxon(_contrasts(spark, sf_dir), "contrast")


def mannwhitney_cliffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rs.per_example(_long(spark, sf_dir), "price").filter("cell IN ('A', 'N')").select((F.col("example_id") % 4).alias("contrast"), F.when(F.col("cell") == "A", "a").otherwise("b").alias("side"), F.round(F.col("value") / 1000).alias("value"))
    return st.mann_whitney_sums(own, "contrast").select("contrast", "n_a", "n_b", "u", F.round("cliffs_delta", 9).alias("cliffs_delta"))


def mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _contrasts(spark, sf_dir).select("contrast", (F.col("a") >= 38).alias("a"), (F.col("b") >= 38).alias("b"))
    return st.mcnemar_counts(own, "contrast").withColumn("diff", F.round("diff", 9))


def mcnemar_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _contrasts(spark, sf_dir).select("contrast", (F.col("a") >= 38).alias("a"), (F.col("b") >= 38).alias("b"))
    return st.mcnemar(own, "contrast").withColumns({c: F.round(c, 9) for c in ("diff", "p")})


def _window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of two kinds of event: at most 24 windows a side."""
    own = table(spark, sf_dir, "events").filter("event_type IN ('click', 'view')")
    return own.groupBy(F.when(F.col("event_type") == "click", "a").otherwise("b").alias("side"), F.hour("ts").alias("window_id")).agg(F.round(F.avg("value"), 9).alias("value"))


def welch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.welch_stats(_window_means(spark, sf_dir)).select("n_a", "n_b", *[F.round(c, 6).alias(c) for c in ("mean_diff", "t", "df")])


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _contrasts(spark, sf_dir).select("contrast", "example_id", (F.col("a") - F.col("b")).alias("value"))
    return st.bootstrap_ci(own, "contrast")


def tost_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _contrasts(spark, sf_dir).withColumn("event", F.col("example_id") % 3 != 0).withColumn("window_id", F.floor(F.col("example_id") / 4) % 12)
    return st.tost(own, "contrast", margin=5.0, windows=True)


def rope_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _contrasts(spark, sf_dir).withColumn("event", F.col("example_id") % 3 != 0)
    return st.rope(own, "contrast", width=5.0)


def power_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.power_table(spark, [0.0, 0.5, 1.0], [10, 20], sims=60, seed=7)


def aa_split_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("value"))
    return st.split_half(own, splits=40, seed=7).agg(F.count("*").alias("n_splits"), F.avg(F.col("rejected").cast("double")).alias("rejection_rate"))


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo p-values: a family for each customer's nation group."""
    own = table(spark, sf_dir, "orders")
    return own.select((F.col("o_custkey") % 50).alias("family"), F.col("o_orderkey").alias("seq"), (F.pmod(F.col("o_orderkey") * 7919, F.lit(10007)) / 100070.0).alias("p"))


def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.holm(_families(spark, sf_dir), "family").select("family", "seq", F.round("p_holm", 9).alias("p_holm"))


def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.benjamini_hochberg(_families(spark, sf_dir), "family").select("family", "seq", F.round("p_bh", 9).alias("p_bh"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "quality", "toxic", "n_chars", (F.floor(F.log(F.col("n_chars") + 1.0) * 4) / 4).alias("score"))


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.roc_auc(_scored(spark, sf_dir), label="quality").select("n_pos", "n_neg", F.round("auc", 9).alias("auc"))


def length_bin_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _scored(spark, sf_dir).withColumn("bin", st.length_bin(F.col("n_chars"), [0, 500, 1000, 4000]))
    return st.roc_auc(own, "bin", label="quality").select("bin", "n_pos", "n_neg", F.round("auc", 9).alias("auc"))


def tau_precision_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.tau_precision(_scored(spark, sf_dir), floor=0.85, label="quality").select(*[F.round(c, 9).alias(c) for c in ("tau", "precision", "recall", "specificity")], "n_predicted")


def tau_balanced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.tau_balanced(_scored(spark, sf_dir), bad="toxic").select(*[F.round(c, 9).alias(c) for c in ("tau", "balanced_accuracy", "band_low", "band_high")])


def corrected_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "labels").agg(F.avg("toxic").alias("apparent"))
    return own.select(F.round("apparent", 9).alias("apparent"), F.round(st.corrected_rate(F.col("apparent"), F.lit(0.9), F.lit(0.97)), 9).alias("corrected"))


def drift_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _scored(spark, sf_dir).select(F.col("doc_id").alias("item_id"), "score")
    return st.drift(own, own.withColumn("score", F.col("score") + F.when(F.col("item_id") % 10 == 0, 0.25).otherwise(0.0)), 7.0).select("n", F.round("mean_abs_delta", 9).alias("mean_abs_delta"), F.round("flip_rate", 9).alias("flip_rate"))


def collision_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.collision_probability(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus").select("o_orderstatus", F.round("collision_probability", 9).alias("collision_probability"))


# --- serving


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: a window for each hour, value as TTFT."""
    own = table(spark, sf_dir, "events")
    ok = F.col("event_id") % 19 != 0
    return own.select(
        F.hour("ts").alias("window_id"), "event_type", ok.alias("ok"), F.when(ok, F.col("value") / 100).alias("ttft_s"), F.when(ok, F.col("value") / 2000).alias("tpot_s"), F.when(ok, F.col("event_id") % 7 != 0).alias("veridical"),
        (F.minute("ts") * 60 + F.second("ts")).cast("double").alias("arrival_s"), "event_id", "user_id", "value",
    )


def goodput_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sv.window_currencies(_requests(spark, sf_dir), "window_id", base_ttft=F.lit(0.1), base_tpot=F.lit(0.02), duration=F.lit(3600.0))
    rounded = ["attainment", "throughput_rps", "goodput_rps", "yield_rps", "independence_null_frac", "covariance_gap", "truth_tax_frac", "truth_tax_rps"]
    return own.select("window_id", "n_issued", "n_completed", "n_timely", "n_veridical", "n_yield", *[F.round(c, 9).alias(c) for c in rounded])


def window_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sv.trim(_requests(spark, sf_dir), warmup_s=600.0, measure_s=1800.0)
    return own.groupBy("window_id").agg(F.count("*").alias("n"), F.min("arrival_s").alias("first_s"), F.max("arrival_s").alias("last_s"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rs.latency_summary(table(spark, sf_dir, "events"), "value", "event_type")
    return own.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("avg", "p50", "p95", "p99")])


def performance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _requests(spark, sf_dir).select("event_type", (F.col("value") * 2).alias("ttft_ms"), (F.col("value") * 10).alias("total_ms"), (F.col("event_id") % 40).alias("n_tokens"), F.when(F.col("ok"), "").otherwise("HTTP 500").alias("error"))
    found = rs.performance(own, "event_type")
    return found.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("qps", "tps", "avg_ttft", "p95_ttft", "avg_tpot", "p99_tpot", "p50_latency")])


def slo_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _requests(spark, sf_dir).select("event_type", (F.col("ttft_s") * 1000).alias("ttft_ms"), (F.col("tpot_s") * 1000).alias("tpot_ms"))
    return sv.slo_floor(own, "event_type").select("event_type", "n", F.round("ttft_s", 9).alias("ttft_s"), F.round("tpot_s", 9).alias("tpot_s"))


def _telemetry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = table(spark, sf_dir, "events")
    samples = own.select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), "value", "event_id").select("event_type", (F.col("us") / 1e6).alias("ts_s"), (F.pmod(F.col("value"), F.lit(100.0)) / 100).alias("kv_cache_usage"), F.col("event_id").alias("preemptions_total"))
    windows = samples.select("event_type", (F.floor(F.col("ts_s") / 7200) * 7200).cast("double").alias("t_start")).distinct().withColumn("t_end", F.col("t_start") + 7200)
    return samples, windows


def zoh_time_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, windows = _telemetry(spark, sf_dir)
    own = sv.zero_order_hold(samples, windows, "event_type")
    return own.select("event_type", "t_start", "n_samples", F.round("coverage", 6).alias("coverage"), "telemetry_ok", F.round("rho_kv", 6).alias("rho_kv"), "scarcity_events")


def regime_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = zoh_time_average(spark, sf_dir)
    attainment = F.round(1 - F.pmod(F.col("n_samples"), F.lit(5)) / 30, 6)
    return own.select("event_type", "t_start", sv.regime(F.col("rho_kv") * 2, F.col("scarcity_events"), attainment, F.col("telemetry_ok")).alias("regime"))


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep for each event type: ten rates by user bucket."""
    own = table(spark, sf_dir, "events").withColumn("step", F.col("user_id") % 10)
    swept = own.groupBy("event_type", "step").agg(F.count("*").cast("double").alias("n"), F.round(F.avg("value"), 6).alias("latency"))
    return swept.select("event_type", F.round(F.pow(F.lit(1.15), F.col("step")), 9).alias("offered_rate"), F.col("n").alias("throughput"), "latency", F.col("n").alias("goodput"))


def knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sv.knee(_sweep(spark, sf_dir), "event_type")
    return own.select("event_type", "label", *[F.round(c, 6).alias(c) for c in ("onset_rate", "grid_rate", "lo", "hi")])


def cliff(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sv.cliff(_sweep(spark, sf_dir), "event_type")
    return own.select("event_type", "label", *[F.round(c, 6).alias(c) for c in ("onset_rate", "grid_rate", "lo", "hi")])


def grid_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sv.grid_onset(_sweep(spark, sf_dir).withColumn("power", F.col("throughput") / F.col("latency")), "event_type")
    return own.select("event_type", "label", F.round("onset_rate", 6).alias("onset_rate"), F.round("grid_rate", 6).alias("grid_rate"))


def lambda_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _sweep(spark, sf_dir).select("event_type", F.col("offered_rate").alias("rate"), F.round(F.least(F.lit(1.0), F.col("throughput") / F.col("latency")), 9).alias("attainment"), "throughput")
    return sv.ladder_decision(steps, "event_type")


def poisson_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sv.arrivals(spark, [0.5, 2.0, 8.0], seed=11, duration_s=60.0)


def staleness_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 3 != 0).alias("served_from_cache"), F.when(F.col("event_id") % 13 != 0, F.col("value") > 20).alias("grounded"), (F.col("event_id") % 4 == 0).alias("is_v0"))
    found = rs.staleness(own, "event_type", stale=F.col("is_v0"))
    return found.select("event_type", *[F.round(c, 9).alias(c) for c in ("unsafe_served_rate", "answer_hit_rate", "false_hit_rate", "stale_hit_rate")])


def select_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridia.functions import text as tx

    return table(spark, sf_dir, "events").select("event_id", tx.stale_selected("event_id", 0.3).alias("stale"))


def cache_hit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 5 == 0, "remote").when(F.col("event_id") % 7 == 0, "miss").otherwise("local")
    own = rs.cache_metrics(table(spark, sf_dir, "events"), "event_type", kind=kind, fetch_ms=F.col("value"), size=F.col("value") * 1024)
    return own.select("event_type", "n_accesses", *[F.round(c, 6).alias(c) for c in ("local_ratio", "remote_ratio", "miss_ratio", "avg_remote_fetch_ms")], F.round("bytes_moved", 2).alias("bytes_moved"))


def prompt_cache_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 900 + 100).alias("prompt"), F.when(F.col("event_id") % 6 != 0, F.col("event_id") % 90).alias("cached"))
    found = rs.prompt_cache(own, "event_type", prompt="prompt", cached="cached")
    return found.select("event_type", "prompt_tokens", "cached_tokens", *[F.round(c, 9).alias(c) for c in ("cached_ratio", "request_rate", "median_uncached")], "n_missing")


def gauge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return rs.gauge_summary(own, "event_type", ts="us", gauges=["value"], counters=["event_id"], energy="user_id").withColumn("value_avg", F.round("value_avg", 4))


def kv_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("fp8", "fp16", "fp32"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return own.select("doc_id", rs.kv_bytes(F.col("n_chars").cast("bigint"), layers=40, heads=8, head_dim=128, dtype=kind).alias("kv_bytes"), rs.kv_bytes(F.col("n_chars").cast("bigint"), layers=40, heads=8, head_dim=128, dtype=kind, latent=576).alias("latent_bytes"))


def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), "p_retailprice")
    return rs.pareto(own, "p_retailprice", "size")


def minmax_trilemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier")
    return own.select("s_suppkey", F.round(rs.minmax_score(F.col("s_acctbal"), Window.partitionBy("s_nationkey")), 6).alias("score"))


# --- integrity


def identity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders")
    left = own.select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("repeat"), "o_totalprice")
    right = own.select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("repeat"), "o_orderstatus")
    return ig.identity_join(left, right, ["o_orderkey", "repeat"])


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("key"))
    items = table(spark, sf_dir, "lineitem").filter("l_orderkey % 7 <> 0").select(F.col("l_orderkey").alias("key"))
    return ig.reconciliation(orders, items, ["key"]).groupBy("status").agg(F.count("*").alias("n_keys"), F.sum("n_right").alias("n_rows"))


def duplicate_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ig.duplicate_census(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


def coverage_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    observed = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 3).alias("key"))
    return ig.coverage(expected, observed, ["key"])


def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return ig.keep_last(own, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus", "n_dropped")


def merge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    new = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("score"))
    return ig.merge_scores(rows, new, ["doc_id"], ["score"], F.col("doc_id") % 5 == 0)


def window_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "labels").select("doc_id", F.element_at(F.array(*map(F.lit, ("squad_v2", "qasper", "hpc"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("dataset"), (F.col("doc_id") % 11 != 0).alias("ok"), F.when(F.col("doc_id") % 4 != 0, F.col("quality").cast("double")).alias("exact_match"), (F.col("doc_id") % 10 / 10.0).alias("grounding_score"))
    return ig.window_predicate(own).select("doc_id", "dataset", "predicate", "reason")


def predicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ig.predicate_summary(window_predicate(spark, sf_dir), "dataset").withColumn("null_fraction", F.round("null_fraction", 9))


def quality_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _scored(spark, sf_dir).withColumn("score", F.when(F.col("doc_id") % 3 != 0, F.col("score")))
    return rs.quality_aggregate(own, ["score", "toxic"], "quality").withColumn("mean", F.round("mean", 9))


def blinded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "region")
    tokens = ig.blinding_map(["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", *[f"REGION_{k}" for k in range(9)]] + [r["r_name"] for r in own.select("r_name").distinct().collect()], b"salt")
    back = {v: k for k, v in tokens.items()}
    blind = ig.relabel(own, tokens, "r_name")
    return ig.relabel(blind, back, "r_name").select("r_regionkey", "r_name")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis values by key: some legal, many not."""
    pick = lambda axis, k: F.element_at(F.array(*map(F.lit, ig.AXES[axis])), (k % len(ig.AXES[axis]) + 1).cast("int")).alias(axis)
    key = F.col("o_orderkey")
    steps = {"arm": 1, "retriever": 3, "policy": 7, "topology": 11, "engine": 13, "model": 17, "family": 19}
    coords = [F.when(key % 3 == 0, (key % 40 + 1) / 20.0).alias("budget_r"), F.when(key % 5 == 0, (key % 23 + 1) * 0.125).alias("rate_frac")]
    return table(spark, sf_dir, "orders").select("o_orderkey", *[pick(a, F.floor(key / s)) for a, s in steps.items()], *coords)


def cell_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ig.violations(_cells(spark, sf_dir)).select("o_orderkey", F.size("violations").cast("bigint").alias("n_violations"), F.array_contains("violations", "arm-not-in-family").alias("arm_family"))


def row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _cells(spark, sf_dir).withColumn("row_key", ig.row_key())
    back = ig.parse_row_key(F.col("row_key"))
    return keyed.select("o_orderkey", "row_key", back["model"].alias("model"), back["budget_r"].alias("budget_r"), back["rate_frac"].alias("rate_frac"))


def baseline_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("B"), (F.col("s_suppkey") % 12 + 1).cast("string")).alias("baseline"))
    return own.join(F.broadcast(ig.baselines(spark)), "baseline").select("s_suppkey", "baseline", "arm", "retriever", "reuse")


def family_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    contrasts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("contrast_id"), F.when(F.col("n_regionkey") == 0, "primary").otherwise("secondary").alias("tier"))
    return ig.family_map(contrasts, ["ttft_ms", "predicate"], ["squad_v2", "qasper"])


def gatekeeping(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("chain_order"), F.concat(F.lit("E"), F.col("n_regionkey").cast("string")).alias("endpoint"), F.col("n_name").alias("dataset"), F.when(F.col("n_nationkey") != 17, (F.col("n_nationkey") % 6) / 100.0).alias("p"))
    return ig.gatekeeping(legs)


QUERIES = {
    f.__name__: f
    for f in (
        validity_counts, per_example_mean, cell_summary, mean_of_trial_means, trial_aggregate, paired_deltas, win_loss_tie, sign_flip_share, wilcoxon_pratt, wilcoxon_test, mannwhitney_cliffs, mcnemar_counts, mcnemar_test, welch_stats,
        bootstrap_ci, tost_equivalence, rope_posterior, power_simulation, aa_split_half, holm_adjust, bh_fdr, roc_auc, length_bin_auc, tau_precision_floor, tau_balanced_accuracy, corrected_rate, drift_audit, collision_probability,
        goodput_window, window_trim, latency_percentiles, performance_summary, slo_floor, zoh_time_average, regime_label, knee, cliff, grid_onset, lambda_star, poisson_arrivals, staleness_rates, select_stale, cache_hit_metrics,
        prompt_cache_summary, gauge_summary, kv_footprint, pareto_frontier, minmax_trilemma, identity_join, reconciliation, duplicate_census, coverage_antijoin, keep_last, merge_scores, window_predicate, predicate_summary,
        quality_aggregate, blinded_labels, cell_violations, row_keys, baseline_cells, family_map, gatekeeping,
    )
}
