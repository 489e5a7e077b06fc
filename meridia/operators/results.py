"""Result tables: validity, the one estimand, summaries, pairs, trackers.

Missing is never zero: metrics are coerced with NaN and garbage as null, means
skip nulls and every drop is counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What counts as no error, and as the first repeat.
NO_ERROR = ("", "none", "false", "0", "nan")
FIRST_REPEAT = ("", "0", "none", "nan", "0.0")


def is_error(c: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin(*NO_ERROR)


def is_empty_generation(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))) == "true", F.lit(False))


def number(c: Column) -> Column:
    """A double; NaN and what isn't a number are null."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def metric(df: DataFrame, name: str) -> Column:
    """The column as numbers; an absent column is all null."""
    return number(F.col(f"`{name}`")) if name in df.columns else F.lit(None).cast("double")


def valid_rows(df: DataFrame) -> DataFrame:
    """Neither failed nor empty."""
    checks = [~is_error(F.col("error"))] if "error" in df.columns else []
    checks += [~is_empty_generation(F.col("empty_generation"))] if "empty_generation" in df.columns else []
    return df.filter(reduce(lambda a, b: a & b, checks)) if checks else df


def headline_rows(df: DataFrame) -> DataFrame:
    """Valid rows of the first repeat."""
    own = valid_rows(df)
    if "repeat_index" not in df.columns:
        return own
    return own.filter(F.lower(F.trim(F.coalesce(F.col("repeat_index").cast("string"), F.lit("")))).isin(*FIRST_REPEAT))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """One table with all columns, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def per_example(df: DataFrame, name: str, *, cell: str = "cell", example: str = "example_id") -> DataFrame:
    """The estimand: the mean of each (cell, example) over its valid first-repeat rows that have the metric."""
    return headline_rows(df).select(F.col(cell).alias("cell"), F.col(example).alias("example_id"), metric(df, name).alias("value")).filter("value IS NOT NULL").groupBy("cell", "example_id").agg(F.avg("value").alias("value"), F.count("*").alias("n_rows"))


def cell_summary(df: DataFrame, name: str, *, cell: str = "cell", example: str = "example_id") -> DataFrame:
    """n_examples, n_rows, mean, median and sample deviation (0 for one example) of each cell; a cell without values keeps its row."""
    own = per_example(df, name, cell=cell, example=example).groupBy("cell").agg(
        F.count("*").alias("n_examples"), F.sum("n_rows").alias("n_rows"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std")
    )
    cells = df.select(F.col(cell).alias("cell")).distinct()
    return cells.join(own, "cell", "left").withColumns({"n_examples": F.coalesce("n_examples", F.lit(0)), "n_rows": F.coalesce("n_rows", F.lit(0))})


def mean_of_trial_means(df: DataFrame, name: str, *, cell: str = "cell", trial: str = "trial") -> DataFrame:
    own = headline_rows(df).select(F.col(cell).alias("cell"), F.col(trial).alias("trial"), metric(df, name).alias("value")).filter("value IS NOT NULL")
    return own.groupBy("cell", "trial").agg(F.avg("value").alias("value")).groupBy("cell").agg(F.avg("value").alias("mean_of_trial_means"), F.count("*").alias("n_trials"))


def trial_aggregate(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """Mean, population deviation, least and greatest over trials."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))


def paired(estimand: DataFrame, cell: str, reference: str) -> DataFrame:
    """example_id, a, b, delta of the examples that both cells have; `dropped` rows of either side are counted by pair_counts."""
    both = estimand.filter(F.col("cell").isin(cell, reference)).groupBy("example_id").agg(F.max(F.when(F.col("cell") == cell, F.col("value"))).alias("a"), F.max(F.when(F.col("cell") == reference, F.col("value"))).alias("b"))
    return both.withColumn("delta", F.col("a") - F.col("b"))


def win_loss_tie(pairs: DataFrame, *by: str, higher_is_better: bool = True, tolerance: float = 0.0) -> DataFrame:
    """Counts by sign of the delta, and pairs that lack a side."""
    better = F.col("delta") if higher_is_better else -F.col("delta")
    return pairs.groupBy(*by).agg(
        F.count("delta").alias("n_pairs"), F.count_if(better > tolerance).alias("wins"), F.count_if(better < -tolerance).alias("losses"),
        F.count_if(F.abs(better) <= tolerance).alias("ties"), F.count_if(F.col("delta").isNull()).alias("n_dropped"), F.avg("delta").alias("mean_delta"), F.median("delta").alias("median_delta"),
    )


def sign_flip_share(df: DataFrame, value: str) -> DataFrame:
    """Share of estimates against the median's sign; if the median is 0, of all that aren't 0."""
    middle = df.agg(F.median(value).alias("_m"))
    flips = F.when(F.col("_m") == 0, F.col(value) != 0).otherwise(F.signum(value) == -F.signum("_m"))
    return df.join(F.broadcast(middle)).agg(F.max("_m").alias("median"), F.avg(flips.cast("double")).alias("flip_share"))


def latency_summary(df: DataFrame, latency: str, *by: str) -> DataFrame:
    """Mean and exact percentiles (linear interpolation)."""
    own = [F.count(latency).alias("n"), F.avg(latency).alias("avg")] + [F.percentile(latency, F.lit(p)).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)]
    return df.groupBy(*by).agg(*own)


def performance(df: DataFrame, *by: str, ttft: str = "ttft_ms", total: str = "total_ms", tokens: str = "n_tokens", error: str = "error") -> DataFrame:
    """Rates over summed latency and percentiles of TTFT, TPOT and latency; TPOT only for more than one token after the first."""
    ok = df.filter(~is_error(F.col(error))).withColumn("_tpot", F.when((F.col(tokens) > 1) & (F.col(total) > F.col(ttft)), (F.col(total) - F.col(ttft)) / (F.col(tokens) - 1)))
    seconds = F.sum(total) / 1000
    out = [F.count("*").alias("n"), F.try_divide(F.count("*"), seconds).alias("qps"), F.try_divide(F.sum(tokens), seconds).alias("tps")]
    for name, c in (("ttft", ttft), ("tpot", "_tpot"), ("latency", total)):
        out += [F.avg(c).alias(f"avg_{name}")] + [F.percentile(c, F.lit(p)).alias(f"p{round(100 * p)}_{name}") for p in (0.5, 0.95, 0.99)]
    return ok.groupBy(*by).agg(*out)


def subset_summary(df: DataFrame, *by: str, latency: str, tokens: str, error: str) -> DataFrame:
    failed = is_error(F.col(error))
    good = lambda c: F.avg(F.when(~failed, F.col(c)))
    return df.groupBy(*by).agg(F.count("*").alias("n"), good(latency).alias("avg_latency"), good(tokens).alias("avg_tokens"), F.avg(failed.cast("double")).alias("error_rate"), F.try_divide(F.sum(F.when(~failed, F.col(tokens))), F.sum(F.when(~failed, F.col(latency))) / 1000).alias("tokens_per_s"))


def retrieval_summary(df: DataFrame, *by: str, rank: str = "gold_rank", measurable: str = "measurable") -> DataFrame:
    """Hit rate, mean reciprocal rank (a miss is 0) and top-1 rate over measurable rows."""
    own = df.filter(F.col(measurable))
    return own.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(rank).isNotNull().cast("double")).alias("hit_rate"), F.avg(F.coalesce(1 / F.col(rank), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce((F.col(rank) == 1).cast("double"), F.lit(0.0))).alias("top1"))


def cache_metrics(df: DataFrame, *by: str, kind: Column, fetch_ms: Column, size: Column) -> DataFrame:
    """Shares of local hits, remote hits and misses, mean remote fetch time and bytes moved; 0 without accesses."""
    n = F.count_if(kind.isin("local", "remote", "miss"))
    share = lambda k: F.coalesce(F.try_divide(F.count_if(kind == k).cast("double"), n), F.lit(0.0)).alias(f"{k}_ratio")
    remote = kind == "remote"
    return df.groupBy(*by).agg(n.alias("n_accesses"), share("local"), share("remote"), share("miss"), F.coalesce(F.avg(F.when(remote, fetch_ms)), F.lit(0.0)).alias("avg_remote_fetch_ms"), F.coalesce(F.sum(F.when(remote, size)), F.lit(0.0)).alias("bytes_moved"))


def prompt_cache(df: DataFrame, *by: str, prompt: str, cached: str) -> DataFrame:
    """Token sums, the cached share of all prompt tokens and of requests, and the median of uncached tokens."""
    return df.groupBy(*by).agg(F.sum(prompt).alias("prompt_tokens"), F.sum(cached).alias("cached_tokens"), F.try_divide(F.sum(cached), F.sum(prompt)).alias("cached_ratio"), F.avg((F.col(cached) > 0).cast("double")).alias("request_rate"), F.median(F.col(prompt) - F.col(cached)).alias("median_uncached"), F.count_if(F.col(cached).isNull()).alias("n_missing"))


def speculative(df: DataFrame, *by: str, draft: str, accepted: str, rollback: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_steps"), F.try_divide(F.sum(accepted), F.sum(draft)).alias("acceptance"), F.avg(draft).alias("avg_draft"), F.avg(accepted).alias("avg_accepted"), F.sum(rollback).alias("rollback_ms"), F.try_divide(F.sum(accepted) + F.count("*"), F.count("*")).alias("tokens_per_step"))


def staleness(df: DataFrame, *by: str, served: str = "served_from_cache", grounded: str = "grounded", stale: Column) -> DataFrame:
    """Unsafe-served, answer-hit, false-hit and stale-hit rates; rows without a verdict are left out, an empty base is null."""
    from_cache, verdict = F.coalesce(F.col(served), F.lit(False)), F.col(grounded)
    known = verdict.isNotNull()
    rate = lambda part, base: F.try_divide(F.count_if(part & base).cast("double"), F.count_if(base))
    return df.groupBy(*by).agg(
        rate(from_cache & ~verdict, known).alias("unsafe_served_rate"), (F.count_if(from_cache).cast("double") / F.nullif(F.count("*"), F.lit(0))).alias("answer_hit_rate"),
        rate(~verdict, known & from_cache).alias("false_hit_rate"), rate(~verdict, known & from_cache & F.coalesce(stale, F.lit(False))).alias("stale_hit_rate"),
    )


def quality_aggregate(df: DataFrame, metrics: list[str], *by: str) -> DataFrame:
    """metric, mean, n, n_none: one row for each metric, unpivoted."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), number(F.col(m)).alias("value")) for m in metrics]))
    return df.select(*by, values.alias("m")).select(*by, "m.*").groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("n_none"))


def gauge_summary(df: DataFrame, *by: str, ts: str, gauges: list[str], counters: list[str], energy: str | None = None) -> DataFrame:
    """Peak and mean of gauges, greatest of counters, last value, and energy from first to last sample."""
    out = []
    for g in gauges:
        out += [F.max(g).alias(f"{g}_peak"), F.round(F.avg(g), 4).alias(f"{g}_avg"), F.max_by(g, F.when(F.col(g).isNotNull(), F.col(ts))).alias(f"{g}_last")]
    out += [F.max(c).alias(f"{c}_max") for c in counters]
    if energy:
        at = F.when(F.col(energy).isNotNull(), F.col(ts))
        out.append((F.max_by(energy, at) - F.min_by(energy, at)).alias("energy"))
    return df.groupBy(*by).agg(*out)


def kv_bytes(tokens: Column, *, layers: int, heads: int, head_dim: int, dtype: Column, latent: int | None = None) -> Column:
    """Bytes of a cache: keys and values of every layer and head, or a latent vector of every layer."""
    width = F.when(dtype.isin("fp8", "int8"), 1).when(dtype.isin("fp16", "bf16"), 2).when(dtype == "fp32", 4)
    each = layers * latent if latent else 2 * layers * heads * head_dim
    return tokens * F.lit(each).cast("bigint") * width


def minmax_score(value: Column, window) -> Column:
    """0 to 100 within the window; 50 if all are equal."""
    low, high = F.min(value).over(window), F.max(value).over(window)
    return F.when(value.isNull(), None).when(high == low, 50.0).otherwise(100 * (value - low) / (high - low))


def pareto(df: DataFrame, x: str, y: str, *, minimize_x: bool = True, minimize_y: bool = True) -> DataFrame:
    """Points that no other dominates; equal points all stay.

    A point is dominated if a better x has at least its y, or its own x has a
    better y. Both follow from running minima over distinct x; partial minima
    over ranges of x go first, so no task sees all rows.
    """
    sx = F.col(x) if minimize_x else -F.col(x)
    sy = F.col(y) if minimize_y else -F.col(y)
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_x": sx.cast("double"), "_y": sy.cast("double")})
    best = known.groupBy("_x").agg(F.min("_y").alias("_best"))
    return known.join(_frontier(best), (known["_x"] == F.col("_fx")) & (known["_y"] == F.col("_fy"))).drop("_x", "_y", "_fx", "_fy")


def range_number(df: DataFrame, *order: str) -> Column:
    """Which of the ranges of the order a row falls into: 0, 1, ... The cuts are collected, one for each shuffle partition, so the number is the same whenever it is computed."""
    key = F.struct(*order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    begins = df.select(key.alias("p")).repartitionByRange(parts, "p").groupBy(F.spark_partition_id().alias("k")).agg(F.min("p").alias("p")).orderBy("p").collect()
    kinds = {f.name: f.dataType for f in df.select(*order).schema}
    cuts = [F.struct(*[F.lit(r["p"][c]).cast(kinds[c]).alias(c) for c in order]) for r in begins[1:]]
    return F.size(F.filter(F.array(*cuts), lambda p: p <= key)) if cuts else F.lit(0)


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Row numbers from 1 on within groups of any size: ranges of the order are counted first, and each numbers its own rows."""
    cut = df.withColumn("_range", range_number(df, *order))
    counts = cut.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_range").alias("_of"), before.alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)], F.col("_range") == F.col("_of"))
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return cut.withColumn("_own", own).join(starts, same).withColumn(name, F.col("_own") + F.col("_before")).select(*df.columns, name)


def _frontier(best: DataFrame) -> DataFrame:
    """Of (x, best y): the points below everything to their left. Ranges of x first, then their minima."""
    cut = best.withColumn("_part", range_number(best, "_x"))
    within = Window.partitionBy("_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range: what is best in the ranges before it
    least = cut.groupBy("_part").agg(F.min("_best").alias("_least"))
    across = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = least.select("_part", F.min("_least").over(across).alias("_earlier"))
    left = F.least(F.min("_best").over(within), F.col("_earlier"))
    final = cut.join(earlier, "_part").withColumn("_left", left).filter(F.col("_left").isNull() | (F.col("_best") < F.col("_left")))
    return final.select(F.col("_x").alias("_fx"), F.col("_best").alias("_fy"))
