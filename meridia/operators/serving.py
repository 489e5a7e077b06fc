"""Serving analytics: windows of requests, telemetry, onsets over rate sweeps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Multiples of the unloaded latency, regime thresholds, width of a resolution band.
TTFT_TIMES, TPOT_TIMES = 10.0, 5.0
OCCUPIED, ATTAINED = 0.9, 0.9
RESOLUTION = 1.15
COVERAGE, SAMPLES = 0.8, 2


def window_currencies(requests: DataFrame, *by: str, base_ttft: Column, base_tpot: Column, duration: Column) -> DataFrame:
    """Counts, rates and gaps of every measurement window: one aggregation.

    requests: ttft_s, tpot_s, ok, veridical (null only on failed requests).
    Completed requests must have finite latencies and a verdict; a failed one
    can't be veridical. A breach raises.
    """
    ok, verdict = F.col("ok"), F.coalesce(F.col("veridical"), F.lit(False))
    timely = ok & (F.col("ttft_s") <= TTFT_TIMES * base_ttft) & (F.col("tpot_s") <= TPOT_TIMES * base_tpot)
    bad = ok.isNull() | (ok & (F.col("veridical").isNull() | F.col("ttft_s").isNull() | F.col("tpot_s").isNull() | F.isnan("ttft_s") | F.isnan("tpot_s") | (F.col("ttft_s") < 0) | (F.col("tpot_s") < 0))) | (~ok & verdict)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counted = requests.groupBy(*by).agg(
        F.count("*").alias("n_issued"), n(ok).alias("n_completed"), n(timely).alias("n_timely"), n(verdict & ok).alias("n_veridical"), n(timely & verdict).alias("n_yield"),
        F.max(duration).cast("double").alias("duration_s"), F.count_if(bad).alias("_bad"),
    )
    checked = F.when((F.col("_bad") > 0) | ~(F.col("duration_s") > 0), F.raise_error(F.lit("a window breaks its contract")).cast("bigint")).otherwise(F.col("n_issued"))
    counted = counted.withColumn("n_issued", checked).drop("_bad")
    share = lambda c: F.col(c) / F.col("n_issued")
    rate = lambda c: F.col(c) / F.col("duration_s")
    null_frac = share("n_timely") * share("n_veridical")
    return counted.withColumns({
        "attainment": share("n_completed"), "throughput_rps": rate("n_completed"), "goodput_rps": rate("n_timely"), "yield_rps": rate("n_yield"),
        "goodput_frac": share("n_timely"), "yield_frac": share("n_yield"), "veridical_frac": share("n_veridical"),
        "independence_null_frac": null_frac, "independence_null_rps": rate("n_timely") * share("n_veridical"),
        "covariance_gap": share("n_yield") - null_frac, "covariance_gap_rps": rate("n_yield") - rate("n_timely") * share("n_veridical"),
        "truth_tax_rps": rate("n_timely") - rate("n_yield"), "truth_tax_frac": share("n_timely") - share("n_yield"),
    })


def trim(requests: DataFrame, *, warmup_s: float, measure_s: float | None = None, arrival: str = "arrival_s") -> DataFrame:
    """Requests whose intended arrival lies in [warmup, warmup + measure)."""
    kept = F.col(arrival) >= warmup_s
    return requests.filter(kept if measure_s is None else kept & (F.col(arrival) < warmup_s + measure_s))


def arrival_span(requests: DataFrame, *by: str, arrival: str = "arrival_s") -> DataFrame:
    return requests.groupBy(*by).agg((F.max(arrival) - F.min(arrival)).alias("duration_s"))


def dispatch_latencies(scheduled: Column, sent: Column, first: Column, done: Column) -> dict[str, Column]:
    """Lag of the scheduler, and latencies from the scheduled time and from sending."""
    return {"lag_s": sent - scheduled, "latency_s": done - scheduled, "ttft_s": first - scheduled, "send_latency_s": done - sent, "send_ttft_s": first - sent}


def zero_order_hold(samples: DataFrame, windows: DataFrame, *by: str, ts: str = "ts_s", gauge: str = "kv_cache_usage", counter: str = "preemptions_total") -> DataFrame:
    """Time-weighted gauge mean and counter growth in declared windows [t_start, t_end).

    A sample holds until the next or the window's end; the time before the first
    isn't covered. Samples find their windows by equi-join on `by` and a bucket
    of time as wide as the widest window, so the range condition only sorts out
    neighbours. ok is false with too few samples, too little coverage or a
    falling counter, and the mean is then null: nothing is dropped.
    """
    # one row: the width of a time bucket
    width = windows.agg(F.max(F.col("t_end") - F.col("t_start")).alias("w")).first()["w"] or 1.0
    bucket = lambda c: F.floor(c / F.lit(float(width))).cast("bigint")
    spread = windows.withColumn("_b", F.explode(F.array_distinct(F.array(bucket(F.col("t_start")), bucket(F.col("t_end"))))))
    held = samples.withColumn("_b", bucket(F.col(ts))).join(spread, [*by, "_b"])
    held = held.filter((F.col(ts) >= F.col("t_start")) & (F.col(ts) < F.col("t_end")))
    order = Window.partitionBy(*by, "t_start", "t_end").orderBy(ts, gauge, counter)
    held = held.withColumn("_hold", F.coalesce(F.lead(ts).over(order), F.col("t_end")) - F.col(ts)).withColumn("_fell", F.col(counter) < F.lag(counter).over(order))
    found = held.groupBy(*by, "t_start", "t_end").agg(
        F.count("*").alias("n_samples"), F.try_divide(F.sum(F.col("_hold") * F.col(gauge)), F.sum("_hold")).alias("_mean"), (F.max_by(counter, F.col(ts)) - F.min_by(counter, F.col(ts))).alias("_events"),
        (F.sum("_hold") / (F.col("t_end") - F.col("t_start"))).alias("coverage"), F.coalesce(F.bool_or("_fell"), F.lit(False)).alias("_fell"), F.count_if(F.col(gauge).isNull()).alias("_null"),
    )
    every = windows.select(*by, "t_start", "t_end").distinct().join(found, [*by, "t_start", "t_end"], "left")
    ok = (F.coalesce("n_samples", F.lit(0)) >= SAMPLES) & (F.coalesce("coverage", F.lit(0.0)) >= COVERAGE - 1e-12) & ~F.coalesce("_fell", F.lit(False)) & (F.coalesce("_null", F.lit(0)) == 0)
    return every.select(*by, "t_start", "t_end", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), ok.alias("telemetry_ok"), F.when(ok, F.col("_mean")).alias("rho_kv"), F.when(ok, F.col("_events")).alias("scarcity_events"))


def regime(rho: Column, events: Column, attainment: Column, ok: Column | None = None) -> Column:
    """PAST_CLIFF before UNPRESSURED before IN_REGIME; uncertified telemetry is unknown, a missing attainment null."""
    label = F.when(attainment.isNull(), None).when(attainment < ATTAINED, "PAST_CLIFF").when((rho < OCCUPIED) | (events == 0), "UNPRESSURED").otherwise("IN_REGIME")
    return label if ok is None else F.when(~ok, "UNKNOWN_TELEMETRY").otherwise(label)


def _within(lo: Column, hi: Column, resolution: float | None) -> Column:
    return F.lit(True) if resolution is None else hi / lo <= resolution * resolution * (1 + 1e-9)


def _vertex(x0: Column, y0: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Abscissa of the parabola's vertex through three points."""
    a, b, u, v = x1 - x0, x1 - x2, y1 - y0, y1 - y2
    return x1 - (a * a * v - b * b * u) / (2 * (a * v - b * u))


def _neighbours(sweep: DataFrame, by: tuple[str, ...], rate: str, power: Column) -> DataFrame:
    """Each point with its neighbours by rate; duplicate rates refuse."""
    order = Window.partitionBy(*by).orderBy(rate)
    whole = Window.partitionBy(*by)
    own = sweep.withColumn("_p", power)
    own = own.withColumns({"_lo": F.lag(rate).over(order), "_hi": F.lead(rate).over(order), "_pl": F.lag("_p").over(order), "_ph": F.lead("_p").over(order), "_top": F.max("_p").over(whole), "_n": F.count("*").over(whole)})
    twice = F.col("_lo") == F.col(rate)
    return own.withColumn("_p", F.when(twice, F.raise_error(F.lit("duplicate rate")).cast("double")).otherwise(F.col("_p")))


def knee(sweep: DataFrame, *by: str, rate: str = "offered_rate", throughput: str = "throughput", latency: str = "latency", alpha: float = 1.0, resolution: float | None = RESOLUTION) -> DataFrame:
    """Power maximum of every sweep: label, onset_rate, grid_rate, lo, hi.

    A plateau or too wide a bracket is INCONCLUSIVE_AT_RESOLUTION, a maximum at
    an edge NOT_BRACKETED.
    """
    peaks = _neighbours(sweep, by, rate, F.pow(throughput, F.lit(alpha)) / F.col(latency)).filter("_p = _top")
    first = peaks.groupBy(*by).agg(F.count("*").alias("_peaks"), F.min_by(F.struct(F.col(rate).cast("double").alias("x"), "_lo", "_hi", "_pl", "_p", "_ph"), F.col(rate)).alias("m"))
    edge, plateau = F.col("m._lo").isNull() | F.col("m._hi").isNull(), F.col("_peaks") > 1
    fits = _within(F.col("m._lo"), F.col("m._hi"), resolution)
    label = F.when(plateau, "INCONCLUSIVE_AT_RESOLUTION").when(edge, "NOT_BRACKETED").when(~fits, "INCONCLUSIVE_AT_RESOLUTION").otherwise("ESTIMATED")
    vertex = _vertex(*[F.col(f"m.{c}") for c in ("_lo", "_pl", "x", "_p", "_hi", "_ph")])
    bracketed = ~plateau & ~edge
    return first.select(*by, label.alias("label"), F.when(label == "ESTIMATED", F.greatest(F.col("m._lo"), F.least(F.col("m._hi"), vertex))).alias("onset_rate"), F.col("m.x").alias("grid_rate"), F.when(bracketed, F.col("m._lo")).alias("lo"), F.when(bracketed, F.col("m._hi")).alias("hi"))


def cliff(sweep: DataFrame, *by: str, rate: str = "offered_rate", goodput: str = "goodput", resolution: float | None = RESOLUTION) -> DataFrame:
    """The first rate at which goodput strictly falls, or NOT_OBSERVED."""
    points = _neighbours(sweep, by, rate, F.col(goodput).cast("double"))
    falls = F.col("_p") < F.col("_pl")
    first = points.groupBy(*by).agg(F.min(F.when(falls, F.struct(F.col(rate).cast("double").alias("hi"), F.col("_lo").cast("double").alias("lo")))).alias("m"))
    label = F.when(F.col("m").isNull(), "NOT_OBSERVED").when(_within(F.col("m.lo"), F.col("m.hi"), resolution), "ESTIMATED").otherwise("INCONCLUSIVE_AT_RESOLUTION")
    return first.select(*by, label.alias("label"), F.when(label == "ESTIMATED", F.col("m.hi")).alias("onset_rate"), F.col("m.hi").alias("grid_rate"), F.col("m.lo").alias("lo"), F.col("m.hi").alias("hi"))


def grid_onset(sweep: DataFrame, *by: str, rate: str = "offered_rate", power: str = "power") -> DataFrame:
    """First greatest power with quadratic interpolation; at an edge INCONCLUSIVE-AT-RESOLUTION. (Its plateau rule and label differ from the knee's on purpose.)"""
    points = _neighbours(sweep, by, rate, F.col(power).cast("double")).filter("_p = _top")
    first = points.groupBy(*by).agg(F.min_by(F.struct(F.col(rate).cast("double").alias("x"), "_lo", "_hi", "_pl", "_p", "_ph"), F.col(rate)).alias("m"))
    edge = F.col("m._lo").isNull() | F.col("m._hi").isNull()
    flat = (F.col("m._p") == F.col("m._pl")) & (F.col("m._p") == F.col("m._ph"))
    vertex = _vertex(*[F.col(f"m.{c}") for c in ("_lo", "_pl", "x", "_p", "_hi", "_ph")])
    onset = F.when(edge, None).when(flat, F.col("m.x")).otherwise(F.greatest(F.col("m._lo"), F.least(F.col("m._hi"), vertex)))
    return first.select(*by, F.when(edge, "INCONCLUSIVE-AT-RESOLUTION").otherwise("ESTIMATED").alias("label"), onset.alias("onset_rate"), F.col("m.x").alias("grid_rate"))


LADDER = "label string, lambda_star double, sustained_rate double, first_unsustainable double, n_steps bigint"


def ladder_decision(steps: DataFrame, key: str, *, rate: str = "rate", attainment: str = "attainment", throughput: str = "throughput", least: float = ATTAINED) -> DataFrame:
    """The last bracket of every probe ladder.

    A step is sustained if its attainment suffices and its throughput isn't below
    the last sustained one's. That state depends on itself, so it is folded over
    the ladder's few steps, sorted.
    """
    own = steps.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(rate).cast("double").alias("rate"), F.col(attainment).cast("double").alias("a"), F.col(throughput).cast("double").alias("t")))).alias("steps"))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<boolean>").alias("held"))

    def step(state: Column, s: Column) -> Column:
        held = (s["a"] >= least) & (state["last"].isNull() | (s["t"] >= state["last"]))
        return F.struct(F.when(held, s["t"]).otherwise(state["last"]).alias("last"), F.array_append(state["held"], held).alias("held"))

    own = own.withColumn("held", F.aggregate("steps", start, step)["held"])
    pairs = F.zip_with("steps", "held", lambda s, h: F.struct(s["rate"].alias("rate"), h.alias("held")))
    own = own.withColumn("pairs", pairs)
    following = F.transform(F.col("pairs"), lambda p, k: F.struct(p["rate"].alias("rate"), F.get(F.col("pairs"), k + 1)["rate"].alias("next"), (p["held"] & ~F.coalesce(F.get(F.col("pairs"), k + 1)["held"], F.lit(True))).alias("breaks")))
    own = own.withColumn("breaks", F.filter(following, lambda p: p["breaks"])).withColumn("last", F.try_element_at("breaks", F.lit(-1)))
    sustained = F.array_max(F.transform(F.filter("pairs", lambda p: p["held"]), lambda p: p["rate"]))
    label = F.when(F.col("last").isNotNull(), "ESTIMATED").when(sustained.isNull(), "NONE_SUSTAINABLE").otherwise("LADDER_EXHAUSTED")
    return own.select(
        key, label.alias("label"), F.col("last.rate").alias("lambda_star"), F.coalesce(F.col("last.rate"), sustained).alias("sustained_rate"),
        F.coalesce(F.col("last.next"), F.when(sustained.isNull(), F.get(F.col("pairs"), F.lit(0))["rate"])).alias("first_unsustainable"), F.size("steps").cast("bigint").alias("n_steps"),
    )


def slo_floor(requests: DataFrame, *by: str, ttft_ms: str = "ttft_ms", tpot_ms: str = "tpot_ms", least: int = 30) -> DataFrame:
    """Medians in seconds of rows that have both; refused with fewer than `least`."""
    own = requests.filter(F.col(ttft_ms).isNotNull() & F.col(tpot_ms).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), (F.percentile(ttft_ms, F.lit(0.5)) / 1000).alias("ttft_s"), (F.percentile(tpot_ms, F.lit(0.5)) / 1000).alias("tpot_s"))
    return own.withColumn("n", F.when(F.col("n") < least, F.raise_error(F.lit("too few requests for a floor")).cast("bigint")).otherwise(F.col("n")))


def arrivals(spark, rates: list[float], *, seed: int, duration_s: float) -> DataFrame:
    """Poisson arrivals of every rate, each from a child seed: rate, k, arrival_s. One task for each rate."""
    import numpy as np

    children = np.random.SeedSequence(seed).spawn(len(rates))
    grid = spark.createDataFrame([(float(r), int(c.generate_state(1, np.uint64)[0] >> 1)) for r, c in zip(rates, children)], "rate double, seed bigint").repartition(max(1, len(rates)))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rate, own in zip(frame["rate"], frame["seed"]):
                rng, at, k = np.random.default_rng(own), 0.0, 0
                while at < duration_s:
                    gaps = at + np.cumsum(rng.exponential(1 / rate, 4096))
                    inside = gaps[gaps < duration_s]
                    if len(inside):
                        yield pd.DataFrame({"rate": rate, "k": np.arange(k, k + len(inside)), "arrival_s": inside})
                    k, at = k + len(inside), float(gaps[-1])

    return grid.mapInPandas(draw, "rate double, k bigint, arrival_s double")


def rate_ladder(start: float, *, factor: float = 1.3, steps: int = 12) -> list[float]:
    """Geometric probe rates."""
    if start <= 0 or factor <= 1 or steps < 1:
        raise ValueError("a ladder needs a positive start, a factor above 1 and a step")
    return [start * factor**k for k in range(steps)]
