"""Experiment statistics: tests by group, multiplicity, calibration, power.

Counts, rank sums and corrections are window functions and aggregates; p-values
come from a group's one row of sums. Rows are never gathered: a bootstrap of a
mean runs over blocks of distinct values, a two-layer equivalence test over
sums by window. Only a bootstrap of a median and a posterior see a group at
once, and of it only the distinct values with their counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.functions import distributions as dist
from meridia.functions import kernels


#: Values that are sent whole to every task (16 MB).
MOST_VALUES = 2_000_000


#: Distinct values in one task of a bootstrap.
BLOCK_VALUES = 1 << 17


def by_group(values: DataFrame, key: str, schema: str, kernel: Callable[[pd.DataFrame], dict], order: list[str]) -> DataFrame:
    """A kernel's row for each group of counted values or sums; they come in a fixed order, so that draws repeat."""
    kind = values.schema[key].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values(order, kind="stable")
        return pd.DataFrame([{key: own[key].iloc[0], **kernel(own)}])

    return values.groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")


def from_sums(sums: DataFrame, columns: list[str], schema: str, test: Callable[..., dict]) -> DataFrame:
    """A test's results beside each row of sums, as struct `_test`."""
    names = [part.split()[0] for part in schema.split(", ")]

    @F.pandas_udf(f"struct<{schema.replace(' ', ':').replace(',:', ',')}>")
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([test(**row) for row in rows.to_dict("records")], columns=names)

    return sums.withColumn("_test", run(F.struct(*columns)))


def whole_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs whose difference is a number: a missing or NaN side is no pair."""
    return pairs.filter(_delta().isNotNull() & ~F.isnan(_delta().cast("double")))


def _delta() -> Column:
    return F.col("a") - F.col("b")


def wilcoxon(pairs: DataFrame, key: str, *, alternative: str = "two-sided", zeros: str = "pratt") -> DataFrame:
    """pairs: key, example_id, a, b. Ranks and sums by windows over distinct |delta|; the p of a group comes from one row."""
    sums = _signed_ranks(whole_pairs(pairs), key)

    def test(n_pairs: int, n_pos: int, n_neg: int, n_zero: int, w_plus: float, w_minus: float, _ties: float, _most: int, _few: list) -> dict:
        # zeros rank first, so without them every rank is less by their number
        plus, minus, n = w_plus - n_zero * n_pos, w_minus - n_zero * n_neg, n_pos + n_neg
        few = np.array([r["rank"] - n_zero for r in _few for _ in range(r["n"])])
        if zeros == "pratt":
            own = kernels.signed_rank_test(n_pairs, n_zero, w_plus, w_minus, _ties, exact=False, ranks=few, alternative=alternative, zeros=zeros)
        else:
            own = kernels.signed_rank_test(n, 0, plus, minus, _ties, exact=n_zero == 0 and _most == 1, ranks=few, alternative=alternative, zeros=zeros)
        return {"statistic": own[0], "p": own[1], "delta": (n_pos - n_neg) / n_pairs, "rank_biserial": (plus - minus) / (plus + minus) if n else 0.0}

    columns = ["n_pairs", "n_pos", "n_neg", "n_zero", "w_plus", "w_minus", "_ties", "_most", "_few"]
    return from_sums(sums, columns, "statistic double, p double, delta double, rank_biserial double", test).select(key, "n_pairs", "n_pos", "n_neg", "n_zero", "_test.*")


def _signed_ranks(pairs: DataFrame, *by: str) -> DataFrame:
    """Counts, Pratt's rank sums and ties; `_few` holds the ranks of groups that have few differences, for exact tests."""
    counted = pairs.groupBy(*by, F.abs(_delta()).alias("_d")).agg(F.count("*").alias("_t"), F.count_if(F.col("a") > F.col("b")).alias("_plus"), F.count_if(F.col("a") < F.col("b")).alias("_minus"))
    order = Window.partitionBy(*by).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.when(F.col("_d") != 0, F.col("_t"))).over(Window.partitionBy(*by))
    rank = F.coalesce(F.sum("_t").over(order), F.lit(0)) + (F.col("_t") + 1) / 2
    t, some = F.col("_t").cast("double"), F.col("_d") != 0
    few = some & (F.col("_left") <= kernels.PERMUTED_PAIRS)
    return counted.withColumns({"_r": rank, "_left": left}).groupBy(*by).agg(
        F.sum("_t").alias("n_pairs"), F.sum("_plus").alias("n_pos"), F.sum("_minus").alias("n_neg"), F.coalesce(F.sum(F.when(F.col("_d") == 0, F.col("_t"))), F.lit(0)).alias("n_zero"),
        F.sum(F.col("_r") * F.col("_plus")).alias("w_plus"), F.sum(F.col("_r") * F.col("_minus")).alias("w_minus"),
        F.coalesce(F.sum(F.when(some, t * t * t - t)), F.lit(0.0)).alias("_ties"), F.coalesce(F.max(F.when(some, F.col("_t"))), F.lit(0)).alias("_most"),
        F.sort_array(F.collect_list(F.when(few, F.struct(F.col("_r").alias("rank"), F.col("_t").alias("n"))))).alias("_few"),
    )


def signed_rank_sums(pairs: DataFrame, *by: str) -> DataFrame:
    """Pratt's rank sums, mean, variance and z in plain aggregates: ranks over distinct |delta| only.

    Groups of any size: rows are counted by |delta| and sign first, and ranks
    come from running sums over these counts.
    """
    summed = _signed_ranks(pairs, *by)
    n, z = F.col("n_pairs").cast("double"), F.col("n_zero").cast("double")
    mean = (n * (n + 1) - z * (z + 1)) / 4
    var = (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - F.col("_ties") / 2) / 24
    off = F.greatest(F.abs(F.col("w_plus") - mean) - 0.5, F.lit(0.0))
    return summed.withColumns({"w_mean": mean, "w_var": var, "z": F.try_divide(off, F.sqrt(var))}).select(*by, "n_pairs", "n_zero", "w_plus", "w_minus", "w_mean", "w_var", "z")


def mann_whitney_sums(values: DataFrame, *by: str, group: str = "side", value: str = "value") -> DataFrame:
    """U and Cliff's delta of side a against b, by counts of distinct values."""
    counted = values.groupBy(*by, value).agg(F.count("*").alias("_t"), F.count_if(F.col(group) == "a").alias("_a"), F.count_if(F.col(group) == "b").alias("_b"))
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_r", F.coalesce(F.sum("_t").over(order), F.lit(0)) + (F.col("_t") + 1) / 2)
    own = counted.groupBy(*by).agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"), F.sum(F.col("_r") * F.col("_a")).alias("_ra"))
    u = F.col("_ra") - F.col("n_a") * (F.col("n_a") + 1) / 2
    return own.withColumn("u", u).withColumn("cliffs_delta", F.try_divide(2 * F.col("u"), F.col("n_a") * F.col("n_b")) - 1).drop("_ra")


def mcnemar_counts(pairs: DataFrame, *by: str) -> DataFrame:
    """The 2 x 2 counts of boolean a and b."""
    a, b = F.col("a"), F.col("b")
    own = pairs.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.count_if(a & b).alias("n11"), F.count_if(~a & ~b).alias("n00"), F.count_if(a & ~b).alias("n10"), F.count_if(~a & b).alias("n01"))
    return own.withColumn("diff", (F.col("n10") - F.col("n01")) / F.col("n_pairs"))


def mcnemar(pairs: DataFrame, *by: str, alternative: str = "two-sided") -> DataFrame:
    """Counts and the exact p, which needs no more than the counts."""

    @F.pandas_udf("double")
    def exact(n10: pd.Series, n01: pd.Series) -> pd.Series:
        return pd.Series([1.0 if a + b == 0 else dist.binomial_test(int(a), int(a + b), alternative) for a, b in zip(n10, n01)])

    return mcnemar_counts(pairs, *by).withColumn("p", exact("n10", "n01"))


def welch_stats(means: DataFrame, *by: str, side: str = "side", value: str = "value") -> DataFrame:
    """t and df of window means, sides a and b, in plain aggregates; more than 50 windows refuse."""
    pick = lambda s: F.when(F.col(side) == s, F.col(value))
    own = means.groupBy(*by).agg(*[f(pick(s)).alias(f"{n}_{s}") for s in "ab" for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    own = own.withColumn("n_a", F.when(F.greatest("n_a", "n_b") > kernels.MOST_WINDOWS, F.raise_error(F.lit("more values than windows")).cast("bigint")).otherwise(F.col("n_a")))
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    return own.withColumns({"mean_diff": F.col("mean_a") - F.col("mean_b"), "t": F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(va + vb)), "df": F.try_divide((va + vb) * (va + vb), va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))})


def bootstrap_ci(values: DataFrame, key: str, *, statistic: str = "mean", iters: int = 10_000, seed: int = 42, block_values: int = BLOCK_VALUES) -> DataFrame:
    """Percentile interval of each key's mean or median. values: key, value; nulls and NaN are left out.

    Equal values are counted first. For the mean they are dealt into blocks of
    about block_values; as many draws as there are rows go to the blocks by one
    multinomial draw an iteration, then within a block to its values, and the
    blocks' sums are added up: the draws of one large multinomial, in many tasks.
    A median needs its distinct values in order, so they meet in one task.
    """
    counted = values.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).groupBy(key, F.col("value").cast("double").alias("value")).agg(F.count("*").alias("_t"))
    if statistic == "median":

        def kernel(own: pd.DataFrame) -> dict:
            x, counts = own["value"].to_numpy(), own["_t"].to_numpy()
            low, high = kernels.bootstrap_ci(x, "median", iters, seed, counts=counts)
            return {"n": int(counts.sum()), "estimate": float(kernels.counted_statistic(x, counts, "median")), "low": low, "high": high}

        return by_group(counted, key, "n bigint, estimate double, low double, high double", kernel, ["value"])
    kind = counted.schema[key].dataType.simpleString()
    own = counted.withColumn("_block", F.pmod(F.xxhash64("value"), F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy(key)) / block_values))).cast("int"))
    blocks = own.groupBy(key, "_block").agg(F.sum("_t").alias("_n"))

    def dealt(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_block")
        draws = kernels.resampled(frame["_n"].to_numpy(), iters, np.random.default_rng(seed))
        return pd.DataFrame({key: frame[key], "_block": frame["_block"], "_draws": list(np.concatenate(list(draws)).T)})

    draws = blocks.groupBy(key).applyInPandas(dealt, f"{key} {kind}, _block int, _draws array<bigint>")

    def summed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({key: [], "_k": [], "_sum": []})
        left = left.sort_values("value")
        x, counts, many = left["value"].to_numpy(), left["_t"].to_numpy(), right["_draws"].iloc[0]
        rng = np.random.default_rng([seed, int(left["_block"].iloc[0]) + 1])
        step = max(1, (1 << 22) // len(x))
        sums = np.concatenate([rng.multinomial(many[k : k + step], counts / counts.sum()) @ x for k in range(0, iters, step)])
        return pd.DataFrame({key: left[key].iloc[0], "_k": np.arange(iters), "_sum": sums})

    sums = own.groupBy(key, "_block").cogroup(draws.groupBy(key, "_block")).applyInPandas(summed, f"{key} {kind}, _k int, _sum double")
    total = blocks.groupBy(key).agg(F.sum("_n").alias("n")).join(counted.groupBy(key).agg(F.sum(F.col("value") * F.col("_t")).alias("_all")), key)
    ends = sums.groupBy(key, "_k").agg(F.sum("_sum").alias("_sum")).groupBy(key).agg(F.percentile("_sum", F.array(F.lit(0.025), F.lit(0.975))).alias("_p"))
    return total.join(ends, key).select(key, "n", (F.col("_all") / F.col("n")).alias("estimate"), (F.col("_p")[0] / F.col("n")).alias("low"), (F.col("_p")[1] / F.col("n")).alias("high"))


def tost(pairs: DataFrame, key: str, *, margin: float, windows: bool = False, iters: int = 10_000, seed: int = 42) -> DataFrame:
    """pairs: key, example_id, a, b, event, and window_id with `windows`. One row of sums by window, or by key, reaches the test."""
    own = pairs.withColumn("_d", F.when(F.col("event"), _delta())).withColumn("_w", F.col("window_id").cast("string") if windows else F.lit(""))
    summed = own.groupBy(key, "_w").agg(
        F.count("*").alias("n_total"), F.count("_d").cast("double").alias("n"), F.coalesce(F.sum("_d"), F.lit(0.0)).cast("double").alias("total"),
        F.coalesce(F.var_pop("_d") * F.count("_d"), F.lit(0.0)).alias("apart"), F.count_if(F.col("_d") > 0).cast("double").alias("up"), F.count_if(F.col("_d") < 0).cast("double").alias("down"),
    )

    def kernel(frame: pd.DataFrame) -> dict:
        held = frame[frame["n"] > 0]
        sums = {c: held[c].to_numpy(dtype=float) for c in ("n", "total", "apart", "up", "down")}
        return {"n_total": int(frame["n_total"].sum()), **kernels.tost_from_sums(sums, margin, iters=iters, seed=seed, by_window=windows)}

    schema = "n_total bigint, n_events bigint, n_discordant bigint, mean_diff double, p double, domain string, dominance double, low double, high double, dominance_verdict string"
    return by_group(summed, key, schema, kernel, ["_w"])


def rope(pairs: DataFrame, key: str, *, width: float, windows: bool = False, samples: int = 2_000, seed: int = 42) -> DataFrame:
    """pairs as for `tost`. A draw weighs every two differences, so a key's distinct ones (by window, with `windows`) meet in one task, with their counts."""
    own = pairs.withColumn("_d", F.when(F.col("event"), _delta()).cast("double")).withColumn("_w", F.col("window_id").cast("string") if windows else F.lit(""))
    counted = own.groupBy(key, "_w", "_d").agg(F.count("*").alias("_t"))

    def kernel(frame: pd.DataFrame) -> dict:
        held = frame[frame["_d"].notna()]
        return {"n_total": int(frame["_t"].sum()), **kernels.rope(held["_d"].to_numpy(), width, samples=samples, seed=seed, windows=held["_w"].to_numpy() if windows else None, counts=held["_t"].to_numpy())}

    return by_group(counted, key, "n_total bigint, n_events bigint, p_left double, p_rope double, p_right double, verdict string", kernel, ["_w", "_d"])


def holm(df: DataFrame, *by: str, p: str = "p", seq: str = "seq", registered: int | None = None) -> DataFrame:
    """Step-down adjusted p in each family; with `registered` tests, the missing ones count as p = 1."""
    order = Window.partitionBy(*by).orderBy(p, seq)
    m = F.lit(registered) if registered else F.count("*").over(Window.partitionBy(*by))
    scaled = (m - F.row_number().over(order) + 1) * F.col(p)
    return df.withColumn("_s", scaled).withColumn("p_holm", F.least(F.lit(1.0), F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def benjamini_hochberg(df: DataFrame, *by: str, p: str = "p", seq: str = "seq") -> DataFrame:
    order = Window.partitionBy(*by).orderBy(p, seq)
    scaled = F.col(p) * F.count("*").over(Window.partitionBy(*by)) / F.row_number().over(order)
    down = Window.partitionBy(*by).orderBy(F.desc(p), F.desc(seq)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_s", scaled).withColumn("p_bh", F.least(F.lit(1.0), F.min("_s").over(down))).drop("_s")


def _by_score(df: DataFrame, by: tuple[str, ...], score: str, label: str) -> DataFrame:
    return df.groupBy(*by, F.col(score).alias("_s")).agg(F.count("*").alias("_t"), F.sum(F.col(label)).cast("bigint").alias("_pos"))


def roc_auc(df: DataFrame, *by: str, score: str = "score", label: str = "label") -> DataFrame:
    """By midranks of distinct scores; null if only one class is present."""
    counted = _by_score(df, by, score, label)
    before = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("_r", F.coalesce(F.sum("_t").over(before), F.lit(0)) + (F.col("_t") + 1) / 2)
    own = ranked.groupBy(*by).agg(F.sum("_pos").alias("n_pos"), (F.sum("_t") - F.sum("_pos")).alias("n_neg"), F.sum(F.col("_r") * F.col("_pos")).alias("_rs"))
    return own.withColumn("auc", F.try_divide(F.col("_rs") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos") * F.col("n_neg"))).drop("_rs")


def tau_precision(df: DataFrame, *by: str, floor: float = 0.9, score: str = "score", label: str = "label") -> DataFrame:
    """The least observed score whose tail (ties together) has the precision, with recall and specificity."""
    counted = _by_score(df, by, score, label)
    down = Window.partitionBy(*by).orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    tail = counted.withColumns({"tp": F.sum("_pos").over(down), "predicted": F.sum("_t").over(down), "_p": F.sum("_pos").over(whole), "_n": F.sum("_t").over(whole)})
    fits = tail.filter(F.col("tp") / F.col("predicted") >= floor - 1e-12)
    best = fits.groupBy(*by).agg(F.min_by(F.struct(F.col("_s").alias("tau"), "tp", "predicted", "_p", "_n"), "_s").alias("m"))
    fp, neg = F.col("m.predicted") - F.col("m.tp"), F.col("m._n") - F.col("m._p")
    return best.select(*by, "m.tau", (F.col("m.tp") / F.col("m.predicted")).alias("precision"), F.try_divide(F.col("m.tp"), F.col("m._p")).alias("recall"), (1 - F.try_divide(fp, neg)).alias("specificity"), F.col("m.predicted").alias("n_predicted"))


def tau_balanced(df: DataFrame, *by: str, score: str = "score", bad: str = "hallucinated", band: float = 0.01) -> DataFrame:
    """score < tau flags; the tau of best balanced accuracy, the least of equals, and the band within `band` of it."""
    counted = _by_score(df, by, score, bad)
    below = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    swept = counted.withColumns({"_tp": F.coalesce(F.sum("_pos").over(below), F.lit(0)), "_flagged": F.coalesce(F.sum("_t").over(below), F.lit(0)), "_p": F.sum("_pos").over(whole), "_n": F.sum("_t").over(whole)})
    sensitivity = F.try_divide(F.col("_tp"), F.col("_p"))
    specificity = 1 - F.try_divide(F.col("_flagged") - F.col("_tp"), F.col("_n") - F.col("_p"))
    swept = swept.withColumn("_ba", F.round((sensitivity + specificity) / 2, 12)).withColumn("_best", F.max("_ba").over(whole))
    return swept.groupBy(*by).agg(F.min(F.when(F.col("_ba") == F.col("_best"), F.col("_s"))).alias("tau"), F.max("_best").alias("balanced_accuracy"), F.min(F.when(F.col("_ba") >= F.col("_best") - band, F.col("_s"))).alias("band_low"), F.max(F.when(F.col("_ba") >= F.col("_best") - band, F.col("_s"))).alias("band_high"))


def length_bin(length: Column, edges: list[float]) -> Column:
    """[1k, 4k) labels; the last bin is open."""
    name = lambda x: f"{x / 1000:g}k" if x >= 1000 else f"{x:g}"
    out = F.lit(None).cast("string")
    for lo, hi in reversed(list(zip(edges, [*edges[1:], None]))):
        inside = length >= lo if hi is None else (length >= lo) & (length < hi)
        out = F.when(inside, f"[{name(lo)}, {'inf' if hi is None else name(hi)})").otherwise(out)
    return out


def corrected_rate(apparent: Column, sensitivity: Column, specificity: Column) -> Column:
    """The true share behind an instrument's; an uninformative one refuses."""
    youden = sensitivity + specificity - 1
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (apparent + specificity - 1) / youden))
    return F.when(youden <= 0, F.raise_error(F.lit("uninformative instrument")).cast("double")).otherwise(raw)


def drift(calibration: DataFrame, recheck: DataFrame, tau: float, *, item: str = "item_id", score: str = "score") -> DataFrame:
    """Mean absolute change and flips at tau; both sides must hold the same items."""
    both = calibration.select(item, F.col(score).alias("_a")).join(recheck.select(item, F.col(score).alias("_b")), item, "full_outer")
    lone = F.count_if(F.col("_a").isNull() | F.col("_b").isNull())
    n = F.when(lone > 0, F.raise_error(F.lit("items differ")).cast("bigint")).otherwise(F.count("*"))
    return both.agg(n.alias("n"), F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("mean_abs_delta"), F.avg(((F.col("_a") >= tau) != (F.col("_b") >= tau)).cast("double")).alias("flip_rate"))


def collision_probability(df: DataFrame, value: str, *by: str) -> DataFrame:
    counted = df.groupBy(*by, value).agg(F.count("*").cast("double").alias("_c"))
    return counted.groupBy(*by).agg((F.sum(F.col("_c") * F.col("_c")) / (F.sum("_c") * F.sum("_c"))).alias("collision_probability"))


def power_table(spark: SparkSession, effects: list[float], sizes: list[int], *, sims: int, seed: int, deviation: float = 1.0, tie_share: float = 0.0, alpha: float = 0.05, injection: str = "shift") -> DataFrame:
    """Rejection share of the signed-rank test over an effect x n grid, a point a task, each from a child seed."""
    grid = [(e, n) for e in effects for n in sizes]
    children = np.random.SeedSequence(seed).spawn(len(grid))
    points = spark.createDataFrame([(float(e), int(n), int(c.generate_state(1, np.uint64)[0] >> 1)) for (e, n), c in zip(grid, children)], "effect double, n int, seed bigint").repartition(max(1, len(grid)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for effect, n, own in frame.itertuples(index=False):
                rng, rejected = np.random.default_rng(own), 0
                for _ in range(sims):
                    d = rng.normal(0, deviation, n) * (rng.random(n) >= tie_share)
                    if injection == "shift":
                        d = d + effect
                    else:
                        ties = np.flatnonzero(d == 0)
                        d[rng.choice(ties, size=int(round(effect * len(ties))), replace=False)] = 1.0
                    rejected += kernels.wilcoxon(d, zeros="wilcox")[1] < alpha
                low, high = dist.clopper_pearson(rejected, sims)
                out.append((effect, n, sims, rejected / sims, low, high))
            yield pd.DataFrame(out, columns=["effect", "n", "n_sims", "power", "low", "high"])

    return points.mapInPandas(run, "effect double, n int, n_sims int, power double, low double, high double")


def with_normal_p(tested: DataFrame, z: str) -> DataFrame:
    """The two-sided p of a normal z, one row at a time over few rows."""

    @F.pandas_udf("double")
    def p_of(values: pd.Series) -> pd.Series:
        return pd.Series([None if np.isnan(v) else min(1.0, 2 * dist.normal_sf(abs(v))) for v in values], dtype="float64")

    return tested.withColumn("p", p_of(F.col(z).cast("double")))


def required_n(power: DataFrame, *by: str, target: float = 0.8) -> DataFrame:
    """The least n of the grid that reaches the power, or a label."""
    own = power.groupBy(*by).agg(F.min(F.when(F.col("power") >= target, F.col("n"))).alias("required_n"))
    return own.withColumn("status", F.when(F.col("required_n").isNull(), "NOT_REACHED").otherwise("REACHED"))


def split_half(values: DataFrame, *, splits: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """A/A: random halves tested against each other; split, p, rejected. At most MOST_VALUES values, which are sent to the tasks; more refuse."""
    spark = values.sparkSession
    if (n := values.count()) > MOST_VALUES:
        raise ValueError(f"{n} values are too many to be permuted in a task; test window means instead")
    sent = spark.sparkContext.broadcast(np.array([r[0] for r in values.select("value").orderBy("value").collect()], dtype=float))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for split in frame["id"]:
                rng = np.random.default_rng([seed, int(split)])
                x = rng.permutation(sent.value)
                half = len(x) // 2
                p = kernels.wilcoxon(x[:half] - x[half : 2 * half], zeros="wilcox")[1]
                out.append((int(split), p, p < alpha))
            yield pd.DataFrame(out, columns=["split", "p", "rejected"])

    return spark.range(splits).mapInPandas(run, "split bigint, p double, rejected boolean")
