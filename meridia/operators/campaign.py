"""Campaign analysis: registries, matching, merges, gates and whole reports.

Registries (metrics, contrasts, families) are a few dozen rows; tables of requests
and evidence stay distributed throughout.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.functions import distributions as dist
from meridia.functions import kernels
from meridia.functions import text as tx
from meridia.operators import inference as st
from meridia.operators import integrity as ig
from meridia.operators import results as rs

# Metrics that are better when lower; the other known ones are better when higher.
LOWER = ("ttft_ms", "latency_ms", "avg_tpot_ms", "tpot_ms", "hallucinated_span_ratio", "hallucination_detected")
HIGHER = (
    "faithfulness", "grounding_score", "supported_claim_ratio", "context_relevance", "relevance", "completeness_bertscore", "completeness_rouge_l", "f1_score", "exact_match", "precision", "recall",
    "f1_answerable", "exact_match_answerable", "no_answer_correct", "abstention_precision", "cached_prompt_ratio",
)
# Contrasts as (id, side a, side b, family, tier, sidedness, unit).
CONTRASTS = (
    (1, "B1", "B2", "F1", "secondary", "one-sided", "per_query"), (2, "B4", "B3", "F1", "secondary", "one-sided", "per_query"), (3, "B1", "B6", "F1", "secondary", "one-sided", "per_query"),
    (4, "B6", "B3", "F1", "primary", "two-sided", "per_query"), (5, "B5", "B6", "F1", "secondary", "one-sided", "per_query"), (6, "B5", None, "F1", "secondary", "two-sided", "per_query"),
    (7, "B9", "B6", "F1", "secondary", "one-sided", "per_query"), (8, "B10", "B3", "F1", "secondary", "two-sided", "per_query"), (9, "B8", "B6", "F1", "secondary", "two-sided", "per_query"),
    (10, "B3", None, "F1", "secondary", "two-sided", "per_query"), (11, None, None, "F1", "exploratory", "two-sided", "per_query"), (12, None, None, "F2", "falsification", "two-sided", "window"),
    (13, None, None, "F2", "primary", "one-sided", "window"), (14, None, None, "F2", "primary", "one-sided", "window"), (15, "B11", "B6", "F2", "secondary", "one-sided", "window"),
    (16, None, None, "F2", "exploratory", "two-sided", "window"), (17, "B3", None, "F3", "secondary", "one-sided", "window"), (18, None, None, "DIST", "secondary", "two-sided", "window"),
    (19, "B3", None, "DIST", "exploratory", "two-sided", "window"), (20, None, None, "DIST", "secondary", "one-sided", "window"),
)
# The serial order of the primary endpoints, and the correction of each tier.
PRIMARY_ORDER = (4, 14, 13)
CORRECTION = {"primary": "gatekeeping", "secondary": "holm", "exploratory": "bh", "falsification": "none"}
# Realized sample sizes that a plan may step down to.
LADDER = (2000, 1600, 1200)


# --- registries


def direction(metric: str) -> bool:
    """Whether more is better; an unknown metric refuses."""
    if metric in LOWER or metric in HIGHER:
        return metric in HIGHER
    raise ValueError(f"unknown metric {metric}")


def contrasts(spark: SparkSession) -> DataFrame:
    names = ("contrast_id", "baseline_a", "baseline_b", "family", "tier", "sidedness", "unit")
    kinds = ("int", *["string"] * 6)
    rows = [F.struct(*[F.lit(x).cast(k).alias(n) for x, n, k in zip(r, names, kinds)]) for r in CONTRASTS]
    return spark.range(1).select(F.inline(F.array(*rows)))


def classify(registry: DataFrame) -> DataFrame:
    """Why a contrast isn't a plain pair of baselines, or null."""
    reason = F.when(F.col("tier") == "falsification", "falsification-suite").when(F.col("baseline_a").isNull() & F.col("baseline_b").isNull(), "no-baseline-pair").when(F.col("baseline_b").isNull(), "one-sided-selector").when(F.col("unit") == "window", "window-unit")
    return registry.withColumn("reason", reason)


def resolve_ids(registry: DataFrame, wanted: Iterable[int]) -> DataFrame:
    """The wanted contrasts once each, in order; an unknown one refuses."""
    ids = list(dict.fromkeys(wanted))
    unknown = set(ids) - {r[0] for r in CONTRASTS}
    if unknown:
        raise ValueError(f"unknown contrasts {sorted(unknown)}")
    return registry.filter(F.col("contrast_id").isin(ids)).orderBy(F.array_position(F.array(*map(F.lit, ids)), F.col("contrast_id")))


def family_sizes(family_map: DataFrame) -> DataFrame:
    return family_map.groupBy("family_id").agg(F.count("*").alias("m"), F.sort_array(F.collect_set("tier")).alias("tiers"))


def registered(rows: DataFrame, family_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose (contrast, metric, dataset) is registered, and the excluded ones."""
    keys = ["contrast_id", "metric", "dataset"]
    return rows.join(family_map.select(*keys), keys, "left_semi"), rows.join(family_map.select(*keys), keys, "left_anti")


# --- matching and merging


def match_pairs(index: DataFrame, a: str, b: str, axes: list[str]) -> DataFrame:
    """Cells of baseline a with references of b on equal axes, null-safe, and their common datasets.

    More than one cell on a side is ambiguous and refuses.
    """
    own = index.filter(F.col("baseline").isin(a, b)).groupBy(*axes).agg(
        F.collect_set(F.when(F.col("baseline") == a, F.col("row_key"))).alias("cells"), F.collect_set(F.when(F.col("baseline") == b, F.col("row_key"))).alias("refs"),
        F.array_sort(F.array_intersect(F.collect_set(F.when(F.col("baseline") == a, F.col("dataset"))), F.collect_set(F.when(F.col("baseline") == b, F.col("dataset"))))).alias("datasets"),
    )
    both = own.filter((F.size("cells") > 0) & (F.size("refs") > 0))
    many = (F.size("cells") > 1) | (F.size("refs") > 1)
    cell = F.when(many, F.raise_error(F.lit("a pair is ambiguous")).cast("string")).otherwise(F.get("cells", F.lit(0)))
    return both.select(*axes, cell.alias("cell"), F.get("refs", F.lit(0)).alias("reference"), "datasets")


def pooled_fields(artifacts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Numbers of several files merged by key: same-named fields pool their values, booleans count as 0 and 1."""
    long = None
    for df in artifacts:
        fields = [c for c, t in df.dtypes if c not in keys and t in ("int", "bigint", "float", "double", "boolean")]
        values = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("int").cast("double").alias("value") if t == "boolean" else rs.number(F.col(c)).alias("value")) for c, t in df.dtypes if c in fields]))
        one = df.select(*keys, values.alias("x")).select(*keys, "x.*").filter("value IS NOT NULL")
        long = one if long is None else long.unionByName(one)
    return long.groupBy(*keys, "field").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def request_predicates(requests: DataFrame, predicates: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with their verdicts; an unscored success refuses, an unscored failure isn't veridical."""
    new = predicates.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], F.col("predicate").alias("_p"))
    on = F.lit(True)
    for j, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{j}"))
    joined = requests.join(new, on, "left")
    missing = F.col("ok") & F.col("_p").isNull()
    verdict = F.when(missing, F.raise_error(F.lit("a completed request has no verdict")).cast("boolean")).otherwise(F.coalesce("_p", F.lit(False)) & F.col("ok"))
    return joined.withColumn("veridical", verdict).select(*requests.columns, "veridical")


def unblind(rows: DataFrame, mapping: DataFrame, token: str = "token") -> DataFrame:
    """Labels for tokens; the map must be one to one and know every token."""
    # one row
    n = mapping.agg(F.count("*").alias("n"), F.count_distinct(token).alias("t"), F.count_distinct("label").alias("l")).first()
    if not n["n"] == n["t"] == n["l"]:
        raise ValueError("the map isn't one to one")
    joined = rows.join(mapping, token, "left")
    return joined.withColumn("label", F.coalesce("label", F.raise_error(F.concat(F.lit("unknown token "), F.col(token))).cast("string")))


def scrambled(labels: list[str], seed: int) -> dict[str, str]:
    """Sorted labels to ARM-nn in a seeded order."""
    own = sorted(set(labels))
    random.Random(seed).shuffle(own)
    return {x: f"ARM-{k:02d}" for k, x in enumerate(own, 1)}


def significance(cells: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Table cells with the p of their comparison, if any, and a star below 0.05."""
    return cells.join(comparisons.select("baseline", "metric", "p"), ["baseline", "metric"], "left").withColumn("mark", F.when(F.col("p") < 0.05, "*").otherwise(""))


def legacy_bridge(rows: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pilot rows under their cells, with accounting by window; names outside the map are listed."""
    known = rows.join(F.broadcast(mapping), "name")
    counted = known.groupBy("row_key", "dataset", "window").agg(F.count("*").alias("n_rows"), F.count_if(rs.is_error(F.col("error"))).alias("n_errors"))
    return counted, rows.join(F.broadcast(mapping.select("name")), "name", "left_anti").select("name").distinct()


def dataset_of(name: Column) -> Column:
    """The dataset that a run's name ends with."""
    return F.nullif(F.regexp_extract(name, r"(squad_v2|hotpotqa|musique|qasper|triviaqa|nq|crag|hpc)(?:-\d+)?$", 1), F.lit(""))


def select_manifest(examples: DataFrame, ids: list[str], key: str = "id") -> DataFrame:
    """A trial's examples in manifest order; a missing one refuses. ids come from one document."""
    wanted = examples.sparkSession.createDataFrame([(k, x) for k, x in enumerate(ids)], f"_at int, {key} string")
    joined = wanted.join(examples.withColumn("_known", F.lit(True)), key, "left")
    at = F.when(F.col("_known"), F.col("_at")).otherwise(F.raise_error(F.concat(F.lit("not in the dataset: "), F.col(key))).cast("int"))
    return joined.withColumn("_at", at).orderBy("_at").drop("_at", "_known")


def build_manifest(examples: pd.DataFrame, *, queries: int, trials: int, seed: int, budget: int = 2800, target: int | None = None) -> dict:
    """Blocks of shared paragraphs and seeded trial draws. examples (id, context list): a campaign's question set, on the driver.

    Groups of equal contexts are shuffled; a block takes groups in order until one
    doesn't fit, then the next block begins; a group beyond the budget is left out.
    """
    wanted = target or max(3 * queries, queries * trials)
    groups: dict[tuple, list[str]] = {}
    for own, context in zip(examples["id"], examples["context"]):
        groups.setdefault(tuple(context), []).append(own)
    order = list(groups)
    random.Random(seed).shuffle(order)
    size = lambda paragraphs: len("\n\n".join(paragraphs).split()) * 4 // 3
    blocks: list[list[str]] = []
    placed: dict[str, int] = {}
    excluded: list[str] = []
    fresh = True
    for context in order:
        if len(placed) >= wanted and fresh:
            break
        if size(context) > budget:
            excluded += groups[context]
            continue
        joined = [*(blocks[-1] if blocks else []), *[p for p in context if not blocks or p not in blocks[-1]]]
        if not blocks or size(joined) > budget:
            if len(placed) >= wanted:
                break
            blocks.append(list(dict.fromkeys(context)))
        else:
            blocks[-1] = joined
        placed |= {x: len(blocks) - 1 for x in groups[context]}
    drawn, disjoint = _draws(list(placed), queries, trials, seed)
    said = ["\n\n".join(b) for b in blocks]
    used = [len(text.split()) * 4 // 3 for text in said]
    stats = {"n_blocks": len(blocks), "n_placed": len(placed), "n_excluded": len(excluded), "mean_tokens": sum(used) / len(used) if used else None, "most_tokens": max(used, default=None)}
    return {"blocks": blocks, "block_texts": said, "block_tokens": used, "question_to_block": placed, "trials": drawn, "disjoint": disjoint, "excluded": excluded, "stats": stats}


def _draws(pool: list[str], queries: int, trials: int, seed: int) -> tuple[dict[str, list[str]], bool]:
    """Each trial's questions, and whether no question is in two trials.

    Questions are ranked by a digest of a seed and their id. If the pool allows it,
    one ranking under the campaign's seed is cut into trials; else trial t (from 1)
    takes the first of its own ranking, under seed + t - 1.
    """
    if len(pool) < queries:
        raise ValueError("the pool is smaller than a trial")
    ranked = lambda s: sorted(pool, key=lambda x: hashlib.sha256(f"{s}:{x}".encode()).digest())
    disjoint, whole = len(pool) >= queries * trials, ranked(seed)
    cut = {t: whole[(t - 1) * queries : t * queries] if disjoint else ranked(seed + t - 1)[:queries] for t in range(1, trials + 1)}
    return {str(t): own for t, own in cut.items()}, disjoint


def registration_gates(registered: dict, used: dict, *, text: str) -> list[str]:
    """What keeps a confirmatory analysis from running: reasons, none if it may.

    registered: sha256 (of the registration's text), alpha, metrics, margins (by
    metric); used: alpha, metrics, margin, equivalence_metric. Metrics count as a
    set. A margin is registration content: it can only repeat the registered one.
    """
    reasons, sha = [], str(registered.get("sha256", ""))
    if not re.fullmatch("[0-9a-f]{64}", sha):
        reasons.append("the registered digest is no SHA-256")
    elif hashlib.sha256(text.encode()).hexdigest() != sha:
        reasons.append("the registration differs from its digest")
    if used.get("alpha") != registered.get("alpha"):
        reasons.append("alpha is not the registered one")
    if set(used.get("metrics") or ()) != set(registered.get("metrics") or ()):
        reasons.append("the metrics are not the registered ones")
    metric, margin, margins = used.get("equivalence_metric"), used.get("margin"), registered.get("margins") or {}
    if metric is None and margin is not None:
        reasons.append("a margin without its metric")
    elif metric is not None and metric not in margins:
        reasons.append("no margin is registered for the metric")
    elif margin is not None and margin != margins[metric]:
        reasons.append("the margin is not the registered one")
    return reasons


def registered_margin(registered: dict, used: dict) -> float | None:
    """The margin an equivalence test uses: the registered one of its metric; None without a metric."""
    return (registered.get("margins") or {}).get(used.get("equivalence_metric"))


def resolve_predicates(trees: DataFrame, ledgers: DataFrame, *, wanted: str | None = None) -> DataFrame:
    """The predicate table that each run's analysis joins: run, tree; refused if there is doubt.

    trees: run, tree, raw_sha256 (the raw ledger it was built from), own_sha256 and
    sealed_sha256 (its files' ledger now, and when it was sealed); ledgers: run,
    sha256. A run without trees has none (null). Several need `wanted` to name one.
    """
    named = trees if wanted is None else trees.filter(F.col("tree") == wanted)
    own = named.groupBy("run").agg(F.count("*").alias("_n"), F.min_by(F.struct("tree", "raw_sha256", "own_sha256", "sealed_sha256"), "tree").alias("_t"))
    joined = ledgers.join(own, "run", "left")
    refuse = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), F.col("run"))).cast("string")
    n = F.coalesce("_n", F.lit(0))
    tree = (
        F.when((n == 0) & F.lit(wanted is not None), refuse("no such predicate table"))
        .when(n == 0, None)
        .when(n > 1, refuse("several predicate tables, name one"))
        .when(F.col("_t.sealed_sha256").isNull() | ~F.col("_t.own_sha256").eqNullSafe(F.col("_t.sealed_sha256")), refuse("a predicate table fails its seal"))
        .when(~F.col("_t.raw_sha256").eqNullSafe(F.col("sha256")), refuse("a predicate table was built from other evidence"))
        .otherwise(F.col("_t.tree"))
    )
    return joined.select("run", tree.alias("tree"))


# --- checks


def verdict_value(c: Column) -> Column:
    """Blank is null, booleans are 0 and 1; anything else that isn't a number refuses."""
    raw = F.lower(F.trim(c.cast("string")))
    value = F.when(raw == "true", 1.0).when(raw == "false", 0.0).otherwise(raw.try_cast("double"))
    blank = F.coalesce(raw, F.lit("")) == ""
    return F.when(blank, None).when(value.isNull(), F.raise_error(F.concat(F.lit("not a verdict: "), c.cast("string"))).cast("double")).otherwise(value)


def event_mask(c: Column) -> Column:
    raw = F.lower(F.trim(c.cast("string")))
    return F.when(raw.isin("true", "1", "1.0"), 1.0).when(raw.isin("false", "0", "0.0"), 0.0)


def window_accounting(rows: DataFrame, *by: str) -> DataFrame:
    """Errors, failures, empties, unknown and known valid rows."""
    error, empty = rs.is_error(F.col("error")), rs.is_empty_generation(F.col("empty_generation"))
    ok = F.col("ok")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(error).alias("n_error"), F.count_if(ok == False).alias("n_failed"), F.count_if(empty).alias("n_empty"), F.count_if(ok.isNull()).alias("n_unknown"),  # noqa: E712
        F.count_if(F.coalesce(ok, F.lit(False)) & ~error & ~empty).alias("n_valid"),
    )


def metric_coverage(rows: DataFrame, metrics: list[str], *by: str) -> DataFrame:
    """How many rows have each metric."""
    return rs.quality_aggregate(rows, metrics, *by).select(*by, "metric", "n", "n_none")


def reproducibility(answers: DataFrame, *by: str, answer: str = "answer") -> DataFrame:
    """Keys with two or more repeats, and those whose answers differ."""
    keyed = answers.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(answer).alias("d"))
    return keyed.filter("n >= 2").agg(F.count("*").alias("n_repeated"), F.count_if(F.col("d") > 1).alias("n_violations"))


def answer_changing(arm: Column | str, reference: Column | str, gold: Column | None = None) -> Column:
    """Whether a divergence changes the answer: against the gold by exact match, F1 or abstention; else the two against each other."""
    a, b = tx.sanitize_answer(arm), tx.sanitize_answer(reference)
    pairwise = F.when(tx.is_abstention(a) != tx.is_abstention(b), True).when(tx.is_abstention(a), False).otherwise(tx.normalize_answer(a) != tx.normalize_answer(b))
    if gold is None:
        return pairwise
    one, two = tx.token_f1(a, gold), tx.token_f1(b, gold)
    changed = (one["exact_match"] != two["exact_match"]) | (F.abs(one["f1"] - two["f1"]) > 1e-9) | (one["predicted_no_answer"] != two["predicted_no_answer"])
    return F.when(gold.isNull(), pairwise).otherwise(changed)


def relevance_share(blocks: Column, reference: Column, threshold: float = 0.3) -> Column:
    """Share of blocks that overlap the reference; 0 without blocks."""
    scores = F.transform(blocks, lambda x: tx.jaccard(x, reference))
    return F.when(F.size(blocks) == 0, 0.0).otherwise(F.size(F.filter(scores, lambda s: s >= threshold)) / F.size(blocks))


def guard_injection(values: DataFrame, kind: str, value: str = "value", most: float = 0.05) -> None:
    """A shift needs values that rarely collide, a flip needs binary ones."""
    own = st.collision_probability(values, value).first()["collision_probability"]
    binary = values.filter(~F.col(value).isin(0.0, 1.0)).limit(1).count() == 0
    if kind == "shift" and own > most:
        raise ValueError(f"values collide with probability {own:.3f}")
    if kind == "flip" and not binary:
        raise ValueError("a flip needs binary values")


def no_replay(arrivals: DataFrame, unique_requests: int) -> int:
    """The number of arrivals; more than unique requests refuse."""
    n = arrivals.count()
    if n > unique_requests:
        raise ValueError(f"{n} arrivals for {unique_requests} requests")
    return n


def probe_attainment(steps: DataFrame) -> DataFrame:
    bad = ~(F.col("intended") > 0)
    return steps.withColumn("attainment", F.when(bad, F.raise_error(F.lit("a probe without requests")).cast("double")).otherwise(F.col("completed") / F.col("intended")))


def realized_n(pairs: DataFrame, *by: str, accepted: int = LADDER[-1]) -> DataFrame:
    """n by row, the step of the ladder that it reaches, and whether that suffices."""
    step = F.lit(None).cast("int")
    for n in sorted(LADDER):
        step = F.when(F.col("n") >= n, n).otherwise(step)
    return pairs.groupBy(*by).agg(F.count("*").alias("n")).withColumn("step", step).withColumn("ok", F.coalesce(F.col("step") >= accepted, F.lit(False)))


def binding(requirements: DataFrame, *by: str, value: str = "required_n") -> DataFrame:
    """The greatest requirement; one that was never reached dominates."""
    own = requirements.groupBy(*by).agg(F.max(value).alias("_m"), F.bool_or(F.col(value).isNull()).alias("_never"))
    return own.select(*by, F.when(~F.col("_never"), F.col("_m")).alias(value), F.when(F.col("_never"), "NOT_REACHED").otherwise("REACHED").alias("status"))


def in_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows in a fixed order of names, others after them by name."""
    at = F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(column)), F.lit(0))
    return df.orderBy(F.coalesce(at, F.lit(len(order) + 1)), column)


def rows_per_cell(df: DataFrame, *by: str) -> DataFrame:
    """The least and greatest number of rows of a cell, as a label."""
    counted = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    return counted.withColumn("label", F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("-", "low", "high")))


def newest(events: DataFrame, n: int, *, by: str, ts: str) -> DataFrame:
    """A ring buffer's content: the n newest rows of each key."""
    return events.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(ts), *[c for c in events.columns if c not in (by, ts)]))).filter(F.col("_k") <= n).drop("_k")


def progress(files: DataFrame, expected: int) -> DataFrame:
    """Rows by results file, the newest file, and the share done. files: path, n_rows, modified."""
    return files.agg(F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows"), F.max_by("path", "modified").alias("newest"), (F.sum("n_rows") / expected).alias("done"))


# --- reports


def pair_statistics(pairs: DataFrame, *, metric: str, alternative: str = "two-sided") -> DataFrame:
    """By dataset: the signed-rank test, wins and losses in the metric's direction, Holm over datasets. pairs: dataset, example_id, a, b."""
    tested = st.wilcoxon(pairs, "dataset", alternative=alternative)
    counts = rs.win_loss_tie(pairs.withColumn("delta", F.col("a") - F.col("b")), "dataset", higher_is_better=direction(metric)).select("dataset", "wins", "losses", "ties", "median_delta")
    return st.holm(tested.join(counts, "dataset").withColumn("seq", F.col("dataset")))


def window_statistics(means: DataFrame, key: str, alternative: str = "two-sided") -> DataFrame:
    """Welch tests of window means, a group each: at most 50 windows a side. means: key, side, window_id, value."""

    schema = "mean_diff double, t double, df double, p double, low double, high double"
    test = lambda **sums: kernels.welch_test(**sums, alternative=alternative)
    columns = [f"{c}_{side}" for side in "ab" for c in ("n", "mean", "var")]
    few = F.least("n_a", "n_b") < 2
    own = st.welch_stats(means, key).withColumn("n_a", F.when(few, F.raise_error(F.lit("a variance needs two windows")).cast("bigint")).otherwise(F.col("n_a")))
    return st.from_sums(own, columns, schema, test).select(key, "_test.*")


def fingerprint(legs: DataFrame, m: int = 3) -> DataFrame:
    """Registered legs' p, Holm at m with missing legs at 1, and their intersection-union maximum. legs: leg, p."""
    adjusted = st.holm(legs.withColumn("seq", F.col("leg")), registered=m)
    return adjusted.withColumn("p_max", F.when(F.count("*").over(Window.partitionBy(F.lit(0))) < m, 1.0).otherwise(F.max("p").over(Window.partitionBy(F.lit(0))))).select("leg", "p", "p_holm", "p_max")


def equivalence_pairs(rows: DataFrame, policy: str, reference: str = "none") -> DataFrame:
    """Policy against reference by (example, window): event if either side had one; pairs without a mask are counted apart."""
    pick = lambda p, c: F.max(F.when(F.col("policy") == p, F.col(c)))
    both = rows.filter(F.col("policy").isin(policy, reference)).groupBy("example_id", "window_id").agg(pick(policy, "value").alias("a"), pick(reference, "value").alias("b"), F.max("event").alias("event"))
    return both.withColumn("status", F.when(F.col("a").isNull() | F.col("b").isNull(), "UNPAIRED").when(F.col("event").isNull(), "NO_MASK").otherwise("PAIRED"))


def truth_tax(windows: DataFrame, anchor: str) -> DataFrame:
    """Engines against the anchor over in-regime windows: Welch on the tax, Holm over engines, and the maximum p."""
    own = windows.filter("regime = 'IN_REGIME'").select("engine", "window_id", (F.col("goodput_frac") - F.col("yield_frac")).alias("value"))
    base = own.filter(F.col("engine") == anchor).select(F.col("window_id"), "value")
    others = own.filter(F.col("engine") != anchor).withColumn("side", F.lit("a"))
    # the anchor's windows (50 at most) go to every engine of the registry
    engines = others.select("engine").distinct()
    against = engines.join(F.broadcast(base.limit(kernels.MOST_WINDOWS + 1)), F.lit(True)).withColumn("side", F.lit("b"))
    tested = window_statistics(others.unionByName(against), "engine")
    return st.holm(tested.withColumn("seq", F.col("engine"))).withColumn("p_max", F.max("p").over(Window.partitionBy(F.lit(0))))


def truth_tax_pool(requests: DataFrame) -> DataFrame:
    """g: TTFT within ten times the median; y: exact match; g - y of each request."""
    middle = requests.agg(F.percentile("ttft_ms", F.lit(0.5)).alias("_m"))
    own = requests.join(F.broadcast(middle)).withColumn("g", (F.col("ttft_ms") <= 10 * F.col("_m")).cast("double"))
    return own.select("example_id", "g", F.col("exact_match").alias("y"), (F.col("g") - F.col("exact_match")).alias("tax"))


def exploratory(rows: DataFrame) -> DataFrame:
    """Benjamini-Hochberg over all exploratory rows. rows: seq, tier, p."""
    return st.benjamini_hochberg(rows.filter("tier = 'exploratory'"))


def calibrate(anchor: DataFrame, *, floor: float = 0.9, auc_floor: float = 0.8, edges: tuple = (0, 1000, 4000, 16000)) -> DataFrame:
    """One row: tau at the precision floor, AUC over all and in the worst length bin, and whether the instrument passes. anchor: item_id, score, label, context_length."""
    binned = anchor.withColumn("bin", st.length_bin(F.col("context_length"), list(edges)))
    bins = st.roc_auc(binned, "bin").agg(F.min("auc").alias("worst_bin_auc"), F.count_if(F.col("auc").isNull()).alias("n_unusable_bins"))
    whole = st.roc_auc(anchor).select("n_pos", "n_neg", "auc")
    tau = st.tau_precision(anchor, floor=floor).select("tau", "precision", "recall")
    # single rows
    row = whole.join(F.broadcast(bins), F.lit(True)).join(F.broadcast(tau), F.lit(True), "left")
    return row.withColumn("passed", F.col("tau").isNotNull() & (F.col("n_unusable_bins") == 0) & (F.col("worst_bin_auc") >= auc_floor))


def specification_curve(estimates: DataFrame, *, estimate: str = "estimate") -> DataFrame:
    """Estimates in rank order, with whether they oppose the median's sign."""
    middle = estimates.agg(F.median(estimate).alias("_m"))
    order = [estimate, *[c for c in estimates.columns if c != estimate]]
    ranked = rs.numbered(estimates, [], order, "rank").join(F.broadcast(middle))
    return ranked.withColumn("opposes", F.signum(estimate) == -F.signum("_m")).drop("_m")


def scoring_pass(evidence: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Evidence to scores: the last row of every key, answers sanitized and scored, failures kept without scores."""
    own = ig.keep_last(evidence, keys, order)
    scored = own.withColumn("_s", tx.best_token_f1(tx.sanitize_answer("answer"), F.col("golds")))
    failed = rs.is_error(F.col("error"))
    out = scored.withColumn("sanitized_answer", tx.sanitize_answer("answer"))
    for c in ("f1", "precision", "recall", "exact_match"):
        out = out.withColumn(c, F.when(~failed, F.col(f"_s.{c}")))
    return out.drop("_s")


def split_half_interval(rejected: int, splits: int, alpha: float = 0.05) -> tuple[float, float, bool]:
    """Exact interval of an A/A rejection rate, and whether it holds the nominal level."""
    low, high = dist.clopper_pearson(rejected, splits)
    return low, high, low <= alpha <= high
