"""Reconciling joins, censuses, coverage, ledgers, predicates, blinding, cells."""

from __future__ import annotations

import hashlib
import hmac
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The axes of a cell and their vocabularies.
AXES = {
    "arm": ("gold-fresh", "gold-reuse", "corpus-fresh", "corpus-reuse", "retr-fresh", "retr-reuse", "retr-store", "retr-comp", "corpus-comp", "retr-trunc", "corpus-trunc"),
    "retriever": ("dense", "rerank", "bm25", "rrf", "none"),
    "policy": ("none", "recompute", "evict", "offload", "compress-fp8"),
    "topology": ("single", "tp", "pd"),
    "engine": ("vllm", "sglang", "lmdeploy", "hf"),
    "model": ("qwen3-14b", "llama-3.3-70b", "qwen3-next-80b", "deepseek-v3"),
    "family": ("F1", "F2", "F3", "DIST"),
}
FAMILY_ARMS = {
    "F1": AXES["arm"],
    "F2": ("gold-fresh", "retr-fresh", "retr-comp", "retr-trunc"),
    "F3": ("gold-reuse", "corpus-reuse", "corpus-fresh", "retr-reuse", "retr-store", "corpus-comp", "corpus-trunc"),
    "DIST": ("corpus-reuse", "gold-fresh"),
}
# Numbered baselines as (id, arm, retriever, reuse).
BASELINES = (
    ("B1", "gold-fresh", "none", "fresh"), ("B2", "gold-reuse", "none", "reuse"), ("B3", "corpus-reuse", "none", "reuse"), ("B4", "corpus-fresh", "none", "reuse"),
    ("B5", "retr-fresh", "dense", "fresh"), ("B6", "retr-fresh", "rerank", "fresh"), ("B7", "retr-reuse", "rerank", "reuse"), ("B8", "retr-store", "rerank", "reuse"),
    ("B9", "retr-comp", "rerank", "fresh"), ("B10", "corpus-comp", "none", "reuse"), ("B11", "retr-trunc", "rerank", "fresh"), ("B12", "corpus-trunc", "none", "reuse"),
)
# Which verdict a dataset has.
VERDICTS = {"squad_v2": "exact_match", "hotpotqa": "exact_match", "musique": "exact_match", "qasper": "grounding_score"}


# --- identity


def duplicate_census(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys seen more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def reconciliation(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every key with its rows on either side, null-safe: one aggregation, so a hot key isn't joined."""
    sides = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    counted = sides.groupBy(*keys).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))
    status = F.when((F.col("n_left") > 1) | (F.col("n_right") > 1), "DUPLICATE").when(F.col("n_right") == 0, "LEFT_ONLY").when(F.col("n_left") == 0, "RIGHT_ONLY").otherwise("MATCHED")
    return counted.withColumn("status", status)


def identity_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One to one on null-safe keys; duplicates and rows without a partner on either side refuse."""
    bad = reconciliation(left, right, keys).filter("status <> 'MATCHED'").groupBy("status").count().collect()  # three rows at most
    if bad:
        raise ValueError("rows don't reconcile: " + ", ".join(f"{r['status']} {r['count']}" for r in sorted(bad, key=lambda r: r["status"])))
    new = right.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)])
    return left.join(new, on).drop(*[f"_k{j}" for j in range(len(keys))])


def coverage(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """What is missing and what is extra."""
    found = reconciliation(expected.select(*keys).distinct(), observed.select(*keys).distinct(), keys)
    return found.filter("status <> 'MATCHED'").select(*keys, F.when(F.col("status") == "LEFT_ONLY", "MISSING").otherwise("EXTRA").alias("finding"))


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of every key, and how many it replaced; of rows that are equally late, the greatest by its other columns."""
    rest = [c for c in df.columns if c not in keys]
    ties = [c for c in rest if c != order and not re.search("map|variant|interval", df.schema[c].dataType.simpleString())]
    own = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *ties)).alias("_last"), (F.count("*") - 1).alias("n_dropped"))
    return own.select(*keys, "_last.*", "n_dropped")


def merge_scores(rows: DataFrame, scores: DataFrame, keys: list[str], columns: list[str], failed: Column) -> DataFrame:
    """Scores replace the rows' own where there are any; failed rows stay as they are."""
    new = scores.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], *[F.col(c).alias(f"_s_{c}") for c in columns])
    on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)])
    joined = rows.join(new, on, "left")
    picked = {c: F.when(failed, F.col(c)).otherwise(F.coalesce(F.col(f"_s_{c}"), F.col(c))) for c in columns}
    return joined.withColumns(picked).select(*rows.columns)


# --- predicates


def window_predicate(rows: DataFrame, *, dataset: str = "dataset", ok: str = "ok", exact: str = "exact_match", grounding: str = "grounding_score", tau: float = 0.5) -> DataFrame:
    """predicate and reason: exact match for span answers, grounding at tau for long papers; null with a reason otherwise."""
    spans = [d for d, v in VERDICTS.items() if v == "exact_match"]
    value = F.when(F.col(dataset).isin(spans), F.col(exact) == 1).when(F.col(dataset).isin("qasper"), F.col(grounding) >= tau)
    known = F.col(dataset).isin(*VERDICTS)
    reason = F.when(~known, "no_predicate").when(~F.col(ok), "not_ok").when(value.isNull(), "missing_verdict")
    return rows.withColumn("predicate", F.when(reason.isNull(), value)).withColumn("reason", reason)


def predicate_summary(rows: DataFrame, *by: str) -> DataFrame:
    n = F.count("*")
    return rows.groupBy(*by).agg(n.alias("n"), F.count_if("predicate").alias("n_true"), F.count_if(~F.col("predicate")).alias("n_false"), F.count_if(F.col("predicate").isNull()).alias("n_null"), (F.count_if(F.col("predicate").isNull()) / n).alias("null_fraction"))


# --- ledgers


def ledger(spark: SparkSession, path: str, *, pattern: str | None = None) -> DataFrame:
    """path and sha256 of every file below a folder; files are read by tasks, one row each."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.sha2("content", 256).alias("sha256"))


def verify_ledger(sealed: DataFrame, found: DataFrame) -> DataFrame:
    """MISSING, EXTRA and HASH-MISMATCH findings."""
    both = sealed.select("path", F.col("sha256").alias("_a")).join(found.select("path", F.col("sha256").alias("_b")), "path", "full_outer")
    finding = F.when(F.col("_b").isNull(), "MISSING").when(F.col("_a").isNull(), "EXTRA").when(F.col("_a") != F.col("_b"), "HASH-MISMATCH")
    return both.select("path", finding.alias("finding")).filter("finding IS NOT NULL")


def seal(entries: dict[str, str]) -> str:
    """The ledger's own digest, over its sorted entries."""
    return hashlib.sha256("\n".join(f"{k}\t{v}" for k, v in sorted(entries.items())).encode()).hexdigest()


# --- blinding


def blinding_map(labels: list[str], salt: bytes) -> dict[str, str]:
    """Label to token; refused unless one to one. Labels are a registry's, not a table's."""
    tokens = {x: hmac.new(salt, x.encode(), hashlib.sha256).hexdigest()[:16] for x in sorted(set(labels))}
    if len(set(tokens.values())) != len(tokens):
        raise ValueError("tokens collide")
    return tokens


def relabel(df: DataFrame, mapping: dict[str, str], column: str) -> DataFrame:
    """Labels replaced by the map; an unknown one refuses."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    new = F.element_at(table, F.col(column))
    unknown = F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(F.col(column), F.lit("null")))).cast("string")
    return df.withColumn(column, F.coalesce(new, unknown))


# --- cells


def violations(cells: DataFrame) -> DataFrame:
    """The cells with an array of the rules that each breaks."""
    c = F.col
    retrieval = c("arm").startswith("retr-")
    rules = [F.when(~F.coalesce(c(a).isin(*v), F.lit(False)), f"{a}-vocabulary") for a, v in AXES.items()]
    rules += [F.when(retrieval & (c("retriever") == "none"), "arm-needs-retriever"), F.when(~retrieval & (c("retriever") != "none"), "arm-has-no-retrieval")]
    rules += [F.when((c("family") == f) & ~c("arm").isin(*arms), "arm-not-in-family") for f, arms in FAMILY_ARMS.items()]
    rules += [
        F.when((c("policy") != "none") & ~c("family").isin("F2", "F3"), "policy-needs-pressure"),
        F.when((c("engine") == "hf") & (c("family") != "F1"), "hf-is-F1-only"), F.when((c("engine") == "hf") & (c("topology") != "single"), "hf-is-single-only"),
        F.when((c("engine") == "lmdeploy") & ~c("model").isin("qwen3-14b", "llama-3.3-70b"), "lmdeploy-models"),
        F.when((c("topology") == "pd") & (c("family") != "DIST"), "pd-is-DIST"), F.when((c("family") == "DIST") & (c("topology") == "single"), "DIST-not-single"),
    ]
    for k in ("budget_r", "rate_frac"):
        rules += [F.when(c(k).isNotNull() & ~((c(k) > 0) & (c(k) < float("inf"))), f"{k}-range"), F.when(c(k).isNotNull() & (c("family") == "F1"), f"{k}-in-F1")]
    return cells.withColumn("violations", F.array_compact(F.array(*rules)))


def short_number(c: Column) -> Column:
    """A coordinate to six significant digits without trailing zeros, as %g prints ordinary sizes."""
    digits = F.lit(5) - F.floor(F.log10(F.abs(c))).cast("int")
    fixed = F.format_string("%.10f", (F.round(c * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)).cast("double"))
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def row_key() -> Column:
    """The axes joined by |, then r and lam coordinates where there are any."""
    coords = [F.when(F.col(k).isNotNull(), F.concat(F.lit(p), short_number(F.col(k).cast("double")))) for k, p in (("budget_r", "r"), ("rate_frac", "lam"))]
    return F.concat_ws("|", *AXES, *coords)


def parse_row_key(key: Column) -> dict[str, Column]:
    parts = F.split(key, r"\|")
    rest = F.slice(parts, len(AXES) + 1, 2)
    coord = lambda p: F.try_element_at(F.filter(rest, lambda x: x.rlike(rf"^{p}[0-9.]")), F.lit(1))
    own = {a: F.get(parts, F.lit(k)) for k, a in enumerate(AXES)}
    return own | {"budget_r": F.regexp_replace(coord("r"), "^r", "").try_cast("double"), "rate_frac": F.regexp_replace(coord("lam"), "^lam", "").try_cast("double")}


def condensed(keys: DataFrame, axes: list[str]) -> DataFrame:
    """Labels without the axes that all rows share."""
    counts = keys.agg(*[F.count_distinct(F.coalesce(F.col(a).cast("string"), F.lit(""))).alias(a) for a in axes]).first()  # one row
    varied = [a for a in axes if counts[a] > 1] or axes[:1]
    return keys.withColumn("label", F.concat_ws("|", *varied))


def baselines(spark: SparkSession) -> DataFrame:
    rows = [F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("baseline", "arm", "retriever", "reuse"))]) for r in BASELINES]
    return spark.range(1).select(F.inline(F.array(*rows)))


# --- registered families and gates


def family_map(contrasts: DataFrame, metrics: list[str], datasets: list[str]) -> DataFrame:
    """Every contrast x metric x dataset with its family. Three registries, not tables: generated, not crossed."""
    m, d = F.explode(F.array(*map(F.lit, metrics))), F.explode(F.array(*map(F.lit, datasets)))
    return contrasts.withColumn("metric", m).withColumn("dataset", d).withColumn("family_id", F.concat_ws(":", "tier", "contrast_id", "metric"))


def gatekeeping(endpoints: DataFrame, alpha: float = 0.05) -> DataFrame:
    """A serial chain: an endpoint is tested only if all before it passed; a set passes if all its legs do.

    endpoints: chain_order, endpoint, dataset, p (null: the leg is missing, so the set fails).
    """
    legs = endpoints.groupBy("chain_order", "endpoint").agg(F.max("p").alias("p"), F.count("*").alias("n_legs"), F.count_if(F.col("p").isNull()).alias("n_missing"))
    passed = (F.col("n_missing") == 0) & (F.col("p") < alpha)
    # a chain has a handful of endpoints
    before = Window.orderBy("chain_order").rowsBetween(Window.unboundedPreceding, -1)
    own = legs.withColumn("passed", F.coalesce(passed, F.lit(False))).withColumn("open", F.coalesce(F.bool_and("passed").over(before), F.lit(True)))
    status = F.when(~F.col("open"), "NOT_TESTED").when(F.col("n_missing") > 0, "MISSING_LEG").when(F.col("passed"), "REJECTED").otherwise("NOT_REJECTED")
    return own.select("chain_order", "endpoint", "n_legs", "n_missing", F.when(F.col("n_missing") == 0, F.col("p")).alias("p"), status.alias("status"))
