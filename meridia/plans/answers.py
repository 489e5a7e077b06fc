"""Answer scoring, sessions and prompts over conversations, documents and benchmark."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.functions import text as tx
from meridia.session import spread, table


def abstain_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    return said.select("conv_id", "turn", tx.is_abstention("text").alias("abstains"))


def sanitized_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers with a scaffold and a fabricated continuation."""
    said = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    wrapped = F.concat(F.lit("Answer: "), F.coalesce("text", F.lit("")), F.lit("\nQuestion 2: more?"))
    return said.select("conv_id", "turn", F.sha1(tx.sanitize_answer(wrapped)).alias("answer_sha1"), F.length(tx.sanitize_answer(wrapped)).cast("bigint").alias("n_chars"))


def sentence_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.size(tx.sentences("text")).cast("bigint").alias("n_claims"), F.sha1(F.array_join(tx.sentences("text"), "\n")).alias("claims_sha1"))


def normalized_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha1(tx.normalize_passage("text")).alias("passage_sha1"), F.size(tx.bm25_tokens("text")).cast("bigint").alias("n_tokens"), tx.token_estimate("text").alias("estimate"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn with the assistant turn before it."""
    own = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    return own.withColumn("former", F.lag("text").over(order)).filter("former IS NOT NULL").select("conv_id", "turn", "text", "former")


def token_f1_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer held against the assistant's former one."""
    scored = _turns(spark, sf_dir).select("conv_id", "turn", tx.token_f1("text", "former").alias("s"))
    return scored.select("conv_id", "turn", *[F.round(f"s.{c}", 9).alias(c) for c in ("f1", "precision", "recall", "exact_match")])


def jaccard_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _turns(spark, sf_dir)
    return scored.select("conv_id", "turn", F.round(tx.jaccard("text", "former"), 9).alias("relevance"), (tx.jaccard("text", "former") >= 0.3).alias("relevant"))


def first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _turns(spark, sf_dir)
    return own.select("conv_id", "turn", tx.first_divergence(tx.words("text"), tx.words("former")).cast("bigint").alias("position"), (tx.normalize_answer("text") == tx.normalize_answer("former")).alias("same"))


def divergence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = first_divergence(spark, sf_dir)
    return own.agg(F.count("*").alias("n"), F.count("position").alias("n_divergent"), F.round(F.avg("position"), 9).alias("mean_position"), F.median("position").alias("median_position"), F.min("position").alias("min_position"), F.max("position").alias("max_position"), F.round(F.avg(F.col("same").cast("double")), 9).alias("agreement"))


def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return own.select("conv_id", "turn", (F.row_number().over(order) - 1).cast("bigint").alias("turn_index"), F.count("*").over(Window.partitionBy("conv_id")).alias("num_turns"), F.lead("role").over(order).alias("next_role"))


def multi_turn_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of every user turn with all that was said before: user and following assistant turns."""
    own = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    pairs = own.withColumn("answer", F.when(F.lead("role").over(order) == "assistant", F.lead("text").over(order))).filter("role = 'user'")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    asked = pairs.withColumn("history", F.filter(F.collect_list(F.struct(F.col("text").alias("user"), F.col("answer").alias("assistant"))).over(before), lambda h: h["assistant"].isNotNull()))
    prompt = tx.multi_turn_prompt(F.col("text"), F.array().cast("array<string>"), F.col("history"))
    return asked.select("conv_id", "turn", F.size("history").cast("bigint").alias("n_history"), F.sha1(prompt).alias("prompt_sha1"))


def qa_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    contexts = F.split("text", "\n")
    return items.select("item_id", F.sha1(tx.qa_prompt(F.lit("Which?"), contexts, "Use the context.\n\n")).alias("prompt_sha1"))


def stale_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of a text as the answer, its lines as contexts, a quarter served stale."""
    items = table(spark, sf_dir, "benchmark").withColumn("contexts", F.split("text", "\n"))
    answer = F.get(tx.words("text"), F.lit(0))
    stale = tx.stale_selected("item_id", 0.25)
    served = F.when(stale, tx.stale_contexts(F.col("contexts"), answer)).otherwise(F.col("contexts"))
    return items.select("item_id", stale.alias("stale"), F.size(served).cast("bigint").alias("n_contexts"), F.sha1(F.array_join(served, "\n")).alias("served_sha1"))


def code_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntax, imports, lines, branches and unsafe calls of each text's code block. Parsing needs Python's own parser."""
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.code_block("text").alias("code"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([{"doc_id": d, **code_facts(c)} for d, c in zip(frame["doc_id"], frame["code"])], columns=["doc_id", "valid", "n_imports", "loc", "complexity", "n_unsafe"])

    return docs.mapInPandas(run, "doc_id bigint, valid boolean, n_imports bigint, loc bigint, complexity bigint, n_unsafe bigint")


BRANCHES = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With)
UNSAFE = {(m, f) for m in ("os", "subprocess") for f in ("system", "popen", "run", "call")}


def code_facts(code: str | None) -> dict:
    if not code:
        return {"valid": False, "n_imports": 0, "loc": 0, "complexity": 0, "n_unsafe": 0}
    lines = len(code.splitlines())
    try:
        nodes = list(ast.walk(ast.parse(code)))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return {"valid": False, "n_imports": 0, "loc": lines if isinstance(error, SyntaxError) else 0, "complexity": 0, "n_unsafe": 0}
    imports = sum(len(n.names) for n in nodes if isinstance(n, ast.Import)) + sum(1 for n in nodes if isinstance(n, ast.ImportFrom) and n.module)
    called = [(getattr(n.func.value, "id", ""), n.func.attr) for n in nodes if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute)]
    return {"valid": True, "n_imports": imports, "loc": lines, "complexity": 1 + sum(isinstance(n, BRANCHES) for n in nodes), "n_unsafe": sum(c in UNSAFE for c in called)}


QUERIES = {f.__name__: f for f in (abstain_flags, sanitized_answers, sentence_claims, normalized_passages, token_f1_em, jaccard_relevance, first_divergence, divergence_summary, session_turns, multi_turn_history, qa_prompts, stale_rewrites, code_metrics)}

_WORDS = r"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"
_W = lambda x: _WORDS.replace("{x}", x)
_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_S = lambda x: _STRIP.replace("{x}", x)
_NORMAL = lambda x: f"array_to_string({_W(rf"regexp_replace(regexp_replace(lower({x}), '[[:punct:]]', '', 'g'), '(^|[^\w\x80-\x{{10FFFF}}])(a|an|the)($|[^\w\x80-\x{{10FFFF}}])', '\1 \3', 'g')")}, ' ')"
_ABSTAIN = r"\b(" + "|".join(tx.ABSTENTION).replace("'", "''") + ")"
_TURNS = """
turns AS (
  SELECT * FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS former FROM conversations WHERE role = 'assistant') WHERE former IS NOT NULL
)
"""
_DIVERGED = f"""
{_TURNS},
split AS (SELECT conv_id, turn, text, former, {_W("text")} AS a, {_W("former")} AS b FROM turns),
diverged AS (
  SELECT conv_id, turn, (SELECT min(k) - 1 FROM range(1, greatest(len(a), len(b)) + 1) t(k) WHERE a[k] IS DISTINCT FROM b[k]) AS position, a = b OR lower(text) = lower(former) AS same
  FROM split
)
"""

ORACLE = {
    "abstain_flags": f"SELECT conv_id, turn, {_S("coalesce(text, '')")} = '' OR regexp_matches({_S("coalesce(text, '')")}, '(?i){tx.ABSTENTION_EXACT}') OR (len({_W("coalesce(text, '')")}) <= 20 AND regexp_matches(text, '(?i){_ABSTAIN}')) AS abstains FROM conversations",
    "sanitized_answers": f"SELECT conv_id, turn, sha1({_S("coalesce(text, '')")}) AS answer_sha1, length({_S("coalesce(text, '')")}) AS n_chars FROM conversations WHERE role = 'assistant'",
    "sentence_claims": r"""
WITH cut AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), '\x01|\n+|;\s+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS c FROM documents)
SELECT doc_id, CAST(len(c) AS BIGINT) AS n_claims, sha1(array_to_string(c, chr(10))) AS claims_sha1 FROM cut
""",
    "normalized_passages": f"SELECT doc_id, sha1(array_to_string(w, ' ')) AS passage_sha1, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(w) * 4 // 3 AS BIGINT) AS estimate FROM (SELECT doc_id, {_W('lower(text)')} AS w FROM documents)",
    "token_f1_em": rf"""
WITH {_TURNS}, normal AS (
  SELECT conv_id, turn, list_filter({_W(r"regexp_replace(lower(text), '[[:punct:]]', '', 'g')")}, lambda w: w NOT IN ('a', 'an', 'the')) AS a, list_filter({_W(r"regexp_replace(lower(former), '[[:punct:]]', '', 'g')")}, lambda w: w NOT IN ('a', 'an', 'the')) AS b,
    trim(former) = '' AS unanswerable, trim(text) = '' OR regexp_matches(trim(text), '(?i){tx.ABSTENTION_EXACT}') OR (len({_W("text")}) <= 20 AND regexp_matches(text, '(?i){_ABSTAIN}')) AS abstains
  FROM turns
),
both_sides AS (SELECT *, list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))) AS o FROM normal)
SELECT conv_id, turn, {", ".join(f"CASE WHEN unanswerable THEN abstains::INT::DOUBLE WHEN abstains THEN 0::DOUBLE ELSE {v} END AS {n}" for n, v in (("f1", "CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(2 * o / (len(a) + len(b)), 9) END"), ("precision", "CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(o / len(a), 9) END"), ("recall", "CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(o / len(b), 9) END"), ("exact_match", "(a = b)::INT::DOUBLE")))}
FROM both_sides
""",
    "jaccard_relevance": rf"""
WITH {_TURNS}, sets AS (
  SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\w\x80-\x{{10FFFF}}]+')) AS a, list_distinct(regexp_extract_all(lower(former), '[\w\x80-\x{{10FFFF}}]+')) AS b FROM turns
), scored AS (SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0::DOUBLE ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS r FROM sets)
SELECT conv_id, turn, round(r, 9) AS relevance, r >= 0.3::DOUBLE AS relevant FROM scored
""",
    "first_divergence": f"WITH {_DIVERGED} SELECT conv_id, turn, position, same FROM diverged",
    "divergence_summary": f"WITH {_DIVERGED} SELECT count(*) AS n, count(position) AS n_divergent, round(avg(position), 9) AS mean_position, CAST(median(position) AS DOUBLE) AS median_position, min(position) AS min_position, max(position) AS max_position, round(avg(same::INT), 9) AS agreement FROM diverged",
    "session_turns": "SELECT conv_id, turn, row_number() OVER w - 1 AS turn_index, count(*) OVER (PARTITION BY conv_id) AS num_turns, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)",
    "multi_turn_history": """
WITH pairs AS (
  SELECT conv_id, turn, role, text, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
),
asked AS (SELECT * FROM pairs WHERE role = 'user'),
told AS (
  SELECT conv_id, turn, text, CASE WHEN answer IS NOT NULL THEN 'User: ' || text || chr(10) || 'Assistant: ' || answer || chr(10) END AS said FROM asked
),
so_far AS (
  SELECT conv_id, turn, text, count(said) OVER w AS n_history, coalesce(string_agg(said, '') OVER w, '') AS history
  FROM told WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT conv_id, turn, n_history, sha1(history || 'User: ' || text || chr(10) || 'Assistant:') AS prompt_sha1 FROM so_far
""",
    "stale_rewrites": r"""
WITH c AS (
  SELECT item_id, string_split(text, chr(10)) AS c, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1] AS answer, CAST('0x' || sha1('42:' || item_id)[1:8] AS BIGINT) / 4294967295.0::DOUBLE < 0.25::DOUBLE AS stale FROM benchmark
),
marked AS (SELECT *, list_transform(c, lambda x: regexp_replace(x, '(?i)' || regexp_escape(answer), '[redacted]', 'g')) AS redacted FROM c),
served AS (SELECT item_id, stale, CASE WHEN NOT stale OR answer IS NULL THEN c WHEN len(list_filter(redacted, lambda x: contains(x, '[redacted]'))) > 0 THEN redacted WHEN len(c) > 1 THEN c[2:] ELSE c END AS s FROM marked)
SELECT item_id, stale, CAST(len(s) AS BIGINT) AS n_contexts, sha1(array_to_string(s, chr(10))) AS served_sha1 FROM served
""",
    "qa_prompts": """
WITH c AS (SELECT item_id, string_split(text, chr(10)) AS c FROM benchmark),
blocks AS (SELECT item_id, array_to_string(list_filter(list_transform(c, lambda x, k: CASE WHEN x <> '' THEN 'Context ' || k || ': ' || x END), lambda x: x IS NOT NULL), chr(10) || chr(10)) AS b FROM c)
SELECT item_id, sha1('Use the context.' || chr(10) || CASE WHEN b <> '' THEN b || chr(10) || chr(10) ELSE '' END || 'Question: Which?' || chr(10) || 'Answer:') AS prompt_sha1 FROM blocks
""",
}
