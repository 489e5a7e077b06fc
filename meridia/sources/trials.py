"""Sources: trial trees, JSON lines, manifests, QA sets, telemetry text.

Reading stays in tasks; only folder listings and one-document files touch the
driver. Where a contract is broken, strict readers fail and lenient ones return
findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The trees of a results folder.
TREES = ("baselines", "compression", "speculative", "envelope", "kv_store", "reference")
_CELL = r"/(?:({})/)?([^/]+)/trial_([^/]*)/[^/]+$".format("|".join(TREES))


def csv_as_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every column a string; empty stays empty; quotes may hold newlines and doubled quotes."""
    read = spark.read.options(header=True, multiLine=True, escape='"', nullValue="\u0000", emptyValue="", inferSchema=False).csv(path)
    return read.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in read.columns])


def list_files(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Files of a glob below a folder, through Hadoop's file system, so that any store works."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(x.getPath()) for x in found or [] if x.isFile())


def trial_files(spark: SparkSession, root: str) -> list[str]:
    """One results file of each trial: results.csv, else the first *_results.csv."""
    found = list_files(spark, root, "{" + ",".join(TREES) + "}/*/trial_*/*results.csv") or list_files(spark, root, "*/trial_*/*results.csv")
    chosen: dict[str, str] = {}
    for path in found:
        folder, _, name = path.rpartition("/")
        if name == "results.csv" or (name.endswith("_results.csv") and folder not in chosen):
            chosen[folder] = path
    return sorted(chosen.values())


def results_long(spark: SparkSession, root: str) -> DataFrame:
    """All trials as one table of strings with tree, cell, trial and source_csv.

    Headers may differ: files with the same header are read together, and the
    tables are joined by name.
    """
    from meridia.operators.results import is_empty_generation, is_error, union_by_name

    files = trial_files(spark, root)
    if not files:
        raise FileNotFoundError(f"no trials below {root}")
    first = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"))
    heads = first.groupBy("path").agg(F.min_by("value", "k").alias("head")).collect()  # one row a file
    groups: dict[str, list[str]] = {}
    for row in heads:
        groups.setdefault(row["head"], []).append(row["path"])
    frames = []
    for paths in groups.values():
        read = spark.read.options(header=True, multiLine=True, escape='"', nullValue="\u0000", emptyValue="").csv(sorted(paths))
        where = F.col("_metadata.file_path")
        part = lambda k: F.regexp_extract(where, _CELL, k)
        number = F.regexp_extract(part(3), r"(\d+)", 1)
        frames.append(read.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in read.columns], part(1).alias("tree"), part(2).alias("cell"), F.when(number == "", 0).otherwise(number.try_cast("int")).alias("trial"), where.alias("source_csv")))
    long = union_by_name(frames)
    error = is_error(F.col("error")) if "error" in long.columns else F.lit(False)
    empty = is_empty_generation(F.col("empty_generation")) if "empty_generation" in long.columns else F.lit(False)
    return long.withColumns({"is_error_row": error, "is_empty_gen": empty})


def trial_scalars(spark: SparkSession, root: str, keys: tuple[str, ...] = ("queries_per_second", "tokens_per_second")) -> DataFrame:
    """Numbers of each trial's metrics.json; what can't be read or isn't a number is null."""
    schema = T.StructType([T.StructField(k, T.StringType()) for k in ("dataset", "model", *keys)])
    read = spark.read.schema(schema).option("multiLine", True).json([p for p in list_files(spark, root, "{*/*,*}/trial_*/metrics.json")])
    where = F.col("_metadata.file_path")
    return read.select(F.regexp_extract(where, _CELL, 2).alias("cell"), F.regexp_extract(where, _CELL, 3).try_cast("int").alias("trial"), "dataset", "model", *[F.col(k).try_cast("double").alias(k) for k in keys])


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Strict: a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_lenient(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and a finding (path, line) for every line that isn't an object of the schema."""
    from pyspark.sql.types import _parse_datatype_string

    own = T.StructType([*_parse_datatype_string(schema).fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").filter(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", own, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull()
    return parsed.filter(~bad).select("path", "row.*").drop("_corrupt"), parsed.filter(bad).select("path", F.col("value").alias("line"), F.lit("FAIL").alias("finding"))


def telemetry(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """ts_s, kv_cache_usage, preemptions_total; of two spellings the first present one wins, even if null; no time stamp fails."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    get = lambda k: F.get_json_object("value", f"$.{k}").try_cast("double")
    either = lambda a, b: F.when(F.array_contains(keys, a), get(a)).otherwise(get(b))
    ts = either("ts_s", "ts")
    checked = F.when(ts.isNull(), F.raise_error(F.lit("a sample has no time stamp")).cast("double")).otherwise(ts)
    return lines.select(checked.alias("ts_s"), either("kv_cache_usage", "kv_usage").alias("kv_cache_usage"), get("preemptions_total").cast("bigint").alias("preemptions_total"))


def prometheus(spark: SparkSession, path: str | list[str], names: list[str]) -> DataFrame:
    """Samples of a metrics text, summed over label sets by exact name."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#"))
    own = lines.select(F.regexp_extract("value", r"^([A-Za-z_:][\w:]*)", 1).alias("name"), F.regexp_extract("value", r"\s(\S+)(?:\s+\d+)?\s*$", 1).try_cast("double").alias("sample"))
    return own.filter(F.col("name").isin(*names)).groupBy("name").agg(F.sum("sample").alias("value"))


# --- question-answering sets: nested columns to (id, question, context, answer, metadata)


def squad(raw: DataFrame) -> DataFrame:
    """Distinct gold answers; none means unanswerable."""
    golds = F.array_distinct(F.filter(F.col("answers.text"), lambda x: F.trim(x) != ""))
    return raw.select("id", "question", F.array("context").alias("context"), F.coalesce(F.get(golds, F.lit(0)), F.lit("")).alias("answer"), golds.alias("all_answers"))


def hotpot(raw: DataFrame) -> DataFrame:
    """Paragraphs as `title: sentences`, with the supporting titles."""
    paragraphs = F.zip_with(F.col("context.title"), F.col("context.sentences"), lambda t, s: F.concat(t, F.lit(": "), F.array_join(s, "")))
    return raw.select("id", "question", paragraphs.alias("context"), "answer", F.array_distinct(F.col("supporting_facts.title")).alias("supporting_titles"))


def musique(raw: DataFrame) -> DataFrame:
    """Paragraph structs; hops are the supporting ones."""
    support = F.filter("paragraphs", lambda p: p["is_supporting"])
    context = F.transform("paragraphs", lambda p: F.concat(p["title"], F.lit(": "), p["paragraph_text"]))
    return raw.select("id", "question", context.alias("context"), "answer", F.array_distinct(F.transform(support, lambda p: p["title"])).alias("supporting_titles"), F.size(support).alias("hops"))


def gold_only(context: Column, titles: Column) -> Column:
    """The contexts of supporting titles; all of them if none is named."""
    named = F.filter(context, lambda c: F.exists(titles, lambda t: F.startswith(c, F.concat(t, F.lit(": ")))))
    return F.when(F.size(titles) > 0, named).otherwise(context)


def qasper(raw: DataFrame) -> DataFrame:
    """One row for each question whose annotators resolve: unanswerable, then yes or no, then free form, then spans.

    raw: id, paragraphs array<string>, qas array<struct<question_id, question, answers array<struct<unanswerable, yes_no, free_form_answer, extractive_spans, evidence>>>>.
    """
    asked = raw.select("id", "paragraphs", F.explode("qas").alias("q"))

    def resolved(a: Column) -> Column:
        return (
            F.when(a["unanswerable"], "").when(a["yes_no"].isNotNull(), F.when(a["yes_no"], "yes").otherwise("no"))
            .when(F.trim(F.coalesce(a["free_form_answer"], F.lit(""))) != "", F.trim(a["free_form_answer"]))
            .when(F.size(F.coalesce(a["extractive_spans"], F.array().cast("array<string>"))) > 0, F.array_join(a["extractive_spans"], "; "))
        )

    golds = F.filter(F.transform(F.col("q.answers"), resolved), lambda x: x.isNotNull())
    evidence = F.flatten(F.transform(F.col("q.answers"), lambda a: F.coalesce(a["evidence"], F.array().cast("array<string>"))))
    index = F.array_distinct(F.filter(F.transform(evidence, lambda e: F.array_position(F.transform("paragraphs", lambda p: F.contains(p, e)), True)), lambda k: k > 0))
    own = asked.withColumn("golds", golds).filter(F.size("golds") > 0)
    return own.select(F.col("q.question_id").alias("id"), F.col("q.question").alias("question"), F.col("paragraphs").alias("context"), F.get("golds", F.lit(0)).alias("answer"), F.filter("golds", lambda g: g != "").alias("all_answers"), F.transform(index, lambda k: k - 1).alias("evidence_docs"))


def share_gpt(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The first user turn and the first assistant turn after it; conversations without both are left out."""
    users = turns.filter(F.col(role).isin("user", "human")).groupBy(conv).agg(F.min(turn).alias("_at"), F.min_by(text, turn).alias("question"))
    after = turns.filter(F.col(role).isin("assistant", "gpt")).join(users, conv).filter(F.col(turn) > F.col("_at"))
    return after.groupBy(conv).agg(F.max("question").alias("question"), F.min_by(text, turn).alias("answer"))


def sessions(raw: DataFrame) -> DataFrame:
    """One row a turn of sessions with a shared context: id, context, multi_turns array<struct<input, answer>>."""
    return raw.select(F.col("id").alias("session_id"), "context", F.size("multi_turns").alias("num_turns"), F.posexplode("multi_turns").alias("turn_index", "turn")).select("session_id", "turn_index", "num_turns", "context", F.col("turn.input").alias("question"), F.col("turn.answer").alias("answer"))


def seeded_sample(df: DataFrame, n: int, *, key: str, seed: int = 42) -> DataFrame:
    """n rows in an order that the seed and the key decide."""
    return df.orderBy(F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def needles(spark: SparkSession, items: int, *, sentences: int, needles: int, seed: int = 42) -> DataFrame:
    """Synthetic haystacks: noise sentences with needles at hashed depths, and the questions' answers."""
    h = lambda *x: F.pmod(F.xxhash64(*x, F.lit(seed)), F.lit(1_000_000))
    noise = F.transform(F.sequence(F.lit(1), F.lit(sentences)), lambda k: F.concat(F.lit("The grass near post "), h(F.col("id"), k).cast("string"), F.lit(" is green.")))
    pins = F.transform(F.sequence(F.lit(1), F.lit(needles)), lambda k: F.struct((h(F.col("id"), k, F.lit("at")) % sentences).cast("int").alias("depth"), k.alias("k"), h(F.col("id"), k, F.lit("value")).cast("string").alias("value")))
    own = spark.range(items).select("id", noise.alias("noise"), F.sort_array(pins).alias("pins"))
    said = lambda p: F.concat(F.lit("The secret number "), p["k"].cast("string"), F.lit(" is "), p["value"], F.lit("."))
    woven = F.flatten(F.transform("noise", lambda s, i: F.concat(F.transform(F.filter("pins", lambda p: p["depth"] == i), said), F.array(s))))
    return own.select(F.col("id"), F.array_join(woven, " ").alias("context"), F.lit("What are the secret numbers?").alias("question"), F.array_join(F.transform("pins", lambda p: p["value"]), ", ").alias("answer"), F.transform("pins", lambda p: p["depth"]).alias("depths"))


def open_questions(raw: DataFrame) -> DataFrame:
    """Questions without contexts: id, question, answers array."""
    return raw.select("id", "question", F.array().cast("array<string>").alias("context"), F.coalesce(F.get("answers", F.lit(0)), F.lit("")).alias("answer"), F.array_distinct("answers").alias("all_answers"))


def entity_pages(raw: DataFrame) -> DataFrame:
    """Questions with their entity pages as `title: text`, empty pages left out: pages array<struct<title, text>>, answer, aliases."""
    pages = F.filter("pages", lambda p: F.trim(F.coalesce(p["text"], F.lit(""))) != "")
    return raw.select("id", "question", F.transform(pages, lambda p: F.concat_ws(": ", p["title"], p["text"])).alias("context"), "answer", F.array_distinct(F.concat(F.array("answer"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("all_answers"))


def either_spelling(raw: DataFrame, spellings: dict[str, list[str]]) -> DataFrame:
    """Columns under one name, from the first spelling that a row has."""
    return raw.select(*[F.coalesce(*[F.col(c) for c in names if c in raw.columns], F.lit(None)).alias(name) for name, names in spellings.items()])


def human_eval(raw: DataFrame) -> DataFrame:
    """Functions to complete: the prompt is question and context, the tests call the entry point."""
    prompt = F.coalesce("prompt", F.lit(""))
    return raw.select(
        F.col("task_id").cast("string").alias("id"), F.concat(F.lit("Complete the following Python function:\n\n"), prompt).alias("question"), F.array(prompt).alias("context"),
        F.coalesce("canonical_solution", F.lit("")).alias("answer"), F.coalesce("entry_point", F.lit("")).alias("entry_point"), F.coalesce("test", F.lit("")).alias("test_code"), F.lit("code_generation").alias("dataset_type"),
    )


def mbpp(raw: DataFrame) -> DataFrame:
    """Tasks in words: the tests, if there are any, are the context."""
    tests = F.coalesce("test_list", F.array().cast("array<string>"))
    shown = F.when(F.size(tests) > 0, F.array(F.concat(F.lit("Test cases:\n"), F.array_join(tests, "\n")))).otherwise(F.array().cast("array<string>"))
    return raw.select(
        F.col("task_id").cast("string").alias("id"), F.concat(F.lit("Write a Python function to solve:\n"), F.coalesce("text", F.lit(""))).alias("question"), shown.alias("context"),
        F.coalesce("code", F.lit("")).alias("answer"), tests.alias("test_list"), F.lit("code_generation").alias("dataset_type"),
    )


def by_category(raw: DataFrame, category: str) -> DataFrame:
    return raw.filter(F.col("category") == category)


def required_columns(df: DataFrame, columns: list[str], *, what: str = "table") -> DataFrame:
    """The table, refused if a column is missing or it has no rows."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {missing}")
    if not df.limit(1).count():
        raise ValueError(f"{what} is empty")
    return df


def anchor(df: DataFrame, *, score: str = "score", label: str = "label", length: str = "context_length", item: str = "item_id") -> DataFrame:
    """item_id, score, label, context_length; ids must be unique, numbers finite, labels 0 or 1. One pass checks, one row returns."""
    required_columns(df, [score, label, length, item], what="anchor")
    own = df.select(F.col(item).cast("string").alias("item_id"), F.col(score).try_cast("double").alias("score"), F.col(label).try_cast("int").alias("label"), F.col(length).try_cast("double").alias("context_length"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    by_item = own.groupBy("item_id").agg(F.count("*").alias("n"), F.count_if(~(finite("score") & finite("context_length") & F.coalesce(F.col("label").isin(0, 1), F.lit(False)))).alias("bad"))
    found = by_item.agg(F.count_if(F.col("n") > 1).alias("twice"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    if found["twice"] or found["bad"]:
        raise ValueError(f"anchor: {found['twice']} ids twice, {found['bad']} bad rows")
    return own


# What a manifest must say.
PROVENANCE = ("run_id", "campaign", "model", "engine", "seed", "datasets")


def manifest(spark: SparkSession, path: str) -> dict:
    """A run's manifest: provenance complete, run_id of word characters, a list of datasets."""
    import json
    import re

    from meridia.sources.sinks import read_text

    raw = read_text(spark, path)
    if raw is None:
        raise FileNotFoundError(path)
    own = json.loads(raw)
    missing = [k for k in PROVENANCE if own.get(k) in (None, "", [])]
    if missing or not re.fullmatch(r"[\w.-]+", str(own["run_id"])) or not isinstance(own["datasets"], list):
        raise ValueError(f"manifest: missing {missing}, run_id {own.get('run_id')!r}")
    return own


def tree_findings(spark: SparkSession, root: str, expected: DataFrame) -> DataFrame:
    """Cells, datasets and windows that a run should have but lacks, or has beyond that. expected: row_key, dataset, window."""
    from meridia.operators.integrity import coverage
    from meridia.sources.sinks import cells_index

    keys = ["row_key", "dataset", "window"]
    return coverage(expected.select(*keys), cells_index(spark, root).select(*keys), keys)
