"""Text functions as column expressions: they stay in whole-stage codegen.

Blank means Unicode white space, as in `(?U)\\s`. Null texts behave as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The abstention phrases, an exact abstention, and how long a short answer is.
ABSTENTION = (
    r"no\s+answer", r"cannot\s+(be\s+)?answer(ed)?", r"can'?t\s+answer", r"unable\s+to\s+(answer|determine|find)", r"unanswerable", r"not\s+answerable",
    r"no\s+(information|mention|indication|answer|idea)", r"insufficient\s+(information|context|detail)", r"not\s+enough\s+(information|context|details?)",
    r"not\s+(in|found\s+in|provided|mentioned|stated|specified|available|present|given|sure)",
    r"does\s+not\s+(say|mention|provide|contain|specify|state|give|include)", r"doesn'?t\s+(say|mention|provide|contain|specify|state|give|include)",
    r"do(es)?\s+not\s+have\s+(the\s+)?answer", r"(i\s+)?don'?t\s+know", r"(i\s+)?do\s+not\s+know",
    r"cannot\s+(be\s+)?(determined?|found)", r"can'?t\s+(be\s+)?(determined?|found)", r"the\s+(context|passage|text|document|article)\s+does\s+not",
)
ABSTENTION_EXACT = r"^\W*(unknown|n/a|no\s+idea|not\s+sure)[\s.!?]*$"
ABSTENTION_WORDS = 20
SCAFFOLD = r"^\s*(A|Answer)\s*[:.]\s*"
CONTINUATION = r"\n?\s*(Context|Question)\s*\d*\s*:"
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without blanks at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column | str) -> Column:
    """Pieces between blanks; none for an empty text."""
    return F.filter(F.split(text(c), r"(?U)[\s\u001c-\u001f]+"), lambda w: w != "")


def bm25_tokens(c: Column | str) -> Column:
    """Lower-cased words, punctuation kept."""
    return words(F.lower(text(c)))


def normalize_passage(c: Column | str) -> Column:
    """Lower case, single spaces."""
    return F.array_join(bm25_tokens(c), " ")


def normalize_answer(c: Column | str) -> Column:
    """Lower case without ASCII punctuation and articles, single spaces."""
    plain = F.regexp_replace(F.lower(text(c)), PUNCTUATION, "")
    return F.array_join(words(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " ")), " ")


def stable_id(c: Column | str) -> Column:
    return F.sha1(F.col(c) if isinstance(c, str) else c)


def is_abstention(c: Column | str) -> Column:
    """An empty answer, an exact abstention, or a short one with an abstaining phrase."""
    own = strip(text(c))
    phrase = own.rlike(r"(?iU)\b(" + "|".join(ABSTENTION) + ")")
    return (own == "") | own.rlike("(?iU)" + ABSTENTION_EXACT) | ((F.size(words(own)) <= ABSTENTION_WORDS) & phrase)


def sanitize_answer(c: Column | str) -> Column:
    """Without one leading scaffold and without what follows a fabricated continuation."""
    own = F.regexp_replace(text(c), "(?U)" + SCAFFOLD, "")
    return strip(F.split(own, "(?U)" + CONTINUATION, 2)[0])


def sentences(c: Column | str) -> Column:
    """Pieces after .!? and a blank, at line ends and after semicolons."""
    own = strip(text(c))
    return F.filter(F.transform(F.split(own, r"(?U)(?<=[.!?])\s+|\n+|;\s+"), strip), lambda x: x != "")


def word_set(c: Column | str) -> Column:
    """Distinct runs of letters, digits and underscores, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit(r"(?U)\b(\w+)\b"), F.lit(1)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Overlap of word sets; 0 if either is empty."""
    one, two = word_set(a), word_set(b)
    share = F.size(F.array_intersect(one, two)) / F.size(F.array_union(one, two))
    return F.when((F.size(one) == 0) | (F.size(two) == 0), F.lit(0.0)).otherwise(share)


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often `body` refers to it (also within its own lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Tokens in common, each as often as in the side that has fewer."""
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, w: n + F.least(count(a, w), count(b, w)))


def token_f1(answer: Column | str, gold: Column | str) -> Column:
    """struct(f1, precision, recall, exact_match, is_answerable, predicted_no_answer, no_answer_correct).

    An empty gold is unanswerable and credits an abstention; abstaining on an
    answerable item scores 0.
    """
    tokens = lambda c: F.filter(F.split(normalize_answer(c), " "), lambda x: x != "")
    known = F.struct(tokens(answer).alias("one"), tokens(gold).alias("two"), (strip(text(gold)) == "").alias("unanswerable"), is_abstention(answer).alias("abstains"))

    def score(v: Column) -> Column:
        one, two, credit = v["one"], v["two"], v["abstains"].cast("double")
        both = multiset_overlap(one, two).cast("double")
        either_empty = (F.size(one) == 0) | (F.size(two) == 0)
        pick = lambda value: F.when(v["unanswerable"], credit).when(v["abstains"], 0.0).otherwise(value)
        return F.struct(
            # 2pr / (p + r) is twice the overlap over both lengths
            pick(F.when(either_empty, 0.0).otherwise(2 * both / (F.size(one) + F.size(two)))).alias("f1"),
            pick(F.when(either_empty, 0.0).otherwise(both / F.size(one))).alias("precision"), pick(F.when(either_empty, 0.0).otherwise(both / F.size(two))).alias("recall"),
            pick((one == two).cast("double")).alias("exact_match"), (~v["unanswerable"]).cast("double").alias("is_answerable"), credit.alias("predicted_no_answer"), F.when(v["unanswerable"], credit).alias("no_answer_correct"),
        )

    return let(known, score)


def best_token_f1(answer: Column | str, golds: Column) -> Column:
    """Over all golds: the best F1 with its precision and recall, and the best exact match by itself."""
    full = F.filter(golds, lambda g: strip(text(g)) != "")
    scored = F.transform(full, lambda g: token_f1(answer, g))
    ranked = F.transform(scored, lambda s: F.struct(s["f1"].alias("f1"), s["precision"].alias("precision"), s["recall"].alias("recall")))
    # the first of equals
    best = F.aggregate(ranked, ranked[0], lambda top, x: F.when(x["f1"] > top["f1"], x).otherwise(top))
    exact = F.array_max(F.transform(scored, lambda s: s["exact_match"]))
    none = token_f1(answer, F.lit(""))
    empty = F.size(full) == 0
    return F.struct(
        *[F.when(empty, none[k]).otherwise(best[k]).alias(k) for k in ("f1", "precision", "recall")],
        F.when(empty, none["exact_match"]).otherwise(exact).alias("exact_match"), (~empty).cast("double").alias("is_answerable"),
    )


def first_divergence(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays, null if they are equal."""
    differs = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    return F.nullif(F.array_position(differs, True), F.lit(0)) - 1


def context_blocks(contexts: Column) -> Column:
    """Numbered contexts; an empty one is left out but keeps its number."""
    numbered = F.transform(contexts, lambda c, k: F.when(text(c) != "", F.concat(F.lit("Context "), (k + 1).cast("string"), F.lit(": "), c)))
    return F.array_join(F.array_compact(numbered), "\n\n")


def qa_prompt(question: Column, contexts: Column, prefix: str | None = None) -> Column:
    """Contexts first, the question last."""
    blocks = context_blocks(contexts)
    return F.concat(F.lit((prefix.rstrip() + "\n") if prefix else ""), F.when(text(blocks) != "", F.concat(blocks, F.lit("\n\n"))).otherwise(""), F.lit("Question: "), question, F.lit("\nAnswer:"))


def multi_turn_prompt(question: Column, contexts: Column, history: Column, prefix: str | None = None) -> Column:
    """history: array of struct(user, assistant), oldest first."""
    blocks = context_blocks(contexts)
    said = F.array_join(F.transform(history, lambda h: F.concat(F.lit("User: "), text(h["user"]), F.lit("\nAssistant: "), text(h["assistant"]), F.lit("\n"))), "")
    return F.concat(
        F.lit((prefix.rstrip() + "\n") if prefix else ""), F.when(text(blocks) != "", F.concat(blocks, F.lit("\n\n"))).otherwise(""), said, F.lit("User: "), question, F.lit("\nAssistant:")
    )


def token_estimate(c: Column | str) -> Column:
    """Four thirds of the words, rounded down."""
    return F.floor(F.size(words(c)) * 4 / 3).cast("bigint")


def code_block(c: Column | str) -> Column:
    """The first fenced block without its language line, or the whole text."""
    own = text(c)
    parts = F.split(own, "```")
    block = parts[1]
    return F.when(F.size(parts) < 2, own).when(F.instr(block, "\n") > 0, F.substring(block, F.instr(block, "\n") + 1, F.length(block))).otherwise(block)


def stale_selected(example: Column | str, fraction: float, seed: int = 42) -> Column:
    """Whether the example's hash falls below the fraction."""
    own = F.col(example) if isinstance(example, str) else example
    if fraction <= 0 or fraction >= 1:
        return F.lit(fraction >= 1)
    head = F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(str(seed)), own.cast("string"))), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967295.0) < fraction


def stale_contexts(contexts: Column, answer: Column) -> Column:
    """The answer redacted wherever it stands; if nowhere, the first of several contexts dropped."""
    own = strip(text(answer))
    quoted = F.concat(F.lit("(?iu)\\Q"), F.replace(own, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    redacted = F.transform(contexts, lambda c: F.regexp_replace(c, quoted, F.lit("[redacted]")))
    hit = F.exists(redacted, lambda c: F.instr(c, "[redacted]") > 0)
    return F.when(own == "", contexts).when(hit, redacted).when(F.size(contexts) > 1, F.slice(contexts, F.lit(2), F.size(contexts))).otherwise(contexts)
