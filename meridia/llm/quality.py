"""Line-first quality rules.

Every line is judged by itself (punctuation, navigation, boilerplate; prose ends
a sentence somewhere in the line, so that an unfinished last sentence is no
fault); failing lines go, and a document that loses too much of its text goes whole. Base
measures of the whole text (length and repeated five-word windows) reject too.
One pass over the rows, no shuffle.

Words are [^\\x20\\x09-\\x0D]+. Nulls and edges: a null text has no words and
fails the length rule; empty lines never fail and hold no text; a text without
a word is rejected; repeated rows are judged alike; an empty table yields an
empty table; extra columns are kept by `clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.llm.common import as_bytes, free_name, lower_ascii, slices

LEAST_WORDS = 10
#: Most per cent of words in repeated windows.
MOST_REPEATED = 20
WINDOW = 5

_BLANKS = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"

# Rules of a line. Bytes patterns; the closing marks are UTF-8.
#: Somewhere a sentence ends: a mark, closing quotes and brackets, then a blank or the line's end.
ENDS = "(?:[.!?:;]|…|。|！|？)(?:[\"')\\]}]|»|”|’|“)*(?:[ \\t\\r\\x0b\\x0c]|$)"
#: A word that ends in repeated marks or in symbols.
NOISY = "(?:[!?][!?]+|[#*$%&|<>]+)$"
#: A word that only separates menu items.
SEPARATOR = "^(?:[|>/~]+|»|·|•|→|::)$"
#: Notices that sites repeat on every page; lower case.
BOILERPLATE = "all rights reserved|cookie policy|privacy policy|terms of use|terms of service|accept cookies|enable javascript|lorem ipsum|click here|read more|sign up for|subscribe to our|share this|back to top|log in|skip to content"

#: A line is boilerplate if one in so many of its words, or more, stand in such phrases.
BOILERPLATE_SHARE = 4

_ENDS, _NOISY, _SEPARATOR = (re.compile(x.encode()) for x in (ENDS, NOISY, SEPARATOR))
_BOILERPLATE = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + BOILERPLATE.encode() + rb")(?![0-9a-z\x80-\xff])")

SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bad_punctuation", "n_navigation", "n_boilerplate", "lost_chars")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("clean_text", T.StringType())]
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a window that occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    bits = max(1, len(known).bit_length())
    key, used = ids[:n].copy(), bits
    for j in range(1, window):
        if used + bits > 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            used = int(n).bit_length()
        key = key << bits | ids[j : j + n]
        used += bits
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, dtype=np.int32)
    starts = np.flatnonzero(twice)
    edges[starts] += 1
    np.subtract.at(edges, starts + window, 1)
    return int((np.cumsum(edges) > 0).sum())


def line_rule(line: bytes, words: list[bytes]) -> str | None:
    """The first rule that a line with words breaks: navigation, boilerplate or punctuation."""
    separators = sum(1 for w in words if len(w) <= 3 and _SEPARATOR.search(w))
    if separators >= 2 and 4 * separators >= len(words):
        return "navigation"
    if BOILERPLATE_SHARE * sum(len(m[0].split()) for m in _BOILERPLATE.finditer(lower_ascii(line))) >= len(words):
        return "boilerplate"
    if not _ENDS.search(line) or 2 * sum(1 for w in words if w[-1] in b"!?#*$%&|<>" and _NOISY.search(w)) > len(words):
        return "punctuation"
    return None


def _chars(text: bytes) -> int:
    """Code points outside blanks."""
    return len(text.translate(None, _BLANKS).decode("utf-8", "replace"))


def judge(text: bytes | None) -> tuple:
    """One row of SCHEMA."""
    text = text or b""
    words = text.split()
    seen, kept, broken, duplicates, lines, lost = set(), [], {"navigation": 0, "boilerplate": 0, "punctuation": 0}, 0, 0, 0
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            lines += 1
            duplicates += line in seen
            seen.add(line)
            if rule := line_rule(line, own):
                broken[rule] += 1
                lost += _chars(line)
                continue
        kept.append(line)
    word_chars, repeated = _chars(text), repeated_words(words)
    base_failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)
    return (
        len(words), word_chars, len(text) - len(text.translate(None, _SYMBOLS)), duplicates, repeated, lines,
        broken["punctuation"], broken["navigation"], broken["boilerplate"], lost, base_failed,
        not base_failed and 2 * lost <= word_chars, b"\n".join(kept).decode("utf-8", "replace"),
    )


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """The given columns and `quality` (`_quality` if there is one), a struct of SCHEMA."""
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    at = f"c{docs.columns.index(text)}"
    plain = docs.select(*own).withColumn(at, F.col(at).cast("string"))
    schema = T.StructType(plain.schema.fields + SCHEMA.fields)
    types = [pa.int64()] * 10 + [pa.bool_(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [judge(t) for t in as_bytes(batch.column(at))]
            found = [pa.array(x, kind) for x, kind in zip(zip(*rows), types)] if rows else [pa.array([], kind) for kind in types]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=schema.fieldNames())

    found = plain.mapInArrow(run, schema)
    return found.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)], F.struct(*SCHEMA.fieldNames()).alias(free_name(docs.columns, "quality")))


def clean(docs: DataFrame, text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """The documents that pass, without their failing lines; `chars`, if a column, counts anew."""
    q = free_name(docs.columns, "quality")
    found = judged(docs, text).filter(f"{q}.kept").withColumn(text, F.col(f"{q}.clean_text"))
    if chars in docs.columns:
        found = found.withColumn(chars, F.length(text).cast(docs.schema[chars].dataType))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    q = "quality."
    return judged(docs.select("doc_id", "text")).select("doc_id", *[F.col(q + c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
