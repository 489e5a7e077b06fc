"""License scans: base phrases, and short notices found with a few errors.

A notice of which at most k characters differ, split into k + 1 pieces, keeps at
least one piece unchanged (pigeonhole). An automaton finds the pieces in the
whole text; only around them does the regex library look for the notice with at
most k errors. One pass over the rows, no shuffle.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; notices are
matched on the words with single spaces between them. Nulls and edges: a null
or empty text has no words, no places, empty labels and score 0; a place in a
very long text counts like any other; repeated rows get a row each; an empty
table yields an empty table; other columns are not read.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import _ITEM_WORDS, as_bytes, slices

# The contract's phrases and labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Short notices of well-known licenses, in words, with the label of each.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license version", "gpl"),
    ("under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under a creative commons attribution", "cc"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved", "all-rights-reserved"),
)
# What tells a notice's license from others: words that the notice is not found without. Of
# three letters or more, one may be wrong; shorter ones stand as they are.
NAMES = ("mit", "apache", "gnu", "lesser", "mozilla", "cc", "nc", "sa", "creative", "commons", "public", "domain", "all")
#: One error is allowed for so many characters of a notice, and 4 at most.
CHARS_PER_ERROR = 9
MOST_ERRORS = 4
#: Characters of the runs that a window must mostly have before it is matched.
GRAM = 3

COLUMNS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first_word:int,last_word:int,errors:int>>"


def errors_of(notice: str) -> int:
    return max(1, min(MOST_ERRORS, len(notice) // CHARS_PER_ERROR))


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces that cover the notice, each with its offset."""
    cuts = [round(k * len(notice) / (errors + 1)) for k in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@cache
def _scanner(notices: tuple) -> tuple:
    """The automaton of all pieces, and each notice's pattern."""
    found, patterns = ahocorasick.Automaton(), []
    owners: dict[str, list[tuple[int, int]]] = {}
    for k, (notice, label) in enumerate(notices):
        errors = errors_of(notice)
        names, offset = [], 0
        for word in notice.split(" "):
            if word in NAMES:
                names.append((regex.compile(rf"(?:{word}){{e<={int(len(word) > 2)}}}"), offset, offset + len(word)))
            offset += len(word) + 1
        patterns.append((regex.compile(rf"(?b)(?:{regex.escape(notice)}){{e<={errors}}}"), errors, len(notice), label, names, sorted({notice[j : j + GRAM] for j in range(len(notice) - GRAM + 1)})))
        for offset, piece in pieces(notice, errors):
            owners.setdefault(piece, []).append((k, offset))
    for piece, places in owners.items():
        found.add_word(piece, (len(piece), places))
    found.make_automaton()
    return found, patterns


def normal(text: bytes | None) -> str:
    """The words with one space between them."""
    words = (text or b"").translate(_ITEM_WORDS)
    while b"  " in words:
        words = words.replace(b"  ", b" ")
    return words.strip(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=1 << 14)
def _matches(notices: tuple, k: int, window: str) -> list[tuple[int, int, int]]:
    """(start, end, errors) of the k-th notice within a window of its length and its errors on both sides."""
    pattern, errors, length, _, names, grams = _scanner(notices)[1][k]
    start = window.find(notices[k][0])
    if start >= 0:  # nothing in the window is nearer
        return [(start, start + length, 0)]
    # an error breaks at most GRAM of the notice's runs of GRAM characters
    if sum(x in window for x in grams) < len(grams) - GRAM * errors:
        return []
    return [
        (match.start(), match.end(), sum(match.fuzzy_counts))
        for match in pattern.finditer(window)
        # a name lies where the notice has it, but for the errors before it
        if all(name.search(window, max(match.start(), match.start() + a - errors), min(match.end(), match.start() + b + errors)) for name, a, b in names)
    ]


def fuzzy(words: str, notices: tuple = NOTICES) -> list[tuple[str, int, int, int, float]]:
    """(label, start, end, errors, similarity) of every notice found, in characters."""
    automaton, patterns = _scanner(notices)
    # every seed's own window: neighbouring notices have windows of their own
    windows: set[tuple[int, int, int]] = set()
    for end, (size, places) in automaton.iter(words):
        for k, offset in places:
            _, errors, length, *_ = patterns[k]
            start = end - size + 1 - offset
            windows.add((k, max(0, start - errors), min(len(words), start + length + errors)))
    found = set()
    for k, lo, hi in windows:
        label, length = patterns[k][3], patterns[k][2]
        for start, end, wrong in _matches(notices, k, words[lo:hi]):
            found.add((label, lo + start, lo + end, wrong, 1 - wrong / length))
    # notices resemble each other: of those that overlap the nearest counts, the longest of equals
    kept: list[tuple[str, int, int, int, float]] = []
    taken: list[tuple[int, int]] = []
    for one in sorted(found, key=lambda x: (-x[4], x[1] - x[2], x[1], x[0])):
        at = bisect.bisect_left(taken, (one[2], -1))
        if at == 0 or taken[at - 1][1] <= one[1]:
            kept.append(one)
            bisect.insort(taken, (one[1], one[2]))
    return sorted(kept)


def base_places(words: str) -> list[tuple[int, str]]:
    """(start in words, label) of every place where a base phrase stands."""
    padded, found = f" {words} ", []
    for phrase, label in BASE:
        key, at, counted, word = f" {phrase} ", -1, 0, 0
        while (at := padded.find(key, at + 1)) >= 0:
            word += padded.count(" ", counted, at)
            counted = at
            found.append((word, label))
    return found


def scan(text: bytes | None) -> dict:
    """One row of COLUMNS."""
    words = normal(text)
    base, near = base_places(words), fuzzy(words)
    labels = {x[1] for x in base}
    blanks = [m.start() for m in re.finditer(" ", words)] if near else []
    # a place that begins with a blank begins with the word after it
    spans = [{"label": a, "first_word": bisect.bisect_right(blanks, s), "last_word": bisect.bisect_left(blanks, max(s, e - 1)), "errors": w} for a, s, e, w, _ in near]
    return {
        "n_words": words.count(" ") + 1 if words else 0, "n_base": len(base),
        "first_word": min((x[0] for x in base), default=None), "last_word": max((x[0] for x in base), default=None),
        "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {x[0] for x in near})),
        "score": 1.0 if base else max((x[4] for x in near), default=0.0), "spans": spans,
    }


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and COLUMNS for every document."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("errors", pa.int32())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [scan(t) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[n] for r in rows], kind) for n, kind in zip(names, kinds)]], names=["doc_id", *names])

    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the spans."""
    return scanned(docs)
