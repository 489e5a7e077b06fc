"""Benchmark decontamination by suffix arrays of the training texts.

Each shard of documents gets a word-level suffix array; every suffix of every
test item is searched in it by bisection, for its longest verbatim match. Where
that is as long as the window which begins the suffix, the places of the window
give the words of each document that are hit; `longest_matches` returns the
longest matches themselves, with their places. The documents never move: a shard is a run of
rows of one task, so there is no shuffle and no hot key. Test items are sent in
blocks of about `block_words` words; each block is a pass whose result is written
before the next one begins, so more items mean more passes, not more memory.

Nulls and edges: a null or empty text has no words, no hits and is clean; an
item without words has no window; an item with fewer words than a window is one
window; items with the same id count once; a null id counts as the empty id;
repeated rows each get a row; an empty benchmark leaves every document clean.
Extra columns, whatever their names, are kept by `remove_contaminated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.llm.common import as_bytes, free_name, item_words, slices, written
from meridia.llm.suffix import SuffixArray

WINDOW = 13
#: A document is contaminated if 1 of so many of its words is hit.
SHARE = 20
#: About so many words of test items are in one broadcast block (some 50 MB in a task, vocabulary included).
BLOCK_WORDS = 1 << 20
#: Text bytes of one shard; a longer document is a shard of its own.
SHARD_BYTES = 3 << 20

MATCHES = "doc_id bigint, item_id string, item_word int, n_words int, doc_word int"


class Items:
    """A block of test items: vocabulary, words and distinct windows."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.ids, starts, lengths, words = [], [], [], []
        for item, text in items:
            found = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in item_words(text)]
            if found:
                self.ids.append(item)
                starts.append(len(words))
                lengths.append(len(found))
                words += found
        self.words, self.starts, self.lengths = np.array(words, dtype=np.int64), np.array(starts, dtype=np.int64), np.array(lengths, dtype=np.int64)
        # every place of an item where a window begins
        sizes = np.minimum(self.lengths, window)
        many = self.lengths - sizes + 1
        owner = np.repeat(np.arange(len(self.ids)), many)
        places = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + self.starts[owner]
        # equal windows are one: its first place, its size and who has it
        firsts, widths, heads, owners = [], [], [], []
        known = 0
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes[owner] == size)
            rows = np.lib.stride_tricks.sliding_window_view(self.words.astype(np.int32), size)[places[own]]
            _, first, which = np.unique(rows.view(f"V{4 * size}").ravel(), return_index=True, return_inverse=True)
            firsts.append(places[own][first])
            widths.append(np.full(len(first), size, dtype=np.int64))
            pairs = np.unique((which.astype(np.int64) + known) * len(self.ids) + owner[own])
            heads.append(pairs // len(self.ids))
            owners.append((pairs % len(self.ids)).astype(np.int32))
            known += len(first)
        none = [np.zeros(0, dtype=np.int64)]
        self.window_starts, self.window_lengths = np.concatenate(firsts or none), np.concatenate(widths or none)
        self.owners = np.concatenate(owners or none)
        self.owner_ends = np.searchsorted(np.concatenate(heads or none), np.arange(known), side="right")

    def having(self, windows: np.ndarray) -> set[str]:
        """The ids of the items that have any of the windows."""
        ends, before = self.owner_ends[windows], np.where(windows > 0, self.owner_ends[windows - 1], 0)
        return {self.ids[k] for k in np.unique(self.owners[_ranges(before, ends)[1]]).tolist()}

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every test suffix: its item's number, where it starts, how long it is."""
        item = np.repeat(np.arange(len(self.ids)), self.lengths)
        at = np.arange(len(self.words))
        ends = np.repeat(self.starts + self.lengths, self.lengths)
        return item, at, ends - at


class Shard:
    """The words of some documents in a row, one 0 between two of them."""

    def __init__(self, texts: list[list[bytes]], items: Items, depth: int):
        get, sizes = items.vocab.get, np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(sizes + 1) - (sizes + 1)
        ids = np.zeros(int((sizes + 1).sum()), dtype=np.int64)
        for start, words in zip(self.starts, texts):
            ids[start : start + len(words)] = [get(w, 0) for w in words]
        self.size = len(ids)
        self.suffixes = SuffixArray(ids, len(items.vocab), depth)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and which slot, for every slot of the ranges."""
    sizes = hi - lo
    which = np.repeat(np.arange(len(lo)), sizes)
    return which, np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)


def shard_hits(texts: list[list[bytes]], items: Items) -> tuple[list[np.ndarray], list[set[str]]]:
    """Of each document: which words are hit, and the items with occurring windows."""
    flags, found = [np.zeros(len(t), dtype=bool) for t in texts], [set() for _ in texts]
    if not len(items.window_lengths):
        return flags, found
    _, starts, lengths = items.suffixes()
    shard = Shard(texts, items, int(lengths.max()))
    longest, _, _ = shard.suffixes.longest(items.words, starts, lengths)
    # a window occurs where the longest match of the suffix that it begins reaches its end
    occurs = np.flatnonzero(longest[items.window_starts] >= items.window_lengths)
    lo, hi = shard.suffixes.find(items.words, items.window_starts[occurs], items.window_lengths[occurs])
    which, slots = _ranges(lo, hi)
    if not len(which):
        return flags, found
    which = occurs[which]
    places = shard.suffixes.order[slots]
    edges = np.zeros(shard.size + 1, dtype=np.int64)
    np.add.at(edges, places, 1)
    np.add.at(edges, places + items.window_lengths[which], -1)
    hit = np.cumsum(edges)[:-1] > 0
    for k in np.unique(shard.document(np.flatnonzero(hit))):
        flags[k] = hit[shard.starts[k] : shard.starts[k] + len(texts[k])]
    pairs = np.unique(shard.document(places) * len(items.window_lengths) + which)
    document, window = np.divmod(pairs, len(items.window_lengths))
    for k in np.unique(document).tolist():
        found[k] = items.having(window[document == k])
    return flags, found


def _shards(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Runs of rows whose texts come to about SHARD_BYTES."""
    for batch in slices(batches):
        texts, at, size = as_bytes(batch.column(column)), 0, 0
        for k, text in enumerate(texts):
            size += len(text or b"")
            if size >= SHARD_BYTES or k == len(texts) - 1:
                yield batch.slice(at, k + 1 - at), [item_words(t) for t in texts[at : k + 1]]
                at, size = k + 1, 0


def test_blocks(benchmark: DataFrame, item: str, text: str, window: int, block_words: int) -> Iterator[Broadcast]:
    """The test items as broadcast blocks of about block_words words."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))
    words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    total = items.agg(F.sum(words + 1).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_words))
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        rows = part.collect()
        yield spark.sparkContext.broadcast(Items([(r["item"], None if r["text"] is None else r["text"].encode()) for r in rows], window))


_STATE = T.StructType([T.StructField("_words", T.LongType()), T.StructField("_spans", T.ArrayType(T.IntegerType())), T.StructField("_items", T.ArrayType(T.StringType()))])


def _pass(block: Broadcast, column: str, schema: T.StructType, again: bool) -> Callable:
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _shards(batches, column):
            flags, found = shard_hits(texts, block.value)
            if again:
                for flag, spans, known, before in zip(flags, batch.column("_spans").to_pylist(), found, batch.column("_items").to_pylist()):
                    for start, end in zip(spans[::2], spans[1::2]):
                        flag[start:end] = True
                    known.update(before)
            spans = [np.flatnonzero(np.diff(np.concatenate(([0], f.view(np.int8), [0])))).astype(np.int32) if f.any() else [] for f in flags]
            own = [pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
            kept = [batch.column(n) for n in names[: -len(own)]]
            yield pa.RecordBatch.from_arrays(kept + own, names=names)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every document with n_words, n_hit, hit spans, items and the verdict.

    Adds `contamination` = struct(n_words, n_hit, spans array<int> of starts and
    ends in words, items array<string>, contaminated) to the given columns
    (`_contamination` if there is one).
    """
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    at = f"c{docs.columns.index(text)}"
    state = docs.select(*own).withColumn(at, F.col(at).cast("string"))
    for k, block in enumerate(test_blocks(benchmark, item, item_text, window, block_words)):
        schema = T.StructType(state.schema.fields[: len(own)] + _STATE.fields)
        if k:  # a pass at a time: no task holds two blocks
            state = written(state, "decontaminate")
        state = state.mapInArrow(_pass(block, at, schema, again=k > 0), schema)
    # spans alternate starts and ends
    signed = F.transform("_spans", lambda x, k: F.when(k % 2 == 0, -x).otherwise(x).cast("bigint"))
    n_hit = F.aggregate(signed, F.lit(0).cast("bigint"), lambda total, x: total + x)
    state = state.withColumn("_hit", n_hit)
    verdict = F.struct(
        F.col("_words").alias("n_words"), F.col("_hit").alias("n_hit"), F.col("_spans").alias("spans"), F.col("_items").alias("items"),
        ((F.col("_hit") > 0) & (F.lit(share) * F.col("_hit") >= F.col("_words"))).alias("contaminated"),
    )
    return state.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)], verdict.alias(free_name(docs.columns, "contamination")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    found = contamination(docs, benchmark, **options)
    return found.filter(~F.col(free_name(docs.columns, "contamination") + ".contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Of every test suffix and every shard, the longest verbatim match and all its places.

    A row: doc_id, item_id, item_word (where the suffix starts), n_words (the
    match's length, `least` or more), doc_word (where it stands). Aggregate with
    max(n_words) by item and item_word for the longest over all shards.
    """
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def searching(block: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = block.value
            if not len(items.words):
                return
            number, starts, lengths = items.suffixes()
            for batch, found in _shards(batches, "text"):
                shard = Shard(found, items, int(lengths.max()))
                size, lo, hi = shard.suffixes.longest(items.words, starts, lengths)
                hi = np.where(size >= least, hi, lo)
                which, slots = _ranges(lo, hi)
                places = shard.suffixes.order[slots]
                owner = shard.document(places)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(owner)), pa.array([items.ids[k] for k in number[which]], pa.string()), pa.array((starts[which] - items.starts[number[which]]).astype(np.int32)), pa.array(size[which].astype(np.int32)), pa.array((places - shard.starts[owner]).astype(np.int32))],
                    names=["doc_id", "item_id", "item_word", "n_words", "doc_word"],
                )

        return run

    found = None
    for block in test_blocks(benchmark, item, item_text, least, block_words):
        part = texts.mapInArrow(searching(block), MATCHES)
        found = part if found is None else found.unionByName(part)
    return found


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, from `contamination`."""
    c = "contamination."
    return found.select(
        "doc_id", F.col(c + "n_words").alias("n_words"), F.col(c + "n_hit").alias("n_hit"),
        F.size(c + "items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(c + "items", ","), 256).alias("items_sha256"), F.col(c + "contaminated").alias("contaminated"),
    )


def brute(texts: dict, items: dict, window: int = WINDOW) -> dict:
    """The contract, word by word, for tests: doc id -> (n_words, n_hit, item ids)."""
    out = {}
    for doc, text in texts.items():
        words, hit, owners = item_words(text), set(), set()
        for item, other in items.items():
            whole = item_words(other)
            size = min(window, len(whole))
            for at in range(len(whole) - size + 1) if whole else ():
                for k in range(len(words) - size + 1):
                    if words[k : k + size] == whole[at : at + size]:
                        hit.update(range(k, k + size))
                        owners.add(str(item))
        out[doc] = (len(words), len(hit), sorted(owners))
    return out


def sha256(parts: list[str]) -> str:
    return hashlib.sha256(",".join(parts).encode()).hexdigest()
