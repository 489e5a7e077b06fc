"""Byte-level BPE: overlapping chunks, stitched where pre-token boundaries agree.

A long text is cut into chunks that overlap. Each chunk is pre-tokenised on its
own, in parallel; its first boundaries may be wrong, since it may begin inside
a pre-token, and its last ones, since a pre-token may go on. The pattern never
looks back, so from any boundary that two neighbours share within the overlap
both agree for good: there they are stitched. Each pre-token is then merged by
rank. Decoding concatenates the tokens' bytes.

Texts of at most `chunk` characters are one chunk and never move. Chunks of
longer ones are spread over tasks, and meet again by text, streamed in order; if
no boundary is shared (one pre-token longer than the overlap), the stretch is
pre-tokenised again from the last sure boundary.

Nulls and edges: a null text is empty and has no tokens; special-token strings
are ordinary text; repeated rows get a row each; a null doc_id stays null; an
empty table yields an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.common import slices

#: Characters of a chunk, and by how many neighbours overlap.
CHUNK = 32768
OVERLAP = 1024
#: A pre-token is sure if it ends so many characters before the end of an unfinished chunk.
MARGIN = 3
#: Pre-tokens whose ids are remembered.
REMEMBERED = 1 << 19
#: Bytes of a pre-token whose pairs are scanned instead of kept in a heap; above all ranks.
SHORT, NONE = 48, 1 << 40

DIGEST = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
CHUNKS = "row bigint, doc_id bigint, chunk int, last boolean, start bigint, text string"
MADE = CHUNKS + ", ends binary, counts binary, ids binary"


def load_ranks(path: str) -> bytes:
    """The rank file as it is; a megabyte at most for the public vocabularies."""
    with open(path, "rb") as file:
        return file.read()


class Encoder:
    """Ranks, pattern, and the merges of one pre-token."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.find = regex.compile(pattern).finditer
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of least rank, the leftmost of equals, until none is left."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        return self._merge_short(piece) if len(piece) <= SHORT else self._merge_long(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        """Scans all pairs for each merge: quickest for few bytes."""
        n, get = len(piece), self.ranks.get
        cuts, pairs = list(range(n + 1)), [get(piece[k : k + 2], NONE) for k in range(n - 1)]
        while pairs:
            least = min(pairs)
            if least == NONE:
                break
            k = pairs.index(least)
            del cuts[k + 1], pairs[k]
            if k < len(pairs):
                pairs[k] = get(piece[cuts[k] : cuts[k + 2]], NONE)
            if k:
                pairs[k - 1] = get(piece[cuts[k - 1] : cuts[k + 1]], NONE)
        return [self.ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]

    def _merge_long(self, piece: bytes) -> list[int]:
        """A heap of pairs: for pre-tokens of any length."""
        n, get = len(piece), self.ranks.get
        after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def push(at: int) -> None:
            if at >= 0 and ends[at] < n:
                end = ends[ends[at]]
                if (rank := get(piece[at:end])) is not None:
                    heapq.heappush(heap, (rank, at, end))

        for at in range(n - 1):
            push(at)
        while heap:
            _, at, end = heapq.heappop(heap)
            middle = ends[at]
            if middle < 0 or middle >= n or ends[middle] != end:
                continue
            ends[at], ends[middle] = end, -1
            after[at] = end
            if end < n:
                before[end] = at
            push(at)
            push(before[at])
        out, at = [], 0
        while at < n:
            out.append(self.ranks[piece[at : ends[at]]])
            at = ends[at]
        return out

    def ids(self, piece: str) -> bytes:
        """A pre-token's ids as little-endian unsigned 32-bit integers."""
        found = self.known.get(piece)
        if found is None:
            found = np.array(self.merge(piece.encode()), dtype="<u4").tobytes()
            if len(piece) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        known, ids = self.known.get, self.ids
        return b"".join([known(piece) or ids(piece) for piece in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join([self.tokens[k] for k in np.frombuffer(ids, "<u4").tolist()])


@cache
def _encoder(ranks: bytes, pattern: str) -> Encoder:
    return Encoder(ranks, pattern)


def encoder(block: Broadcast) -> Encoder:
    """One encoder for each worker process."""
    return _encoder(*block.value)


class Stitcher:
    """Joins the chunks of one text in order; yields sure ids."""

    def __init__(self, encode: Encoder):
        self.encode, self.at, self.pending, self.pending_start = encode, 0, "", 0

    def add(self, start: int, text: str, ends: np.ndarray, counts: np.ndarray, ids: bytes, last: bool) -> bytes:
        """`ends`: where the chunk's pre-tokens end, from the text's start; at `self.at` all before is sure."""
        begins = np.concatenate(([start], ends[:-1]))
        own = int(np.searchsorted(begins, self.at))
        sure = len(ends) if last else int(np.searchsorted(ends, start + len(text) - MARGIN, side="right"))
        if own < len(begins) and begins[own] == self.at and own <= sure:
            offsets = 4 * np.concatenate(([0], np.cumsum(counts)))
            out = ids[offsets[own] : offsets[sure]]
            self.at = int(ends[sure - 1]) if sure > own else self.at
        else:  # no shared boundary: go over the stretch again from the last sure one
            whole = self.pending[self.at - self.pending_start :] + text[max(0, self.pending_start + len(self.pending) - start) :]
            out, base = [], self.at
            for m in self.encode.find(whole):
                if last or m.end() <= len(whole) - MARGIN:
                    out.append(self.encode.ids(m[0]))
                    self.at = base + m.end()
            out = b"".join(out)
        if self.at >= start:
            self.pending, self.pending_start = text, start
        else:
            self.pending += text[max(0, self.pending_start + len(self.pending) - start) :]
        return out


class Digest:
    """Counts and hashes of a text's ids and decoded bytes."""

    def __init__(self, encode: Encoder):
        self.encode, self.n, self.ids, self.decoded = encode, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: bytes) -> None:
        self.n += len(ids) // 4
        self.ids.update(ids)
        self.decoded.update(self.encode.decode(ids))

    def row(self) -> tuple:
        return self.n, self.ids.hexdigest(), self.decoded.hexdigest()


def chunks_of(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, str, bool]]:
    """(start, text with the overlap, whether it is the last)."""
    for start in range(0, max(1, len(text)), chunk):
        last = start + chunk + overlap >= len(text)
        yield start, text[start : start + chunk + overlap], last
        if last:
            return


def pretokenised(encode: Encoder, start: int, text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Where a chunk's pre-tokens end, how many ids each has, and the ids."""
    pieces = encode.split(text)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    if int(lengths.sum()) == len(text):
        ends = start + np.cumsum(lengths)
    else:  # the pattern skips some characters
        ends = np.array([start + m.end() for m in encode.find(text)], dtype=np.int64)
    out = [encode.known.get(piece) or encode.ids(piece) for piece in pieces]
    return ends, np.fromiter(map(len, out), dtype=np.int64, count=len(out)) // 4, b"".join(out)


def _block(spark: SparkSession, ranks_path: str, pattern: str) -> Broadcast:
    return spark.sparkContext.broadcast((load_ranks(ranks_path), pattern))


def _long_chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """The chunks of texts of more than one, spread over tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 64):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                made = [(row, doc, k, last, start, part) for k, (start, part, last) in enumerate(chunks_of(text, chunk, overlap))]
                row += 1
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string())
                for at in range(0, len(made), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*made[at : at + 64]), kinds)], names=["row", "doc_id", "chunk", "last", "start", "text"])

    return docs.mapInArrow(cut, CHUNKS).repartition("row", "chunk")


def _stitched(docs: DataFrame, block: Broadcast, chunk: int, overlap: int, each, schema: str) -> DataFrame:
    """`each(Encoder)` gets the ids of a long text piece by piece and makes its row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(block)
        for batch in slices(batches, 64):
            made = [pretokenised(own, s, t) for s, t in zip(batch.column("start").to_pylist(), batch.column("text").to_pylist())]
            extra = [pa.array([f(m) for m in made], pa.binary()) for f in (lambda m: m[0].tobytes(), lambda m: m[1].tobytes(), lambda m: m[2])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "ends", "counts", "ids"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, join, doc, done = encoder(block), None, None, None, []
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in slices(batches, 64):
            for r in batch.to_pylist():
                if not r["chunk"]:
                    now, join, doc = each(own), Stitcher(own), r["doc_id"]
                now.add(join.add(r["start"], r["text"], np.frombuffer(r["ends"], np.int64), np.frombuffer(r["counts"], np.int64), r["ids"], r["last"]))
                if r["last"]:
                    done.append((doc, *now.row()))
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(["doc_id", *names], x)) for x in done], schema=_arrow(schema))
                done = []

    made = _long_chunks(docs, chunk, overlap).mapInArrow(encode, MADE)
    return made.repartition("row").sortWithinPartitions("row", "chunk").mapInArrow(stitch, f"doc_id bigint, {schema}")


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([("doc_id", pa.int64()), *[(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")]])


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int, each, schema: str) -> DataFrame:
    block = _block(docs.sparkSession, ranks_path, pattern)
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = encoder(block), [x.split()[0] for x in schema.split(", ")]
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                now = each(own)
                now.add(own.encode(text))
                rows.append(now.row())
            made = _arrow(schema)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[k] for r in rows], made.field(n).type) for k, n in enumerate(names)]], schema=made)

    fits = F.char_length("text") <= chunk + overlap
    one = plain.filter(fits).mapInArrow(short, f"doc_id bigint, {schema}")
    return one.unionByName(_stitched(plain.filter(~fits), block, chunk, overlap, each, schema))


def digest(docs: DataFrame, ranks_path: str, pattern: str, *, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The contract's row per document, from ids that were decoded again."""
    return _encoded(docs, ranks_path, pattern, chunk, overlap, Digest, DIGEST)


class Tokens(Digest):
    """All ids of a text, besides."""

    def __init__(self, encode: Encoder):
        super().__init__(encode)
        self.parts = []

    def add(self, ids: bytes) -> None:
        super().add(ids)
        self.parts.append(ids)

    def row(self) -> tuple:
        n, ids, decoded = super().row()
        return n, b"".join(self.parts), ids, decoded


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), ids_sha256, decoded_sha256."""
    return _encoded(docs, ranks_path, pattern, chunk, overlap, Tokens, "n_tokens bigint, ids binary, ids_sha256 string, decoded_sha256 string")


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the text of `ids`; bytes that aren't UTF-8 are replaced."""
    block = _block(tokens.sparkSession, ranks_path, "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(block)
        for batch in slices(batches):
            texts = [own.decode(x or b"").decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
