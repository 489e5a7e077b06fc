"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A row's key falls on an arc of the ring; the virtual node at the arc's end owns
it. A shard holds no more than its bound; what overflows goes on clockwise to
the next nodes whose shards have room. The bounds sum to the number of rows
(each is the mean rounded up or down), so counts are at most one apart: law
`rows`. Only overflowing rows leave their ring shard.

Rows are counted by arc; the ring is walked over these counts (shards times
virtual nodes, whatever the data's size), which splits each arc into a few
pieces, and a row's piece follows from its rank within the arc. Ranks come from
prefix sums over (task, arc), so no arc, key or copy meets in one task.

Nulls and edges: a null text is none of bytes (size 16, crc32 0); null keys are
one key; repeated rows are rows of their own; an empty table yields no rows;
with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm.common import as_bytes, slices, written

SHARDS = 40
VIRTUAL = 64
OVERHEAD = 16
MEASURED = "doc_id bigint, size bigint, text_crc32 bigint, task int, arc int, place bigint"


def ring(shards: int, virtual: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of the virtual nodes, and the shard of each. A place depends on its shard only."""
    nodes = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big"), s) for s in range(shards) for v in range(virtual))
    return np.array([p for p, _ in nodes], dtype=np.uint64), np.array([s for _, s in nodes], dtype=np.int32)


def key_places(keys: np.ndarray) -> np.ndarray:
    """64-bit finaliser of integer keys: spreads neighbours over the ring."""
    x = keys.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounds(rows: int, shards: int, wanted: list[int]) -> list[int]:
    """The mean rounded up for the shards that the ring gives most, down for the rest."""
    least, more = divmod(rows, shards)
    first = set(sorted(range(shards), key=lambda s: (-wanted[s], s))[:more])
    return [least + (s in first) for s in range(shards)]


def walk(counts: dict[int, int], owners: np.ndarray, shards: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, first rank, last rank + 1, shard, first slot) of all arcs."""
    wanted = [0] * shards
    for arc, n in counts.items():
        wanted[owners[arc]] += n
    room = bounds(sum(counts.values()), shards, wanted)
    used, pieces, over = [0] * shards, [], []

    def give(arc: int, rank: int, left: int, shard: int) -> int:
        taken = min(left, room[shard] - used[shard])
        if taken > 0:
            pieces.append((arc, rank, rank + taken, shard, used[shard]))
            used[shard] += taken
        return max(0, taken)

    for arc in sorted(counts):  # what a shard owns comes first
        taken = give(arc, 0, counts[arc], int(owners[arc]))
        if taken < counts[arc]:
            over.append((arc, taken))
    for arc, rank in over:  # then overflow, clockwise
        at = arc
        while rank < counts[arc]:
            at = (at + 1) % len(owners)
            rank += give(arc, rank, counts[arc] - rank, int(owners[at]))
    return pieces


def measured(docs: DataFrame, shards: int, virtual: int) -> DataFrame:
    """Every row's size, checksum, task and arc."""
    places, _ = ring(shards, virtual)
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for batch in slices(batches):
            texts = as_bytes(batch.column("text"))
            keys = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            own = key_places(keys)
            arcs = np.searchsorted(places, own) % len(places)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t or b"") + OVERHEAD for t in texts], pa.int64()), pa.array([zlib.crc32(t or b"") for t in texts], pa.int64()),
                 pa.array(np.full(len(keys), task, dtype=np.int32)), pa.array(arcs.astype(np.int32)), pa.array(own.view(np.int64))],
                names=[x.split()[0] for x in MEASURED.split(", ")],
            )

    return plain.mapInArrow(run, MEASURED)


def assign(docs: DataFrame, *, shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and ring_shard: the shard before overflow."""
    spark = docs.sparkSession
    _, owners = ring(shards, virtual)
    rows = written(measured(docs, shards, virtual), "sharding")  # task numbers must not change between the jobs
    by_task = rows.groupBy("task", "arc").agg(F.count("*").alias("n"))
    # at most shards * virtual rows
    counts = {r["arc"]: r["n"] for r in by_task.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    # at most shards * virtual + shards rows
    pieces = spark.createDataFrame([(*p, int(owners[p[0]])) for p in walk(counts, owners, shards)], "arc int, low bigint, high bigint, shard int, slot0 bigint, ring_shard int")
    before = Window.partitionBy("arc").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("task", "arc", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("task", "arc").orderBy("place", "doc_id", "size", "text_crc32")
    ranked = rows.join(offsets, ["task", "arc"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)
    placed = ranked.join(F.broadcast(pieces), (ranked["arc"] == pieces["arc"]) & (ranked["rank"] >= pieces["low"]) & (ranked["rank"] < pieces["high"]))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot0") + F.col("rank") - F.col("low")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "ring_shard",
    )


def brute_owner(key: int, places: list[int], owners: list[int]) -> int:
    """The clockwise owner of a place, for tests."""
    return owners[bisect.bisect_left(places, key) % len(places)]
