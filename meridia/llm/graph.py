"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import written


#: Links that one task contracts (32 MB as numbers).
LOCAL = 2_000_000


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node that each reaches: hook to the lesser label, then jump, until nothing changes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        # a label's own root takes the lesser one too, so that whole trees move
        for side in (left, right):
            np.minimum.at(new, label[side], least)
            np.minimum.at(new, side, least)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """The links, dealt over tasks; each task's own components as stars around their least node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [(x.column("u").to_numpy(), x.column("v").to_numpy()) for x in batches]
        if sides:
            nodes, component = least_reached(*(np.concatenate(side) for side in zip(*sides)))
            rays = nodes != component
            nodes, component = nodes[rays], component[rays]
            for k in range(0, len(nodes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + (1 << 16)]), pa.array(component[k : k + (1 << 16)])], names=["u", "v"])

    dealt = F.pmod(F.xxhash64("u", "v"), F.lit(tasks))
    return edges.repartition(tasks, dealt).mapInArrow(run, "u bigint, v bigint").distinct()


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least of u and its neighbours as `least`."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    return edges.join(least, "u")


def components(links: DataFrame, name: str = "components", *, local: int = LOCAL) -> DataFrame:
    """(node, component): the least node that each linked node reaches. links: a bigint, b bigint.

    First every task of at most `local` links contracts its own to stars, which
    leaves little to do. Then two steps alternate until nothing changes: every
    node hands its larger neighbours to the least one (large star), then its
    smaller ones (small star). A node's neighbours are never gathered: the least
    is a partial aggregate and comes back by a join, which splits a hot node's
    rows. Every round is written to the shared folder.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    edges = written(_contracted(edges, max(1, -(-edges.count() // max(1, local)))), name)
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct()
        met = _with_least(large)
        small = met.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(met.select("u", F.col("least").alias("v")))
        edges = written(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
        before, state = state, _state(edges)
        if state == before:
            break
    own = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Changes whenever the set of edges does."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
