"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Every text becomes its set of word shingles, a MinHash signature and a key of
   the whole set. Equal sets are one class from here on.
2. Classes are posted under their signature's coordinate-value pairs. Of K
   coordinates, linked sets share T or more (but for one pair in 10^7 of those just linked); so of
   each signature, taken rarest first, only the first K - T + 1 pairs are
   posted, and linked classes still meet in some list.
3. Within a list, sorted by set size, a class is held against those whose size
   allows a link; the rest is skipped. Collisions are counted on two bits of
   every coordinate. Of the pairs above the match threshold a list returns a
   spanning forest, not all pairs. In a list that may be long a class is held
   against those only that share a second pair with it: of the first K - T + 2
   pairs linked classes share two.
4. The forests' components are groups of near copies. Each class's text travels
   once to its group, where links are confirmed on full sets, again without all
   pairs: what a class already reaches need not be compared.
5. The confirmed links' components are the result.

A list or group that is too large for a task is cut into blocks, and every two
blocks meet in a task of their own, so nothing is capped. Lists are counted
exactly where they may be too large. Written tables in the shared folder cut the
lineage; the rows are written first and numbered, and texts are found by that
number, so results don't hang on doc_ids.

Nulls and edges: a null text, or one without words, is empty, linked with
nothing, and its own component; a text of fewer words than a shingle is one
shingle; rows that share a doc_id or have none are judged apart, each by its
text; the component of rows without ids alone is null; `keep_one` keeps of every
component one row, that of the least doc_id (a row with an id before one without,
then the first as written), and every empty row; an empty table yields an empty
table; extra columns are kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import as_bytes, blank_words, lower_ascii, slices, written
from meridia.llm.graph import components

WORDS = 4
#: Links: 100 * intersection >= LINK * union.
LINK = 80
#: Coordinates, and how many collide at least in a linked pair (P of fewer at 0.8: 4e-8).
K, T = 64, 32
#: Of linked pairs, so many coordinates agree in their two bits at least (each with probability 0.85).
AGREE = 36
#: Counters of coordinate-value pairs; only what is frequent must stand out.
COUNTERS = 1 << 16
#: Classes of a list, and shingles of a group, that one task takes; more are cut into blocks.
LIST, GROUP = 50_000, 2_000_000
#: Lists that may be cut at most (their sizes are broadcast, 16 MB): beyond 3 * 10^10 postings per 2^20, LIST grows.
CUT_LISTS = 1 << 20
#: Lists expected to hold more classes carry each class's other pairs.
LONG = 1_000

_ODD = (np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, size=(2, K), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
SIGNED = "row bigint, doc_id bigint, n bigint, key binary, signature binary"
POSTED = "list bigint, block int, node bigint, n bigint, low bigint, high bigint, others binary"
EDGES = "a bigint, b bigint"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sets of shingle hashes; remembers the hashes of words."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def hashes(self, text: bytes | None) -> np.ndarray:
        """The sorted distinct shingles of a text as 64-bit hashes."""
        found = blank_words(lower_ascii(text)) if text else []
        if not found:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        if len(known) > 1 << 19:
            known.clear()
        own = np.empty(len(found), dtype=np.uint64)
        for k, word in enumerate(found):
            h = known.get(word)
            if h is None:
                h = known[word] = xxhash.xxh64_intdigest(word)
            own[k] = h
        size = min(self.words, len(own))
        n = len(own) - size + 1
        out = np.full(n, size, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(size):
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + own[j : j + n])
        return np.unique(out)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of non-empty sets: signatures (uint32, one row each) and 16-byte keys."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), K), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(K):
            out[:, k] = np.minimum.reduceat(((flat * _ODD[0, k] + _ODD[1, k]) >> np.uint64(32)).astype(np.uint32), starts)
        keys = np.stack([np.add.reduceat(mix(flat + np.uint64(c)), starts) for c in (1, 2)], axis=1)
    return out, keys


def _signed(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches, 256):
            sets = [shingler.hashes(t) for t in as_bytes(batch.column("text"))]
            full = [s for s in sets if len(s)]
            made = signatures(full) if full else None
            rows = iter(range(len(full)))
            at = [next(rows) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([None if k is None else made[1][k].tobytes() for k in at], pa.binary()), pa.array([None if k is None else made[0][k].tobytes() for k in at], pa.binary())],
                names=["row", "doc_id", "n", "key", "signature"],
            )

    return docs.select("row", "doc_id", "text").mapInArrow(run, SIGNED)


def _matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def pairs_of(signature: np.ndarray) -> np.ndarray:
    """Hashes of the coordinate-value pairs of signatures."""
    return mix(signature.astype(np.uint64) | (np.arange(signature.shape[1], dtype=np.uint64) << np.uint64(32)))


def _counters(classes: DataFrame) -> Broadcast:
    """How many classes have a coordinate-value pair, by COUNTERS buckets: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in slices(batches):
            pairs = pairs_of(_matrix(batch.column("signature"), np.uint32, K))
            total += np.bincount((pairs & np.uint64(COUNTERS - 1)).astype(np.int64).ravel(), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    counted = classes.select("signature").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = np.zeros(COUNTERS, dtype=np.int64)
    for row in counted.collect():
        table[row["bucket"]] = row["n"]
    return classes.sparkSession.sparkContext.broadcast(table)


def two_bits(signature: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, in K / 32 words."""
    bits = (mix(signature.astype(np.uint64)) & np.uint64(3)).reshape(len(signature), K // 32, 32)
    return np.bitwise_or.reduce(bits << (2 * np.arange(32, dtype=np.uint64)), axis=2)


def agreeing(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many coordinates agree in their two bits."""
    differ = others ^ one
    differ = (differ | (differ >> np.uint64(1))) & np.uint64(0x5555555555555555)
    return K - np.bitwise_count(differ).sum(axis=1).astype(np.int64)


def _prefix(batch: pa.RecordBatch, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, their first K - T + 2 coordinate-value pairs, rarest first, and how often each one's counter was met."""
    signature = _matrix(batch.column("signature"), np.uint32, K)
    pairs = pairs_of(signature)
    often = table[(pairs & np.uint64(COUNTERS - 1)).astype(np.int64)]
    order = np.lexsort((pairs, often))[:, : K - T + 2]
    return signature, np.take_along_axis(pairs, order, 1), np.take_along_axis(often, order, 1)


def _blocks(classes: DataFrame, counters: Broadcast, most: int) -> Broadcast:
    """Sorted lists of more than `most` classes, and how many blocks each is cut into."""
    lists = blocks = np.zeros(0, dtype=np.int64)
    if counters.value.max(initial=0) > most:  # a list is no longer than its counter

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1 << 14):
                _, pairs, often = _prefix(batch, counters.value)
                found, n = np.unique(pairs[:, : K - T + 1][often[:, : K - T + 1] > most], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["list", "n"])

        counted = classes.select("signature").mapInArrow(run, "list bigint, n bigint").groupBy("list").agg(F.sum("n").alias("n")).filter(F.col("n") > most)
        rows = counted.collect()
        lists, n = (np.array([r[k] for r in rows], dtype=np.int64) for k in ("list", "n"))
        order = np.argsort(lists.view(np.uint64))
        lists, blocks = lists[order], -(-n[order] // most)
    return classes.sparkSession.sparkContext.broadcast((lists.view(np.uint64), blocks))


def _posted(classes: DataFrame, counters: Broadcast, cut: Broadcast) -> DataFrame:
    """Each class under the first K - T + 1 coordinate-value pairs of its signature, rarest first.

    In a list that is cut a class is posted under every two blocks that hold its own.
    """
    names = [x.split()[0] for x in POSTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (known, parts) = counters.value, cut.value
        usual = int(table.mean())
        for batch in slices(batches):
            signature, prefix, often = _prefix(batch, table)
            node, taken = batch.column("node").to_numpy(), K - T + 1
            lists, long = prefix[:, :taken].ravel(), (often[:, :taken] > 2 * usual + LONG).ravel()
            blocks = np.ones(len(lists), dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, lists), len(known) - 1)
                blocks = np.where(known[at] == lists, parts[at], 1)
            rows = np.repeat(np.arange(len(node)), taken)
            own = (mix(node.astype(np.uint64))[rows] % blocks.astype(np.uint64)).astype(np.int64)
            # (i, j) with i <= j, one of them the class's own block
            copy = np.repeat(np.arange(len(rows)), blocks)
            other = np.arange(len(copy)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            first, second = np.minimum(own[copy], other), np.maximum(own[copy], other)
            rows, bits = rows[copy], two_bits(signature).view(np.int64)
            packed = np.ascontiguousarray(prefix.astype(np.uint32)).view(f"V{4 * prefix.shape[1]}").ravel().tolist()
            others = [packed[r] if wide else None for r, wide in zip(rows.tolist(), long[copy].tolist())] if long.any() else [None] * len(rows)
            made = pa.RecordBatch.from_arrays(
                [pa.array(lists[copy].view(np.int64)), pa.array((first * blocks[copy] + second).astype(np.int32)), pa.array(node[rows]), batch.column("n").take(pa.array(rows)), pa.array(bits[rows, 0]), pa.array(bits[rows, 1]), pa.array(others, pa.binary())],
                names=names,
            )
            yield from slices(iter([made]), 1 << 16)

    return classes.select("node", "n", "signature").mapInArrow(run, POSTED)


class Runs:
    """Rows of sorted batches, handed out by runs of equal keys; only one run is held."""

    def __init__(self, batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]):
        self.batches, self.keys = batches, keys

    def __iter__(self) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in self.batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in self.keys]
            cut = np.zeros(batch.num_rows, dtype=bool)
            for c in columns:
                cut[1:] |= c[1:] != c[:-1]
            cuts = np.flatnonzero(cut)
            if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in self.keys):
                yield pa.Table.from_batches(held)
                held = []
            at = 0
            for cut_at in cuts:
                piece = batch.slice(at, cut_at - at)
                if held:
                    yield pa.Table.from_batches([*held, piece])
                    held = []
                elif cut_at - at > 1:  # single rows have no partner
                    yield pa.Table.from_batches([piece])
                at = cut_at
            held.append(batch.slice(at))
        if held:
            yield pa.Table.from_batches(held)


def forest(count: int, near) -> list[tuple[int, int]]:
    """A spanning forest of a graph that `near(i, among)` shows: i's neighbours among the members that are marked.

    Goes outwards from one member; where fewer members are left than are still
    to be expanded, those are asked instead, so that neither a large component
    nor many single members cost all pairs if they need not.
    """
    alive, left, found = np.ones(count, dtype=bool), count, []
    for start in range(count):
        if left < 2:
            break
        if not alive[start]:
            continue
        alive[start], left = False, left - 1
        inside, waiting = [start], [start]
        while waiting and left:
            if left < len(waiting):  # ask those that are left
                members = np.zeros(count, dtype=bool)
                members[inside] = True
                waiting = []
                for i in np.flatnonzero(alive).tolist():
                    if len(met := near(i, members)):
                        found.append((i, int(met[0])))
                        waiting.append(i)
                inside += waiting
                alive[waiting] = False
                left -= len(waiting)
            else:
                i = waiting.pop()
                met = near(i, alive)
                if len(met):
                    found += [(i, j) for j in met.tolist()]
                    inside += met.tolist()
                    waiting += met.tolist()
                    alive[met] = False
                    left -= len(met)
    return found


class Sharing:
    """Which members share a value: an inverted index of their rows of values."""

    def __init__(self, values: np.ndarray, owner: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]

    def among(self, own: np.ndarray, marked: np.ndarray) -> np.ndarray:
        """Marked members that hold any of the values; of many places, all marked members."""
        lo, hi = np.searchsorted(self.values, own), np.searchsorted(self.values, own, side="right")
        n = hi - lo
        if int(n.sum()) >= len(marked):
            return np.flatnonzero(marked)
        at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        found = np.unique(self.owner[at])
        return found[marked[found]]


def _edges(pairs: list[tuple[int, int]], nodes: np.ndarray) -> pa.RecordBatch:
    at = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(nodes[at[:, 0]]), pa.array(nodes[at[:, 1]])], names=["a", "b"])


def _merged(posted: DataFrame, link: int) -> DataFrame:
    """Spanning forests of every list's pairs above the match threshold."""
    dealt = posted.repartition("list", "block").sortWithinPartitions("list", "block", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for rows in Runs(batches, ("list", "block")):
            if rows.num_rows < 2:
                continue
            node, n = rows["node"].to_numpy(), rows["n"].to_numpy()
            bits = np.stack([rows["low"].to_numpy(), rows["high"].to_numpy()], axis=1).view(np.uint64)

            packed = rows["others"].to_pylist()
            sharing = None
            if packed[0] is not None:  # a list's rows all have it or none
                shared = np.frombuffer(b"".join(packed), dtype=np.uint32).reshape(len(node), -1)
                second = shared != np.uint32(rows["list"][0].as_py() & 0xFFFFFFFF)
                sharing = Sharing(shared[second], np.nonzero(second)[0])

            def near(i: int, marked: np.ndarray) -> np.ndarray:
                others = np.flatnonzero(marked) if sharing is None else sharing.among(shared[i][second[i]], marked)
                # sorted by size: skip what is too small or too large
                sizes = n[others]
                fits = others[(100 * np.minimum(sizes, n[i]) >= link * np.maximum(sizes, n[i]))]
                return fits[agreeing(bits[i], bits[fits]) >= AGREE] if len(fits) else fits

            pairs = [p for p in forest(len(node), near) if node[p[0]] != node[p[1]]]
            new = [p for p in pairs if (q := (min(node[p[0]], node[p[1]]), max(node[p[0]], node[p[1]]))) not in seen and not seen.add(q)]
            if len(seen) > 1 << 18:
                seen.clear()
            if new:
                yield _edges(new, node)

    return dealt.mapInArrow(run, EDGES)


def _confirmed(docs: DataFrame, members: DataFrame, words: int, link: int, most: int) -> DataFrame:
    """Spanning forests of the links that full sets confirm, group by group.

    members: node, first_row, n, grp. A group of more than `most` shingles is cut
    into blocks by node; every two blocks meet.
    """
    sizes = members.groupBy("grp").agg(F.ceil(F.sum("n") / most).cast("int").alias("blocks"))
    own = members.join(sizes, "grp").join(docs.select(F.col("row").alias("first_row"), "text"), "first_row")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = own.select("grp", "node", "text", "blocks", block.alias("block"), other.alias("other"))
    met = met.select("grp", (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).alias("block"), "node", "text")
    dealt = met.repartition("grp", "block").sortWithinPartitions("grp", "block", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for rows in Runs(slices(batches, 512), ("grp", "block")):
            sets, nodes = [shingler.hashes(t) for t in as_bytes(rows["text"])], rows["node"].to_numpy()
            if len(nodes) < 2:
                continue
            pairs = linked(sets, link)
            if pairs:
                yield _edges(pairs, nodes)

    return dealt.mapInArrow(run, EDGES)


def linked(sets: list[np.ndarray], link: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= link * union."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= link * (int(sizes.sum()) - both) else []
    # of every set the shingles that are rarest here: linked sets share one of the first n - LINK % of n, and one more
    _, which, often = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((which, often[which], owner))
    ends = np.cumsum(sizes)
    place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    first = place < np.repeat(sizes - -(-link * sizes // 100) + 1, sizes)
    rare, holder = which[order][first], owner[first]
    sharing, cuts = Sharing(rare, holder), np.searchsorted(holder, np.arange(len(sizes) + 1))

    def near(i: int, marked: np.ndarray) -> np.ndarray:
        others = sharing.among(rare[cuts[i] : cuts[i + 1]], marked)
        others = others[100 * np.minimum(sizes[others], sizes[i]) >= link * np.maximum(sizes[others], sizes[i])]
        if not len(others):
            return others
        met = [sets[k] for k in others.tolist()]
        at = np.concatenate(met)
        place = np.minimum(np.searchsorted(sets[i], at), len(sets[i]) - 1)
        both = np.add.reduceat((sets[i][place] == at).astype(np.int64), np.cumsum([0] + [len(m) for m in met[:-1]]))
        return others[100 * both >= link * (sizes[others] + sizes[i] - both)]

    return forest(len(sets), near)


def _judged(table: DataFrame, words: int, link: int, most_list: int, most_group: int) -> DataFrame:
    """row, doc_id, n, component_id and kept_row (the one row of its component that `keep_one` keeps) of a written table of row, doc_id, text."""
    signed = written(_signed(table, words), "neardup-signed")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    classes = signed.filter("key is not null").groupBy("key").agg(best, F.min("row").alias("first_row"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "neardup-classes")
    most_list = max(most_list, classes.count() * (K - T + 1) // CUT_LISTS)
    counters = _counters(classes)
    groups = components(_merged(_posted(classes, counters, _blocks(classes, counters, most_list)), link), "neardup-groups")
    members = classes.select("node", "first_row", "n").join(groups, "node").withColumnRenamed("component", "grp")
    found = components(_confirmed(table, members, words, link, most_group), "neardup-components")
    # the best row of every component, then of every class; null keys join nothing, so they stay out of the joins
    own = classes.select("node", "best", "key").join(found, "node", "left")
    grouped, alone = own.filter("component is not null"), own.filter("component is null")
    least = grouped.groupBy("component").agg(F.min("best").alias("least"))
    by_key = grouped.join(least, "component").select("key", "least").unionByName(alone.select("key", F.col("best").alias("least")))
    full = signed.select("row", "doc_id", "n", "key").filter("key is not null").join(by_key, "key").select("row", "doc_id", "n", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("kept_row"))
    empty = signed.filter("key is null").select("row", "doc_id", "n", F.col("doc_id").alias("component_id"), F.col("row").alias("kept_row"))
    return full.unionByName(empty)


def near_duplicates(docs: DataFrame, *, words: int = WORDS, link: int = LINK, most_list: int = LIST, most_group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = written(plain.withColumn("row", F.monotonically_increasing_id()), "neardup-rows")
    found = _judged(table, words, link, most_list, most_group)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, *, words: int = WORDS, link: int = LINK, most_list: int = LIST, most_group: int = GROUP) -> DataFrame:
    """One row of every component, and all empty ones, with the columns they came with."""
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    held = written(docs.select(*own, F.monotonically_increasing_id().alias("row")), "neardup-rows")
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    table = held.select("row", doc_id.cast("bigint").alias("doc_id"), text.cast("string").alias("text"))
    gone = _judged(table, words, link, most_list, most_group).filter("row <> kept_row").select("row")
    return held.join(gone, "row", "left_anti").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def brute(texts: dict, words: int = WORDS, link: int = LINK) -> dict:
    """doc id -> (size, component), pair by pair, for tests."""
    sets = {}
    for doc, text in texts.items():
        found = blank_words(lower_ascii(text)) if text else []
        size = min(words, len(found))
        sets[doc] = {tuple(found[k : k + size]) for k in range(len(found) - size + 1)} if found else set()
    least = {d: d for d in sets}

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    docs = sorted(sets)
    for k, a in enumerate(docs):
        for b in docs[k + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= link * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    least[y] = x
    return {d: (len(sets[d]), top(d)) for d in docs}
