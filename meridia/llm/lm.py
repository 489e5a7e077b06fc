"""LM scoring: masked pseudo-likelihood by a bidirectional window network.

Every token is masked in turn and predicted from the SIDE tokens on either side;
a document's score is the sum of these conditional log-probabilities. Tokens are
words. The corpus gives an exact count of every distinct word, a written table
that no task holds whole. The network's classes grow with the square root of the
number of distinct words: the most frequent words, and an eighth as many hashed
classes for all others, within which a word's probability is its own share of the
corpus counts, joined by word. A softmax over groups of classes and one within
the token's group cost the root of the classes each.

Texts are read twice: once to count, once to write every row's classes as numbers.
Training and scoring read these.

Training passes once over every token of every document, in numpy, in tasks: a
round takes every ROUNDS-th row, every task descends through its own of them from
the common parameters, and the tasks' parameters are averaged by tokens, in parts
that stream through tasks of their own. Only the average, which is as large as
the network, reaches the driver. A lost task begins its round anew from the
broadcast parameters.

Nulls and edges: a null or empty text has no tokens, log-probability 0 and a null
mean; places beyond a document's edge are a class of their own; repeated rows
count as often as they stand; a word that the model never saw counts as seen
once; an empty table yields an empty table; a null doc_id stays null.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import as_bytes, item_words, slices, written

#: Least classes that are words, and how many of those one hashed class stands beside.
FREQUENT, PER_HASHED = 256, 8
#: Words of at least one in so many tokens have their counts broadcast; the others are joined.
HEAD = 1 << 20
#: Tokens seen to either side; numbers of a hidden state.
SIDE, WIDTH = 3, 12
#: Rounds of averaging, tokens of a step, Adagrad's rate.
ROUNDS, BATCH, RATE, SEED = 4, 8192, 0.1, 7
#: Training tasks for each core: as many copies of the parameters are sent in a round.
SHARDS = 4
#: Distinct words that a task holds before it sends their partial counts on.
HELD = 500_000
#: Shares are summed in units of 1 / UNIT; parameters are averaged in parts of PART numbers.
UNIT, PART = 1 << 24, 1 << 13

OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the exact count of every distinct word of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in slices(batches):
            for text in as_bytes(batch.column("text")):
                held.update(item_words(text))
            if len(held) > HELD:
                yield sent()
        yield sent()

    return _texts(docs).select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def words_for(distinct: int) -> int:
    """How many words have a class of their own among so many distinct ones."""
    return max(FREQUENT, math.isqrt(distinct))


class Classes:
    """Words to classes: 0 is beyond a document's edge, then the frequent words, then hashed classes.

    Words that were met are numbered; `classes` and `logs` tell each one's class and
    the logarithm of its count where a hashed class needs it (0 for a frequent word,
    NaN for a word whose count is not at hand).
    """

    def __init__(self, frequent: list[bytes], words: int, head: dict[bytes, int] | None = None):
        self.first, self.hashed, self.head = words + 1, max(1, words // PER_HASHED), head or {}
        self.frequent = {w: k + 1 for k, w in enumerate(frequent)}
        self._begin()

    def _begin(self) -> None:
        self.words = [*self.frequent, *(w for w in self.head if w not in self.frequent)]
        self.known = {w: k for k, w in enumerate(self.words)}
        own, met = len(self.frequent), len(self.words)
        self.classes, self.logs = np.empty(met + 2 * HELD, dtype=np.int32), np.zeros(met + 2 * HELD)
        self.classes[:own] = np.arange(1, own + 1)
        self.classes[own:met] = [self.one(w) for w in self.words[own:]]
        self.logs[own:met] = [math.log(self.head[w]) for w in self.words[own:]]

    @property
    def size(self) -> int:
        """Classes, the edge among them."""
        return self.first + self.hashed

    @property
    def kind(self) -> type:
        """The numbers that classes are written as."""
        return np.uint16 if self.size <= 1 << 16 else np.int32

    def one(self, word: bytes) -> int:
        found = self.frequent.get(word)
        return self.first + xxhash.xxh64_intdigest(word) % self.hashed if found is None else found

    def ids(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers; they hold until `forget`."""
        known = self.known
        out = list(map(known.get, words))
        if None in out:
            for k, found in enumerate(out):
                if found is None:
                    word = words[k]
                    if (found := known.get(word)) is None:
                        found = known[word] = len(self.words)
                        if found == len(self.classes):
                            self.classes, self.logs = np.concatenate([self.classes] * 2), np.concatenate([self.logs] * 2)
                        self.words.append(word)
                        self.classes[found] = self.one(word)
                        self.logs[found] = math.nan
                    out[k] = found
        return np.array(out, dtype=np.int64)

    def forget(self) -> None:
        """Between two batches: start anew where too many words are held."""
        if len(self.words) > len(self.frequent) + len(self.head) + HELD:
            self._begin()

    def of(self, words: list[bytes]) -> np.ndarray:
        return self.classes[self.ids(words)]


def stream(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' classes in a row with SIDE edges around each, and where each begins."""
    gap = np.zeros(SIDE, dtype=np.int32)
    starts = np.cumsum([SIDE] + [len(t) + SIDE for t in texts[:-1]]) if texts else np.zeros(0, dtype=np.int64)
    return np.concatenate([gap, *(x for t in texts for x in (t, gap))]), starts


def _softmax(logits: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every row, the log-probability of its own column; exponentials (in place of the logits) and their sums."""
    np.minimum(logits, 60, out=logits)  # beyond any that training reaches
    found = logits[np.arange(len(logits)), own]
    np.exp(logits, out=logits)
    sums = logits @ np.ones(logits.shape[1], dtype=logits.dtype)
    return found - np.log(sums), logits, sums


def _errors(hidden: np.ndarray, vectors: np.ndarray, bias: np.ndarray, own: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The summed loss of a softmax, and its gradients: by row of hidden, by vector, by bias."""
    found, error, sums = _softmax(hidden @ vectors.T + bias, own)
    # the narrow sides are divided by the sums, not the errors
    error[np.arange(len(own)), own] -= sums
    share = 1 / sums
    return -float(found.sum(dtype=np.float64)), (error @ vectors) * share[:, None], error.T @ (hidden * share[:, None]), error.T @ share


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order of the keys, the different ones, and where each begins in that order."""
    if len(keys) and keys.max() < 1 << 16:
        keys = keys.astype(np.uint16)  # sorted by digits
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return order, keys[first].astype(np.int64), first


class Network:
    """tanh of the neighbours' vectors, to a softmax over groups and one within the group.

    parts: neighbours (class, place and WIDTH), bias, groups (group, WIDTH) and their
    biases, members (group, member, WIDTH) and their biases; then Adagrad's sums,
    one for each row of those.
    """

    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts

    @classmethod
    def fresh(cls, counts: np.ndarray) -> Network:
        """Random vectors, and biases that say how often classes occur; counts: of every class, the edge's first."""
        rng, n = np.random.Generator(np.random.PCG64(SEED)), len(counts) - 1
        groups = math.isqrt(max(1, n - 1)) + 1
        members = -(-n // groups)
        own = np.zeros(groups * members)
        own[:n] = counts[1:] + 0.5
        own = own.reshape(groups, members)
        with np.errstate(divide="ignore"):
            biases = [np.log(own.sum(axis=1)), np.maximum(np.log(own), -60.0)]
        draw = lambda *shape: rng.standard_normal(shape) * 0.1
        parts = [draw(n + 1, len(OFFSETS) * WIDTH), np.zeros(WIDTH), draw(groups, WIDTH), np.maximum(biases[0], -60.0), draw(groups, members, WIDTH), biases[1]]
        sums = [np.full(p.shape[:-1] if p.ndim > 1 and k != 5 else p.shape, 1e-4) for k, p in enumerate(parts)]
        return cls([p.astype(np.float32) for p in (*parts, *sums)])

    @classmethod
    def empty_like(cls, shapes: list[tuple[int, ...]], numbers: np.ndarray) -> Network:
        cuts = np.cumsum([math.prod(s) for s in shapes])[:-1]
        return cls([x.reshape(s).copy() for x, s in zip(np.split(numbers, cuts), shapes)])

    def numbers(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def _hidden(self, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which places of a cut (with SIDE more on both sides) hold tokens, and their hidden states."""
        seen, n = self.parts[0][cut], len(cut) - 2 * SIDE
        at, total = np.flatnonzero(cut[SIDE : SIDE + n]), np.empty((n, WIDTH), dtype=np.float32)
        total[:] = self.parts[1]
        for k, offset in enumerate(OFFSETS):
            total += seen[SIDE + offset : SIDE + offset + n, k * WIDTH : (k + 1) * WIDTH]
        return at, np.tanh(total if len(at) == n else total[at])

    def log_probs(self, cut: np.ndarray) -> np.ndarray:
        """Of every token in a cut, the log-probability of its class."""
        at, hidden = self._hidden(cut)
        _, _, groups, group_bias, members, member_bias = self.parts[:6]
        own, member = np.divmod(cut[at + SIDE] - 1, members.shape[1])
        out = _softmax(hidden @ groups.T + group_bias, own)[0].astype(np.float64)
        order, found, first = _sorted(own)
        state, member, inner = hidden[order], member[order], np.empty(len(at), dtype=np.float32)
        for number, a, b in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(at)]):
            inner[a:b] = _softmax(state[a:b] @ members[number].T + member_bias[number], member[a:b])[0]
        out[order] += inner
        return out

    def step(self, cut: np.ndarray) -> tuple[float, int]:
        """One step of Adagrad on the tokens of a cut: their summed loss, and how many they are."""
        at, hidden = self._hidden(cut)
        if not len(at):
            return 0.0, 0
        near, bias, groups, group_bias, members, member_bias = self.parts[:6]
        own, member = np.divmod(cut[at + SIDE] - 1, members.shape[1])
        # the rows by their groups, so that a group's are one slice
        order, seen, first = _sorted(own)
        at, hidden, own, member = at[order], hidden[order], own[order], member[order]
        lost, back, *group_grads = _errors(hidden, groups, group_bias, own)
        grads = np.empty((len(seen), *members.shape[1:]), dtype=np.float32), np.empty((len(seen), members.shape[1]), dtype=np.float32)
        for k, (number, a, b) in enumerate(zip(seen.tolist(), first.tolist(), [*first[1:].tolist(), len(at)])):
            inner, more, grads[0][k], grads[1][k] = _errors(hidden[a:b], members[number], member_bias[number], member[a:b])
            lost += inner
            back[a:b] += more
        for part, rows, grad in ((2, slice(None), group_grads[0]), (3, slice(None), group_grads[1]), (4, seen, grads[0]), (5, seen, grads[1])):
            self._change(part, rows, grad)
        back *= 1 - hidden * hidden
        self._change(1, slice(None), back.sum(axis=0))
        # a word's vectors get the errors of the tokens that see it from each place
        wide, n = np.zeros((len(cut) + 2 * SIDE, WIDTH), dtype=np.float32), len(cut)
        wide[at + 2 * SIDE] = back
        order, found, first = _sorted(cut)
        grad = np.empty((len(found), len(OFFSETS) * WIDTH), dtype=np.float32)
        for k, offset in enumerate(OFFSETS):
            grad[:, k * WIDTH : (k + 1) * WIDTH] = np.add.reduceat(wide[SIDE - offset : SIDE - offset + n].take(order, axis=0), first, axis=0)
        self._change(0, found, grad)
        return lost, len(at)

    def _change(self, part: int, at, grad: np.ndarray) -> None:
        values, sums = self.parts[part], self.parts[part + 6]
        rows = values.ndim > 1 and part != 5
        sums[at] += np.einsum("...j,...j->...", grad, grad) / grad.shape[-1] if rows else grad * grad
        scale = RATE / np.sqrt(sums[at])
        values[at] -= grad * (scale[..., None] if rows else scale)


def cuts(classes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """A stream in cuts of at most `size` places, with SIDE more on both sides."""
    for k in range(SIDE, len(classes) - SIDE, size):
        yield classes[k - SIDE : min(len(classes) - SIDE, k + size) + SIDE]


def _averaged(rows: DataFrame, kind: type, network: Network, turn: int) -> tuple[Network, float, int]:
    """The network after a round over encoded rows, the round's mean loss, and its tokens."""
    spark = rows.sparkSession
    shapes = [p.shape for p in network.parts]
    block = spark.sparkContext.broadcast((shapes, network.numbers()))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, loss, tokens = Network.empty_like(*block.value), 0.0, 0
        held, size = [], 0
        for batch in slices(batches, 64):
            for found in batch.column("classes").to_pylist():
                if found:
                    held.append(np.frombuffer(found, dtype=kind))
                    size += len(held[-1])
            if size >= 16 * BATCH:
                for cut in cuts(stream(held)[0], BATCH):
                    lost, n = own.step(cut)
                    loss, tokens = loss + lost, tokens + n
                held, size = [], 0
        for cut in cuts(stream(held)[0], BATCH) if held else ():
            lost, n = own.step(cut)
            loss, tokens = loss + lost, tokens + n
        if tokens:
            numbers = own.numbers()
            for k in range(0, len(numbers), PART):
                yield pa.RecordBatch.from_arrays([pa.array([k // PART], pa.int32()), pa.array([tokens], pa.int64()), pa.array([loss]), pa.array([numbers[k : k + PART].tobytes()], pa.binary())], names=["part", "tokens", "loss", "numbers"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for part, tokens, loss, numbers in zip(*(batch.column(k).to_pylist() for k in range(4))):
                sums = total.setdefault(part, [0, 0.0, 0.0])
                sums[0] += tokens
                sums[1] += loss
                sums[2] = sums[2] + np.frombuffer(numbers, dtype=np.float32).astype(np.float64) * tokens
        for part, (tokens, loss, sums) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([tokens], pa.int64()), pa.array([loss]), pa.array([(sums / tokens).astype(np.float32).tobytes()], pa.binary())], names=["part", "tokens", "loss", "numbers"])

    rows = rows.filter(F.pmod("row", F.lit(ROUNDS)) == turn).select("classes")
    rows = rows.coalesce(SHARDS * spark.sparkContext.defaultParallelism)
    schema = "part int, tokens bigint, loss double, numbers binary"
    found = rows.mapInArrow(train, schema).repartition("part").mapInArrow(average, schema).collect()
    block.unpersist()
    if not found:
        return network, 0.0, 0
    numbers = np.concatenate([np.frombuffer(r["numbers"], dtype=np.float32) for r in sorted(found, key=lambda r: r["part"])])
    return Network.empty_like(shapes, numbers), found[0]["loss"] / found[0]["tokens"], found[0]["tokens"]


class Encoder:
    """What tasks need to number a text's words, all but the counts of rare words."""

    def __init__(self, frequent: list[bytes], words: int, totals: np.ndarray, head: dict[bytes, int]):
        self.frequent, self.words, self.totals, self.head = frequent, words, totals, head
        self._classes = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_classes": None}

    @property
    def kind(self) -> type:
        return Classes(self.frequent, self.words).kind

    def encode(self, texts: list[list[bytes]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Of each text its classes and the logarithms of its words' shares of them, but for those of rare words' counts; then how many different ones it has, these words and how often each stands."""
        if self._classes is None:
            self._classes = Classes(self.frequent, self.words, self.head)
        known = self._classes
        known.forget()
        sizes = [len(t) for t in texts]
        ids = known.ids(list(chain.from_iterable(texts)))
        text = np.repeat(np.arange(len(texts)), sizes)
        classes, logs = known.classes[ids], known.logs[ids]
        unknown = np.isnan(logs)
        logs[unknown] = 0
        tails = classes >= known.first
        logs[tails] -= self.totals[classes[tails]]
        pairs, times = np.unique(text[unknown] * len(known.words) + ids[unknown], return_counts=True)
        text_of, word = np.divmod(pairs, max(1, len(known.words)))
        rows = np.split(classes.astype(known.kind), np.cumsum(sizes)[:-1]) if sizes else []
        shares = np.bincount(text, weights=logs, minlength=len(texts))
        return rows, shares, np.bincount(text_of, minlength=len(texts)), [known.words[k] for k in word.tolist()], times


class Scorer(Encoder):
    """An encoder and the network that scores what it wrote."""

    def __init__(self, encoder: Encoder, network: Network):
        super().__init__(encoder.frequent, encoder.words, encoder.totals, encoder.head)
        self.network = network


def log_probs(network: Network, rows: list[np.ndarray]) -> list[float]:
    """Of each row of classes, the summed log-probability of these."""
    row, starts = stream(rows)
    each = np.zeros(len(row) + 1)
    at = SIDE
    for cut in cuts(row, BATCH):
        places = at + np.flatnonzero(cut[SIDE : len(cut) - SIDE])
        each[places] = network.log_probs(cut)
        at += BATCH
    return [float(each[start : start + len(own)].sum()) for own, start in zip(rows, starts.tolist())]


class Model:
    """The scorer, the table of all words' counts, the mean loss of every round, and the rows it was fitted on with what was written of them."""

    def __init__(self, scorer: Scorer, words: DataFrame, losses: list[float], docs: DataFrame, rows: DataFrame):
        self.scorer, self.words, self.losses, self.docs, self.rows = scorer, words, losses, docs, rows


def _totals(words: DataFrame, frequent: Broadcast, own: int) -> np.ndarray:
    """Tokens of every class, from the counts of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(frequent.value, own)
        total = np.zeros(classes.size, dtype=np.int64)
        for batch in batches:
            np.add.at(total, [classes.one(w) for w in batch.column("word").to_pylist()], batch.column("n").to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["class", "n"])

    out = np.zeros(Classes(frequent.value, own).size)
    for r in words.select("word", "n").mapInArrow(run, "class int, n bigint").groupBy("class").agg(F.sum("n").alias("n")).collect():
        out[r["class"]] = r["n"]
    return out


def encoded(docs: DataFrame, encoder: Encoder) -> DataFrame:
    """row, doc_id, n_tokens, classes, shares and rare words of every row, written; a row's number is its place."""
    block: Broadcast = docs.sparkSession.sparkContext.broadcast(encoder)
    entry = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rows, shares, many, rare, times = block.value.encode([item_words(t) for t in as_bytes(batch.column("text"))])
            ends = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], fields=list(entry.value_type)))
            sizes, classes = pa.array([len(x) for x in rows], pa.int64()), pa.array([x.tobytes() for x in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, classes, pa.array(shares, pa.float64()), lists], names=["doc_id", "n_tokens", "classes", "shares", "rare"])

    made = _texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, classes binary, shares double, rare array<struct<word:binary,times:bigint>>")
    return written(made.withColumn("row", F.monotonically_increasing_id()), "lm-encoded")


def fit(docs: DataFrame) -> Model:
    """Counts over all documents, then their classes, then the network."""
    spark = docs.sparkSession
    words = written(word_counts(docs), "lm-words")
    sums = words.agg(F.count("*").alias("distinct"), F.sum("n").alias("tokens")).first()
    own = words_for(sums["distinct"])
    frequent = [bytes(r["word"]) for r in words.orderBy(F.desc("n"), "word").limit(own).collect()]
    # at most HEAD words are one in HEAD tokens each
    head = {bytes(r["word"]): r["n"] for r in words.filter(F.col("n") * HEAD >= (sums["tokens"] or 0)).collect()}
    totals, losses = _totals(words, spark.sparkContext.broadcast(frequent), own), []
    encoder = Encoder(frequent, own, np.log(np.maximum(totals, 1)), head)
    rows, network = encoded(docs, encoder), Network.fresh(totals)
    for turn in range(ROUNDS):
        network, loss, _ = _averaged(rows, encoder.kind, network, turn)
        losses.append(loss)
    return Model(Scorer(encoder, network), words, losses, docs, rows)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob of every row; the rows that the model was fitted on are not encoded again."""
    rows = model.rows if docs is model.docs else encoded(docs, model.scorer)
    block: Broadcast = docs.sparkSession.sparkContext.broadcast(model.scorer.network)
    kind = model.scorer.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = log_probs(block.value, [np.frombuffer(x, dtype=kind) for x in batch.column("classes").to_pylist()])
            base = pa.array(np.array(found) + batch.column("shares").to_numpy(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("row", "doc_id", "n_tokens")), base], names=["row", "doc_id", "n_tokens", "base"])

    made = rows.select("row", "doc_id", "n_tokens", "classes", "shares").mapInArrow(run, "row bigint, doc_id bigint, n_tokens bigint, base double")
    made = written(made, "lm-scored")
    met = rows.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.times").join(model.words, "word", "left")
    shares = met.groupBy("row").agg(F.sum(F.col("times") * F.round(F.log(F.coalesce("n", F.lit(1)).cast("double")) * UNIT).cast("bigint")).alias("share"))
    total = F.col("base") + F.coalesce("share", F.lit(0)) / F.lit(float(UNIT))
    mean = F.when(F.col("n_tokens") > 0, total / F.col("n_tokens"))
    return made.join(shares, "row", "left").select("doc_id", "n_tokens", total.alias("log_prob"), mean.alias("mean_log_prob"))
