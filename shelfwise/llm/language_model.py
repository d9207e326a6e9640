"""Scores of texts under a hashed maximum-entropy language model with classes, beside a unigram base.

The next token's class has a softmax over hashed features of the two tokens before it: the last one, both, and the one
before the last alone (a skip). Within its class a token has its discounted share of the class's training tokens, and
what the discount frees is the probability of all tokens never seen. The end of a text and the most frequent words are
classes of their own, all others belong to a class by their last letters. The probabilities of the known tokens and
of an unknown one in each class sum to one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import Scratch, lean, release, text_chunks
from shelfwise.llm.hashing import Words, mix

SINGLES = 32  # classes of one token: the end and the most frequent words
ENDINGS = 32  # classes of all other words
CLASSES = SINGLES + ENDINGS
TABLE = 1 << 13  # rows of each of the three feature tables
DISCOUNT = 0.5
UNSEEN = 0.5  # added to every class, so none is empty
END = 1  # hash of the end of a text
START = 2  # stands before the first token
BATCH = 16384  # contexts scored at a time
BLOCK = 512  # rows of the feature tables whose sums travel together
ROUNDS = 5
RATE, EASE = 0.5, 1.0
# Words with at least this share of all training tokens are known to every task: there can be 2^20 of them.
HEAD_SHARE = 2.0**-20


@dataclass
class Tokens:
    """Tokens of some texts in turn, each text closed by an end."""

    hashes: np.ndarray
    endings: np.ndarray  # class by last letters, for tokens that are no class of their own
    text: np.ndarray

    @classmethod
    def of(cls, raw: list[bytes]) -> Tokens:
        w = Words(raw)
        n = w.hashes.size + len(raw)
        at = np.arange(w.hashes.size) + w.text
        end = np.ones(n, bool)
        end[at] = False
        hashes, endings = np.full(n, END, np.uint64), np.zeros(n, np.int32)
        hashes[at] = w.hashes
        last = w.buffer[w.ends - 1].astype(np.uint64) << np.uint64(8) | w.buffer[np.maximum(w.ends - 2, w.starts)]
        endings[at] = SINGLES + (mix(last) % np.uint64(ENDINGS)).astype(np.int32)
        text = np.zeros(n, np.int64)
        text[1:] = np.cumsum(end)[:-1]
        return cls(hashes, endings, text)

    def features(self) -> np.ndarray:
        """Rows of the feature tables for each token, one column per table."""
        before = []
        for back in (1, 2):
            h = np.full(self.hashes.size, START, np.uint64)
            same = self.text[back:] == self.text[:-back]
            h[back:][same] = self.hashes[:-back][same]
            before.append(h)
        one, two = before
        kinds = (one + np.uint64(11), one * np.uint64(3) + two, two * np.uint64(5) + np.uint64(7))
        rows = [(mix(k.copy()) % np.uint64(TABLE)).astype(np.int32) + i * TABLE for i, k in enumerate(kinds)]
        return np.stack(rows, axis=1)


def _contexts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of ``features`` in some texts, the place of each token's among them, and how many have it."""
    key = (rows[:, 1].astype(np.int64) * (3 * TABLE) + rows[:, 0]) * (3 * TABLE) + rows[:, 2]
    _, first, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return rows[first], inverse, n


def _scores(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of every class's sum of weights, less the largest, and that largest."""
    z = weights[rows[:, 0]]
    z += weights[rows[:, 1]]
    z += weights[rows[:, 2]]
    z += prior
    top = z.max(axis=1, keepdims=True)
    z -= top
    return np.exp(z, out=z), top[:, 0]


def class_logs(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each token's class after its features."""
    contexts, inverse, _ = _contexts(rows)
    norm = np.empty(len(contexts))
    for a in range(0, len(contexts), BATCH):
        z, top = _scores(weights, prior, contexts[a : a + BATCH])
        norm[a : a + BATCH] = np.log(z.sum(axis=1)) + top
    own = prior[classes].astype(float)
    for kind in range(3):
        own += weights[rows[:, kind], classes]
    return own - norm[inverse]


class Gradient:
    """Sums over tokens, per row of the feature tables and class: how often the class came, and how often the weights
    expect it. Their difference is the gradient of the log likelihood; no order of the tokens matters."""

    def __init__(self, prior: np.ndarray, weights: np.ndarray):
        self.prior, self.weights = prior, weights
        self.observed, self.expected = np.zeros((2, 3 * TABLE, CLASSES))

    def add(self, rows: np.ndarray, classes: np.ndarray) -> None:
        codes = rows.astype(np.int64) * CLASSES + classes[:, None]
        self.observed += np.bincount(codes.ravel(), minlength=3 * TABLE * CLASSES).reshape(3 * TABLE, CLASSES)
        contexts, _, n = _contexts(rows)
        every = np.arange(CLASSES)
        for a in range(0, len(contexts), BATCH):
            some = contexts[a : a + BATCH]
            p, _ = _scores(self.weights, self.prior, some)
            p *= (n[a : a + BATCH] / p.sum(axis=1)).astype(np.float32)[:, None]
            p = p.ravel()
            for kind in range(3):
                at = ((some[:, kind] - kind * TABLE).astype(np.int64)[:, None] * CLASSES + every).ravel()
                sums = np.bincount(at, weights=p, minlength=TABLE * CLASSES)
                self.expected[kind * TABLE : (kind + 1) * TABLE] += sums.reshape(TABLE, CLASSES)

    def packed(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Both sums in blocks of ``BLOCK`` rows: number of the block, its rows that are not empty, and their sums."""
        both = np.concatenate([self.observed, self.expected])
        for block in range(len(both) // BLOCK):
            part = both[block * BLOCK : (block + 1) * BLOCK]
            at = np.flatnonzero(part.any(axis=1)).astype(np.int32)
            if at.size:
                yield block, at, part[at].astype(np.float32)


SUMS_SCHEMA = "block int, at binary, sums binary"


def _sums_batch(block: int, at: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int32()), pa.array([at.tobytes()]), pa.array([sums.tobytes()])], ["block", "at", "sums"]
    )


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for block, at, sums in zip(*(batch.column(c) for c in ("block", "at", "sums")), strict=True):
        rows = np.frombuffer(at.as_py(), np.int32)
        yield block.as_py(), rows, np.frombuffer(sums.as_py(), np.float32).reshape(rows.size, CLASSES)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per block over the tasks; a partition holds all of a block, one after another, and keeps its total only."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, at, sums in _unpacked(batch):
            if block not in total:
                total[block] = np.zeros((BLOCK, CLASSES))
            total[block][at] += sums
    for block, sums in total.items():
        yield _sums_batch(block, np.arange(BLOCK, dtype=np.int32), sums.astype(np.float32))


def step(weights: np.ndarray, observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Weights after a gradient step with a rate for each weight.

    The rate is that of iterative scaling: one over the logarithmic mean of both sums, so that a weight that stood alone
    would come right at a ``RATE`` of one. ``EASE`` is added to both, so rare features move little.
    """
    o, e = observed + EASE, expected + EASE
    near = np.abs(o - e) < 1e-6 * e
    mean = np.where(near, e, (o - e) / np.where(near, 1.0, np.log(o / e)))
    return (weights + RATE * (observed - expected) / mean).astype(np.float32)


def _base(docs: DataFrame) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("long").cast("string")) % 5 == 1
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(held, F.lit(False)).alias("held_out"),
    )


def _raw(part: pa.RecordBatch) -> list[bytes]:
    return [x.as_py() for x in part.column("text").cast(pa.binary())]


def vocabulary(docs: DataFrame) -> DataFrame:
    """``h, ending, c`` of every token in the texts that are learnt from: hash, class by ending, and count."""

    def emit(held):
        h, inverse = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        c = np.bincount(inverse, weights=np.concatenate([x[2] for x in held])).astype(np.int64)
        ending = np.zeros(h.size, np.int32)
        ending[inverse] = np.concatenate([x[1] for x in held])
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ending), pa.array(c)], ["h", "ending", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in text_chunks(batch, "text"):
                t = Tokens.of(_raw(part))
                h, first, n = np.unique(t.hashes, return_index=True, return_counts=True)
                held.append((h, t.endings[first], n))
                size += h.size
                if size > 1 << 20:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    counted = _base(docs).where("NOT held_out").select("text").mapInArrow(run, "h long, ending int, c long")
    return counted.groupBy("h").agg(F.first("ending").alias("ending"), F.sum("c").alias("c"))


@dataclass
class Unigrams:
    """What every task knows of the training tokens: totals, the frequent words, and the classes."""

    tokens: int
    types: int
    head: np.ndarray  # hashes, ascending
    head_counts: np.ndarray
    singles: np.ndarray  # hashes of the tokens that are a class of their own, ascending
    single_class: np.ndarray
    class_tokens: np.ndarray  # training tokens of each class, and UNSEEN
    class_types: np.ndarray

    def classes(self, t: Tokens) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.singles, t.hashes), self.singles.size - 1)
        return np.where(self.singles[at] == t.hashes, self.single_class[at], t.endings)

    @property
    def prior(self) -> np.ndarray:
        return np.log(self.class_tokens / self.class_tokens.sum()).astype(np.float32)

    @property
    def total(self) -> float:
        return self.tokens + 0.5 * (self.types + 1)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / self.total)

    def within(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 probability of a token in its class."""
        size = self.class_tokens[classes]
        unseen = DISCOUNT * self.class_types[classes] + UNSEEN
        share = np.where(counts > 0, np.maximum(counts - DISCOUNT, 0.5), unseen) / size
        return np.where(classes < SINGLES, 0.0, np.log10(share))


def unigrams(vocab: DataFrame) -> Unigrams:
    """Totals, the at most ``1 / HEAD_SHARE`` frequent words, and class sizes of a written ``vocabulary``."""
    tokens, types = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    head = vocab.where(F.col("c") >= max(1.0, tokens * HEAD_SHARE)).toArrow()
    hashes = head["h"].to_numpy().view(np.uint64)
    counts, ending = head["c"].to_numpy(), head["ending"].to_numpy()
    class_tokens, class_types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in vocab.where("ending > 0").groupBy("ending").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        class_tokens[r.ending], class_types[r.ending] = r.c, r.n
    top = np.lexsort((hashes, -counts))
    top = top[hashes[top] != END][: SINGLES - 1]
    for i, j in enumerate(top, 1):
        class_tokens[i] = counts[j]
        class_tokens[ending[j]] -= counts[j]
        class_types[ending[j]] -= 1
    class_tokens[0] = counts[hashes == END].sum()
    singles = np.append(np.uint64(END), hashes[top])
    order, by_hash = np.argsort(singles), np.argsort(hashes)
    return Unigrams(
        tokens, types, hashes[by_hash], counts[by_hash], singles[order], order.astype(np.int32),
        class_tokens + UNSEEN, class_types,
    )


def train(docs: DataFrame, known: Unigrams) -> np.ndarray:
    """Weights of the feature tables after ``ROUNDS`` gradient steps, each over its own share of the learnt texts.

    A round takes the texts whose hash falls to it. Its tasks add up the gradient at the broadcast weights, Spark sums
    over the tasks, and all weights move together. The sums are the same however the table is split, so the model
    depends on the rows alone. What reaches the driver in a round has the size of the feature tables.
    """
    spark = docs.sparkSession
    rows = 3 * TABLE
    weights, prior = np.zeros((rows, CLASSES), np.float32), known.prior
    learnt = _base(docs).where("NOT held_out").select("text")
    unigrams = spark.sparkContext.broadcast(known)

    def sums(weights) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for part in text_chunks(batch, "text"):
                    total = total or Gradient(prior, weights.value)
                    t = Tokens.of(_raw(part))
                    total.add(t.features(), unigrams.value.classes(t))
            for block in total.packed() if total else ():
                yield _sums_batch(*block)

        return run

    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(weights)
        share = learnt.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == turn)
        found = share.mapInArrow(lean(sums(shared)), SUMS_SCHEMA).repartition("block").mapInArrow(_merged, SUMS_SCHEMA)
        table = found.toArrow()
        if table.num_rows:
            both = np.zeros((2 * rows, CLASSES))
            for batch in table.to_batches():
                for block, at, sums_of in _unpacked(batch):
                    both[block * BLOCK + at] += sums_of
            weights = step(weights, both[:rows], both[rows:])
        shared.destroy()
        del share, found, table
        release(spark)
    return weights


PART_SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
    "rare array<struct<h:long, class:int, n:int>>"
)


def _parts(docs: DataFrame, known: Unigrams, weights: np.ndarray) -> DataFrame:
    """Per row: sums over class probabilities and frequent words, and the words that are still to be looked up."""
    shared = docs.sparkSession.sparkContext.broadcast((known, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = shared.value
        prior = known.prior
        for batch in batches:
            for part in text_chunks(batch, "text"):
                raw = _raw(part)
                t, m = Tokens.of(raw), len(raw)
                classes, rows = known.classes(t), t.features()
                logs = class_logs(weights, prior, rows, classes)
                at = np.minimum(np.searchsorted(known.head, t.hashes), max(known.head.size - 1, 0))
                hit = known.head[at] == t.hashes if known.head.size else np.zeros(classes.size, bool)
                counts = known.head_counts[at[hit]]
                logs /= np.log(10)
                logs[hit] += known.within(counts, classes[hit])
                sums = np.bincount(t.text, weights=logs, minlength=m)
                base = np.bincount(t.text[hit], weights=known.base(counts), minlength=m)
                rare = np.flatnonzero(~hit)
                order = rare[np.lexsort((t.hashes[rare], t.text[rare]))]
                new = np.ones(order.size, bool)
                new[1:] = (t.text[order][1:] != t.text[order][:-1]) | (t.hashes[order][1:] != t.hashes[order][:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, order.size))
                heads = order[first]
                entries = pa.StructArray.from_arrays(
                    [pa.array(t.hashes[heads].view(np.int64)), pa.array(classes[heads].astype(np.int32)),
                     pa.array(n.astype(np.int32))], ["h", "class", "n"]
                )
                ends = np.searchsorted(t.text[heads], np.arange(m + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(np.bincount(t.text, minlength=m)),
                     pa.array(np.bincount(t.text[hit], minlength=m)), pa.array(base.astype(float)), pa.array(sums.astype(float)),
                     pa.ListArray.from_arrays(pa.array(ends), entries)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"],
                )

    return _base(docs).mapInArrow(run, PART_SCHEMA)


def score_texts(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Counts and the model are learnt from all rows whose id's checksum modulo 5 is not 1, so also from rows without id.
    A null or empty text is its end alone. Repeated rows count and come out as often as they went in. With nothing to
    learn from the base gives every token probability one and the model equal classes. An empty table gives no rows.

    Words frequent enough to be known to every task are looked up there; the others are joined to the vocabulary
    by their hash, each once per text. They are rare, so none of them gathers many rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "language-model")
    vocab = scratch.save(vocabulary(docs), "vocabulary")
    release(spark)
    known = unigrams(vocab)
    weights = train(docs, known)
    release(spark)
    rows = _parts(docs, known, weights).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.save(rows, "parts")
    rare = rows.select("row", F.explode("rare").alias("w")).select("row", "w.h", "w.class", "w.n")
    limit = max(1.0, known.tokens * HEAD_SHARE)
    found = rare.join(vocab.where(F.col("c") < limit).select("h", "c"), "h", "left").withColumn(
        "c", F.coalesce("c", F.lit(0))
    )
    sizes = F.array(*[F.lit(float(x)) for x in known.class_tokens])
    free = F.array(*[F.lit(float(DISCOUNT * x + UNSEEN)) for x in known.class_types])
    share = F.when(F.col("c") > 0, F.col("c") - DISCOUNT).otherwise(free[F.col("class")]) / sizes[F.col("class")]
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / known.total)).alias("more_base"),
        F.sum(F.col("n") * F.log10(share)).alias("more_score"),
    )
    return rows.drop("rare").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
