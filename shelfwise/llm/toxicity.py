"""Toxicity scores by logistic regression over hashed word n-grams and skip-grams, learnt with FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import Scratch, lean, release, text_chunks
from shelfwise.llm.hashing import Words, mix

DIMENSIONS = 1 << 20
# At most about so many labelled rows are learnt from: those with the smallest hashes of their ids.
SAMPLE_ROWS = 24_000
# The sample is learnt in so many parts side by side, whatever the cluster, and the parts are averaged after each epoch.
PARTS = 4
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
BIAS = DIMENSIONS  # place of the constant feature
THRESHOLD = 0.7
PREFIXES = (4, 5)


def features(raw: list[bytes], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of some texts and the text of each: words, word beginnings, pairs, and pairs one word apart.

    Marks at the ends of words do not count. A feature of a text may come more than once.
    """
    w = Words(raw, bare=True)
    kinds = [w.hashes, *(w.prefix(n) for n in PREFIXES)]
    owners = [w.text] * len(kinds)
    for gap in (1, 2):
        same = np.flatnonzero(w.text[:-gap] == w.text[gap:])
        kinds.append(w.hashes[same] * np.uint64(3) + w.hashes[same + gap])
        owners.append(w.text[same])
    salted = [mix(k + np.uint64(i + 1)) for i, k in enumerate(kinds)]
    return (np.concatenate(salted) & np.uint64(dimensions - 1)).astype(np.int32), np.concatenate(owners)


def _distinct(places: np.ndarray, owners: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct features of each of ``n`` texts, ascending."""
    codes = np.unique(owners.astype(np.int64) * (DIMENSIONS + 1) + places)
    owner, place = codes // (DIMENSIONS + 1), (codes % (DIMENSIONS + 1)).astype(np.int32)
    return np.split(place, np.searchsorted(owner, np.arange(1, n)))


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of the proximal step: zero where the gradients do not outweigh the L1 penalty."""
    shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def _learn_part(rows: list[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass over ``rows`` (features, label); ``z`` and ``n`` are updated coordinate by coordinate."""
    for place, label in rows:
        place = np.append(place, BIAS)
        w = weights(z[place], n[place])
        w[-1] = -z[BIAS] / ((BETA + np.sqrt(n[BIAS])) / ALPHA)  # the constant is not penalised
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        after = n[place] + g * g
        z[place] += g - (np.sqrt(after) - np.sqrt(n[place])) / ALPHA * w
        n[place] = after


def _pass_over(state):
    """A function that learns a task's parts, each from the broadcast ``state``, and returns how the state has changed:
    sums over the parts of the change times the part's rows, and the rows themselves at place -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            lists = batch.column("features")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            columns = (batch.column(c).to_pylist() for c in ("part", "place", "doc_id", "label"))
            for i, (part, place, doc_id, label) in enumerate(zip(*columns, strict=True)):
                parts.setdefault(part, []).append((place, doc_id, flat[ends[i] : ends[i + 1]], label))
        dz, dn = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
        total = 0
        for _, held in sorted(parts.items()):
            held.sort(key=lambda r: r[:2])
            z, n = (x.copy() for x in state.value)
            _learn_part([r[2:] for r in held], z, n)
            dz += (z - state.value[0]) * len(held)
            dn += (n - state.value[1]) * len(held)
            total += len(held)
        at = np.flatnonzero(dn)
        columns = [np.append(at, -1).astype(np.int32), np.append(dz[at], total), np.append(dn[at], 0.0)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["at", "dz", "dn"])

    return run


def _train(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``z`` and ``n`` after all epochs over ``rows (part, place, features, label)``, a written table dealt by part.

    Each epoch is one Spark job: every part starts from the broadcast state; the mean change by rows, at most one row
    per coordinate, comes back.
    """
    spark = rows.sparkSession
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for _ in range(EPOCHS):
        state = spark.sparkContext.broadcast((z, n))
        changes = rows.mapInArrow(lean(_pass_over(state)), "at int, dz double, dn double")
        table = changes.groupBy("at").agg(F.sum("dz").alias("dz"), F.sum("dn").alias("dn")).toArrow()
        at, dz, dn = (table[c].to_numpy() for c in ("at", "dz", "dn"))
        total = max(1.0, dz[at < 0].sum())
        real = at >= 0
        z[at[real]] += dz[real] / total
        n[at[real]] += dn[real] / total
        state.destroy()
        del changes, table
        release(spark)
    return z, n


def _base(docs: DataFrame) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 == 1
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(held, F.lit(False)).alias("held_out"),
    )


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and values of the weights that are not zero, and the constant.

    Learnt from rows that have a label and are not held out, about ``sample_rows`` of them where there are more. An id
    labelled more than once is toxic if one label says so. With no such rows all scores are one half.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.where("doc_id IS NOT NULL AND label IS NOT NULL").where(
        F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    )
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = min(1.0, sample_rows / max(1, known.count()))
    sample = known.withColumn("place", place).where(F.col("place") < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                raw = [x.as_py() for x in part.column("text").cast(pa.binary())]
                found = pa.array(_distinct(*features(raw), len(raw)), pa.list_(pa.int32()))
                keep = [part.column(c) for c in ("doc_id", "place", "label")]
                yield pa.RecordBatch.from_arrays([*keep, found], ["doc_id", "place", "label", "features"])

    # The sample's bound is what allows the broadcast.
    chosen = _base(docs).where("NOT held_out").select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = chosen.mapInArrow(lean(run), "doc_id long, place long, label int, features array<int>")
    rows = rows.withColumn("part", (F.col("place") % PARTS).cast("int"))
    rows = scratch.save(rows.repartitionById(PARTS, "part"), "features")
    release(docs.sparkSession)
    z, n = _train(rows)
    scratch.drop("features")
    w = weights(z, n)
    at = np.flatnonzero(w[:DIMENSIONS])
    return at, w[at], float(-z[BIAS] / ((BETA + np.sqrt(n[BIAS])) / ALPHA))


def _scores(raw: list[bytes], dense: np.ndarray, constant: float) -> np.ndarray:
    """Scores of some texts: each feature that has a weight counts once per text."""
    places, owners = features(raw)
    hit = np.flatnonzero(dense[places])
    codes = np.unique(owners[hit].astype(np.int64) * DIMENSIONS + places[hit])
    sums = np.bincount(codes // DIMENSIONS, weights=dense[codes % DIMENSIONS], minlength=len(raw))
    return 1 / (1 + np.exp(-np.clip(sums + constant, -700, 700)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``; the score sees the text alone.

    A null text is empty and gets the score of the constant. Repeated rows come out as often as they went in.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, constant = shared.value
        dense = np.zeros(DIMENSIONS)
        dense[at] = values
        for batch in batches:
            for part in text_chunks(batch, "text"):
                scores = _scores([x.as_py() for x in part.column("text").cast(pa.binary())], dense, constant)
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array((scores >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return _base(docs).mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labelled rows that are not held out and scores every row of ``docs``.

    An empty table gives no rows; see ``learn`` and ``score`` for the other awkward cases.
    """
    return score(docs, learn(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all columns; the model is that of ``assess``.

    Rows pass through the tasks as Arrow slices of a megabyte of text, and those that stay go out untouched.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, constant = model.value
        dense = np.zeros(DIMENSIONS)
        dense[at] = values
        for batch in batches:
            place = batch.schema.get_field_index("text")
            for part in text_chunks(batch, "text"):
                raw = [x.as_py() or b"" for x in part.column(place).cast(pa.binary())]
                yield part.filter(pa.array(_scores(raw, dense, constant) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)
