"""Embedding whitening: principal components by spectral divide-and-conquer on QDWH polar decompositions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import ship

COMPONENTS = 8
SCALE, OFFSET = 1024.0, 100_000
# A task and the driver hold a few squares of this many doubles a side; longer vectors are an error.
MOST_DIMENSIONS = 4096
EPS = float(np.finfo(float).eps)


# Spectral divide-and-conquer -----------------------------------------------------------------------------------------


def polar(a: np.ndarray, most: int = 12) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QR-based dynamically weighted Halley steps.

    For a symmetric matrix that factor is its sign: it has the eigenvectors of ``a`` with eigenvalues +1 and -1.
    """
    size = a.shape[0]
    norm = np.linalg.norm(a)
    if norm == 0:
        return np.zeros_like(a)
    x, eye, low = a / norm, np.eye(size), EPS
    for _ in range(most):
        d = (4 * (1 - low**2) / low**4) ** (1 / 3)
        wa = math.sqrt(1 + d) + 0.5 * math.sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * math.sqrt(1 + d)), 0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, eye]))
        new = wb / wc * x + (wa - wb / wc) / math.sqrt(wc) * (q[:size] @ q[size:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        if 1 - low < 10 * EPS and moved < EPS ** (1 / 3):
            break
    return x


def _shifts(a: np.ndarray, spread: float) -> Iterator[float]:
    """Places to cut a spectrum, the most even first; the mean lies inside it, the others get off an eigenvalue."""
    mean = float(np.trace(a)) / a.shape[0]
    yield float(np.median(np.diag(a)))
    yield mean
    for k in range(1, 20):
        for sign in (1, -1):
            yield mean + sign * k * 0.037 * spread / a.shape[0]


def _cut(a: np.ndarray, spread: float, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift, or None if no shift parts them."""
    size = a.shape[0]
    start = np.random.default_rng(size).standard_normal((size, size))
    for shift in _shifts(a, spread):
        sign = polar(a - shift * np.eye(size))
        if np.linalg.norm(sign @ sign - np.eye(size)) > 1e-7:
            continue  # the shift met an eigenvalue
        projector = (sign + np.eye(size)) / 2
        above = round(float(np.trace(projector)))
        if not 0 < above < size:
            continue
        basis = projector @ start[:, :above]
        for _ in range(3):
            q, _ = np.linalg.qr(basis, mode="complete")
            upper, lower = q[:, :above], q[:, above:]
            if np.linalg.norm(lower.T @ a @ upper) <= 8 * size * EPS * scale:
                break
            basis = projector @ upper
        return upper, lower
    return None


def components(a: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows.

    A spectral projector splits the space into the invariant subspaces above and below a shift, and both are split
    again; a subspace on which the matrix is a multiple of the identity, up to rounding, takes any basis. Subspaces
    below the wanted ones are left unsplit.
    """
    a = (a + a.T) / 2
    scale = float(np.linalg.norm(a))
    found: list[np.ndarray] = []

    def split(block: np.ndarray, basis: np.ndarray) -> None:
        size = block.shape[0]
        if len(found) >= want:
            return
        spread = float(np.linalg.norm(block - np.trace(block) / size * np.eye(size)))
        cut = None if size == 1 or spread <= 4 * size * EPS * scale else _cut(block, spread, scale)
        if cut is None:
            found.extend(basis.T)
            return
        for part in cut:
            inner = part.T @ block @ part
            split((inner + inner.T) / 2, basis @ part)

    if a.shape[0]:
        split(a, np.eye(a.shape[0]))
    vectors = np.array(found[: max(want, 0)]).reshape(-1, a.shape[0])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    values = np.einsum("ij,jk,ik->i", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[order]


# Moments by Spark ----------------------------------------------------------------------------------------------------


@dataclass
class Moments:
    """Rows, exact sums of whole numbers, and the sums of products around the mean."""

    n: int
    sums: np.ndarray  # long
    mean: np.ndarray
    products: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Moments:
        mean = rows.mean(axis=0)
        centred = rows - mean
        exact = rows.sum(axis=0) if rows.dtype == np.int64 else np.zeros(rows.shape[1], np.int64)
        return Moments(rows.shape[0], exact, mean, centred.T @ centred)

    def add(self, other: Moments) -> Moments:
        """Both together, each centred around its own mean; only the difference of the means is multiplied anew."""
        n = self.n + other.n
        step = other.mean - self.mean
        products = self.products + other.products + np.outer(step, step) * (self.n / n * other.n)
        return Moments(n, self.sums + other.sums, self.mean + step * (other.n / n), products)


MOMENTS = "length int, n long, sums array<bigint>, mean array<double>, products array<double>"


def _rows_of(found: dict[int, Moments]) -> Iterator[pa.RecordBatch]:
    for length, m in found.items():
        yield pa.RecordBatch.from_pydict(
            {"length": pa.array([length], pa.int32()), "n": pa.array([m.n], pa.int64()), "sums": [m.sums],
             "mean": [m.mean], "products": [m.products.ravel()]}
        )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, Moments] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda name: batch.column(name)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            mean, key = get("mean"), batch.column("length")[i].as_py()
            m = Moments(batch.column("n")[i].as_py(), get("sums"), mean, get("products").reshape(mean.size, -1))
            found[key] = found[key].add(m) if key in found else m
    yield from _rows_of(found)


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each ``length`` that occurs: it, the places of its rows, and these rows' ``column`` as one matrix."""
    lists, lengths = batch.column(column), batch.column("length").to_numpy()
    flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        starts = offsets[rows]
        yield int(length), rows, flat[starts[:, None] + np.arange(offsets[rows[0] + 1] - starts[0])]


def moments(vectors: DataFrame, column: str) -> dict[int, Moments]:
    """Moments of ``column`` for every ``length`` that occurs. One scan; each task keeps one square a length.

    The tasks' squares are merged in as many groups as their number has roots, then in one, so no task and not the
    driver sees more of them than that root.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for batch in batches:
            for length, _, rows in _matrices(batch, column):
                m = Moments.of(rows)
                found[length] = found[length].add(m) if length in found else m
        yield from _rows_of(found)

    parts = vectors.select("length", column).mapInArrow(partial, MOMENTS)
    groups = math.isqrt(max(1, vectors.rdd.getNumPartitions() - 1)) + 1
    dealt = parts.withColumn("group", F.spark_partition_id() % groups).repartition(groups, "group").drop("group")
    whole = dealt.mapInArrow(_merge, MOMENTS).repartition(1).mapInArrow(_merge, MOMENTS)
    return {
        r.length: Moments(r.n, np.array(r.sums, np.int64), np.array(r.mean), np.array(r.products).reshape(len(r.mean), -1))
        for r in whole.collect()
    }


# Whitening -----------------------------------------------------------------------------------------------------------


@dataclass
class Whitener:
    """What whitening needs of one length of vector: a few rows of that length, sent to every task."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(e); 0 for components without variance beyond rounding."""
        least = EPS * max(1, self.sums.size) * max(self.trace, 0.0)
        return np.where(self.values > least, 1 / np.sqrt(np.maximum(self.values, np.finfo(float).tiny)), 0.0)

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else np.zeros_like(self.values)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums / self.n) @ self.vectors.T * self.scales

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n * x - sum) ** 2``, exactly; None where a long cannot hold it."""
        far = float(np.abs(x).max(initial=0)) * self.n + float(np.abs(self.sums).max(initial=0))
        gap = self.n * x.astype(float) - self.sums
        if far < 2**62 and float((gap**2).sum(axis=1).max(initial=0)) < 2**62:
            return ((self.n * x - self.sums) ** 2).sum(axis=1).tolist()
        sums = self.sums.tolist()
        exact = [sum((self.n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
        return [e if e < 2**63 else None for e in exact]


def whole_vectors(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``vec_id, length, x``: the vectors without a null or non-finite entry, each entry as a whole number."""
    entry = F.col(vector)
    whole = entry.isNotNull() & F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = F.transform(entry, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("long") + F.lit(OFFSET).cast("long"))
    rows = embeddings.where(whole & (F.size(entry) > 0))
    return rows.select(F.col(key).cast("long").alias("vec_id"), F.size(entry).alias("length"), x.alias("x"))


def fit(vectors: DataFrame, most: int = COMPONENTS) -> dict[int, Whitener]:
    """A whitener for every length of vector, from all rows."""
    out = {}
    for length, m in moments(vectors, "x").items():
        if length > MOST_DIMENSIONS:
            raise ValueError(f"vectors of {length} entries; at most {MOST_DIMENSIONS} are supported")
        covariance = m.products / m.n
        values, axes = components(covariance, min(most, length))
        out[length] = Whitener(m.n, m.sums, axes, np.maximum(values, 0.0), float(np.trace(covariance)))
    return out


def whiten(vectors: DataFrame, whiteners: dict[int, Whitener]) -> DataFrame:
    """``vec_id, length, n, deviation, whitened array<double>, explained array<double>``, a row for every row."""
    sent = vectors.sparkSession.sparkContext.broadcast(whiteners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, rows, x in _matrices(batch, "x"):
                w = sent.value[length]
                columns = [
                    batch.column("vec_id").take(pa.array(rows)), pa.array([length] * rows.size, pa.int32()),
                    pa.array([w.n] * rows.size, pa.int64()), pa.array(w.deviations(x), pa.int64()),
                    _lists(w.whiten(x)), _lists(np.tile(w.explained, (rows.size, 1))),
                ]
                yield pa.RecordBatch.from_arrays(columns, WHITENED)

    types = "vec_id long, length int, n long, deviation long, whitened array<double>, explained array<double>"
    return vectors.mapInArrow(run, types)


WHITENED = ["vec_id", "length", "n", "deviation", "whitened", "explained"]


def _lists(matrix: np.ndarray) -> pa.ListArray:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(matrix.ravel(), pa.float64()))


def identity_error(made: DataFrame, whiteners: dict[int, Whitener]) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components with variance.

    Measured over all rows of ``whiten``; the largest error counts where vectors have several lengths.
    """
    worst = 0.0
    for length, m in moments(made, "whitened").items():
        live = np.flatnonzero(whiteners[length].scales > 0)
        covariance = (m.products / m.n)[np.ix_(live, live)]
        worst = max(worst, float(np.abs(covariance - np.eye(live.size)).max(initial=0.0)))
    return worst


def whitened_components(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row a vector and component.

    Rows whose vector is null or holds a null or non-finite entry are dropped; all others make up the fit. Repeated rows,
    and rows without ``vec_id``, count and come out as often as they went in. Vectors of several lengths are fitted and
    whitened each among those of their length, and ``n`` counts these. A vector without entries has no component and
    so no row. Equal eigenvalues share any basis of their space, the same for all rows. A component without variance
    (fewer rows than components, equal rows) is whitened to 0 and stays out of ``identity_error``. A ``deviation``
    beyond a long is null. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    ship(embeddings.sparkSession)
    vectors = whole_vectors(embeddings)
    whiteners = fit(vectors, most)
    made = whiten(vectors, whiteners)
    error = identity_error(made, whiteners)
    return made.select(
        "vec_id", "n", "deviation", "explained", F.posexplode("whitened").alias("at", "white"),
    ).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("white").alias("whitened"),
        F.get("explained", F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
