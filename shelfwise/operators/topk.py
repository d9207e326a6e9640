"""Exact top-k by inner product between two tables of vectors, block against block."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.operators import scoring
from shelfwise.operators.scoring import MISSING, TILE, RunningTopK
from shelfwise.session import lookup_join, materialize, parallelism

# Task functions travel with their code, so executors need numpy and pyarrow but not this package.
for _module in (scoring, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

# Bounds of one cell: a slice of the queries, taken block by block past a run of candidates that stays in memory.
_MAX_QUERIES = 32_768
_MIN_QUERIES = 256
_MAX_STATE_BYTES = 64 << 20
_MAX_CELL_BYTES = 192 << 20
_MIN_CELL_PAIRS = 1 << 20
# A task of more pairs is cut, so that a lost executor costs minutes; only beyond it do slices follow the queries.
_MAX_CELL_PAIRS = 1 << 40
_CELLS_PER_CORE = 3
# A starting cluster that still reports few cores is planned for as many as this.
_LEAST_CORES = 12
_PARTITION_BYTES = 128 << 20
# Vectors that travel in one row.
_PACK_ROWS = 1024
_PACK_BYTES = 1 << 20
# Tasks whose best rows one task merges; of more tasks, groups are merged first.
_MERGED_AT_ONCE = 64
# Candidates scored at a time within a cell.
_BLOCK = 4 * TILE

_GRID = ["slices", "blocks", "v_blocks", "subs"]
_RESULT = "qid bigint, qlabel bigint, cid bigint, clabel bigint, score double, rank int"
# Kinds of rows. A task needs all candidates first, by sub-block, then every block of queries: the queries, before
# all sub-blocks, and their hidden pairs by sub-block.
_QUERY, _CANDIDATE, _HIDDEN = 0, 1, 2
_KINDS = 3
_PAYLOAD = ["step", "owner", "ids", "labels", "vectors"]
_BEFORE_ALL = -1
_BLOCK_BITS = 24  # places of a step below its query block


def block_top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    hidden: DataFrame | None = None,
    keep_hidden: bool = False,
    skip_self: bool = False,
    shape: tuple[int, int, int] | None = None,
) -> DataFrame:
    """The ``k`` candidates with the largest inner product for every query.

    ``queries`` and ``candidates`` hold ``(id, label, vector)`` and optionally group columns ``g1, g2``;
    then a query meets only candidates of its own group. ``label`` is carried along. ``hidden`` holds
    ``(qid, cid)`` pairs to leave out, or with ``keep_hidden`` to rank last by id; it cannot be combined
    with groups. ``skip_self`` leaves out the candidate with the query's own id. Order: score
    descending, rows without a vector last, then candidate id. Ids must be unique. ``shape`` is the
    number of queries, of candidates and of vector elements, if known; it only decides the blocks.

    Candidates are packed, written once and hashed into runs that fit a task's memory, queries into slices. A cell is one
    slice against one run: its task reads the run and streams the slice past it in blocks, keeping k rows per query of
    a block, so no pair is ever written out and memory is bounded by run and block, whatever the size of a group. A run
    is read once per slice and a query sent once per run; the number of slices follows the cores, not the queries and
    not the shuffle partitions, which are set by the input's size, until a cell would hold ``_MAX_CELL_PAIRS``. Large
    groups are cut into many cells by their work.

    Result: ``(qid, qlabel, cid, clabel, score, rank)``; ``score`` is NULL where a vector is missing.
    """
    grouped = "g1" in candidates.columns
    if grouped and hidden is not None:
        raise ValueError("hidden pairs cannot be combined with groups")
    spark = queries.sparkSession
    if grouped:
        dim = _dimension(candidates)
    else:
        nq, nv, dim = shape or (queries.count(), candidates.count(), _dimension(candidates))
    queries, candidates = (_normalise(df, grouped) for df in (queries, candidates))
    if grouped:
        groups, totals = _plan_groups(queries, candidates, dim, k)
        if not totals["n_groups"]:
            return spark.createDataFrame([], _RESULT)
        by_group = [*_GRID, "g1", "g2"]
        q = lookup_join(queries, groups.select(*by_group, "nq"), ["g1", "g2"], "nq", totals["n_groups"], totals["nq"])
        c = lookup_join(candidates, groups.select(*by_group, "nv"), ["g1", "g2"], "nv", totals["n_groups"], totals["nv"])
        n_parts = min(_CELLS_PER_CORE * parallelism(spark), totals["cells"])
        n_parts = max(n_parts, math.ceil(totals["bytes"] / _PARTITION_BYTES))
        n_runs = totals["v_blocks"]
        q, c = q.withColumns(_query_slot()), c.withColumns(_candidate_slot("id")).withColumn("sub", F.lit(0))
    else:
        if not nq or not nv:
            return spark.createDataFrame([], _RESULT)
        limits = _Limits.of(spark, nq * nv, dim, k)
        grid = dict(zip(_GRID, limits.grid(nq, nv, math.ceil, max, min)))
        grid_columns = {name: F.lit(n) for name, n in grid.items()}
        q, c = queries.withColumns(grid_columns), candidates.withColumns(grid_columns)
        q, c = q.withColumns(_query_slot()), c.withColumns(_candidate_slot("id"))
        n_parts = grid["slices"] * grid["v_blocks"]
        n_runs = grid["v_blocks"]

    keys = ["g1", "g2", "cell"] if grouped else ["cell"]
    if grouped:
        q, c = (_singles(df) for df in (q, c))
        if totals["slices"] > 1:
            # Spread the rows of cut groups before they are copied to their slices.
            c = c.repartition(n_parts, "id")
    else:
        q_slots = grid["slices"] * grid["blocks"]
        q = _packs(q, ["slice", "block"], max(nq // q_slots, 1), q_slots, dim)
        c = _packs(c, ["vb", "sub"], _BLOCK, grid["v_blocks"] * grid["subs"], dim)
        if grid["slices"] > 1:
            c = materialize(c, "candidate-packs")
        q, c = (df.withColumns(grid_columns).withColumns(_payload(F.col("rows"))) for df in (q, c))
    every_slice = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    every_run = F.explode(F.sequence(F.lit(0), F.col("v_blocks") - 1))
    placed = [
        q.withColumns({"vb": every_run, "sub": F.lit(_BEFORE_ALL), "kind": F.lit(_QUERY)}),
        c.withColumns({"slice": every_slice, "block": F.lit(_BEFORE_ALL), "kind": F.lit(_CANDIDATE)}),
    ]
    if hidden is not None:
        placed.append(_hidden_sets(hidden, grid_columns).withColumn("kind", F.lit(_HIDDEN)))

    cell = F.col("slice") * F.col("v_blocks") + F.col("vb")
    part = F.pmod(F.xxhash64("g1", "g2") + cell, F.lit(n_parts)) if grouped else cell
    step = F.shiftleft(F.col("block").cast("bigint") + 1, _BLOCK_BITS) + (F.col("sub") + 1) * _KINDS + F.col("kind")
    names = {"part": part.cast("int"), "cell": cell.cast("bigint"), "step": step}
    columns = [*keys, *_PAYLOAD]
    placed = [df.withColumns(names).select("part", *columns) for df in placed]
    # Without groups a partition is one cell, and a single long is all there is to sort by.
    order = [*keys, "step"] if grouped else ["step"]
    rows = reduce(DataFrame.unionByName, placed).repartitionById(n_parts, "part").sortWithinPartitions(*order)
    found = rows.select(*columns).mapInArrow(_score_cells(k, hidden is not None, keep_hidden, skip_self), _RESULT)
    return found if n_runs == 1 else _best_of_runs(found, k)


def _best_of_runs(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("qid").orderBy(F.col("score").desc_nulls_last(), "cid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _normalise(df: DataFrame, grouped: bool) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    g1, g2 = (F.col("g1").cast("bigint"), F.col("g2").cast("bigint")) if grouped else (zero, zero)
    out = df.select(
        g1.alias("g1"),
        g2.alias("g2"),
        F.col("id").cast("bigint").alias("id"),
        F.col("label").cast("bigint").alias("label"),
        F.col("vector").cast("array<float>").alias("vector"),
    )
    return out.dropna(subset=["g1", "g2"]) if grouped else out


def _dimension(vectors: DataFrame) -> int:
    first = vectors.where(F.col("vector").isNotNull()).select(F.size("vector").alias("d")).first()
    return first["d"] if first else 1


def _cores(spark: SparkSession) -> int:
    """Cores that cells are cut for. Candidates are copied for them, so shuffle partitions count up to a bound only."""
    return max(spark.sparkContext.defaultParallelism, min(parallelism(spark), _LEAST_CORES))


@dataclass(frozen=True)
class _Limits:
    """Largest query block, longest candidate run and intended pairs of a cell."""

    queries: int
    run: int
    pairs: float

    @classmethod
    def of(cls, spark: SparkSession, total_pairs: float, dim: int, k: int) -> _Limits:
        return cls(
            max(1, min(_MAX_QUERIES, _MAX_STATE_BYTES // (24 * k + 8 * dim))),
            max(_BLOCK, _MAX_CELL_BYTES // (4 * dim + 32)),
            max(total_pairs / (_CELLS_PER_CORE * _cores(spark)), _MIN_CELL_PAIRS),
        )

    def grid(self, nq, nv, ceil, largest, smallest):
        """``(slices, query blocks per slice, candidate runs, sub-blocks per run)`` of a group, on numbers or columns."""
        slices = smallest(ceil(nq * nv / self.pairs), ceil(nq / _MIN_QUERIES))
        by_work = smallest(ceil(nq * nv / slices / self.pairs), ceil(nv / _BLOCK))
        v_blocks = largest(ceil(nv / self.run), by_work)
        slices = largest(slices, ceil(nq * nv / v_blocks / _MAX_CELL_PAIRS))
        return slices, ceil(nq / slices / self.queries), v_blocks, ceil(nv / v_blocks / _BLOCK)


def _plan_groups(queries: DataFrame, candidates: DataFrame, dim: int, k: int) -> tuple[DataFrame, Row]:
    """Blocks of every group, from its two counts alone, and their totals."""
    nq = queries.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("nq"))
    nv = candidates.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("nv"))
    counts = materialize(nq.join(nv, ["g1", "g2"]), "groups")
    nq, nv = F.col("nq").cast("double"), F.col("nv").cast("double")
    pairs = counts.agg(F.sum(nq * nv)).first()[0] or 0.0
    limits = _Limits.of(queries.sparkSession, pairs, dim, k)
    grid = limits.grid(nq, nv, F.ceil, F.greatest, F.least)
    groups = counts.withColumns({name: n.cast("int") for name, n in zip(_GRID, grid)})
    copies = F.col("nq") * F.col("v_blocks") + F.col("nv") * F.col("slices")
    totals = groups.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("nq").alias("nq"),
        F.sum("nv").alias("nv"),
        F.sum(F.col("slices") * F.col("v_blocks")).alias("cells"),
        F.max("slices").alias("slices"),
        F.max("v_blocks").alias("v_blocks"),
        F.sum(copies * (4 * dim + 64)).alias("bytes"),
    )
    return groups, totals.first()


def _block(key: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks).cast("int")


def _query_slot() -> dict[str, Column]:
    """Slice of a query and its block within the slice."""
    slot = _block("id", F.col("slices") * F.col("blocks"))
    return {"slice": F.pmod(slot, F.col("slices")), "block": F.floor(slot / F.col("slices")).cast("int")}


def _candidate_slot(key: str) -> dict[str, Column]:
    """Candidate run and the sub-block within it, where hidden pairs must meet their candidates."""
    slot = _block(key, F.col("v_blocks") * F.col("subs"))
    return {"vb": F.floor(slot / F.col("subs")).cast("int"), "sub": F.pmod(slot, F.col("subs"))}


def _payload(rows: Column) -> dict[str, Column]:
    """Columns a task reads: ``owner`` is the query of a hidden set, the arrays are parallel."""
    return {
        "owner": F.lit(0).cast("bigint"),
        "ids": rows.getField("id"),
        "labels": rows.getField("label"),
        "vectors": rows.getField("vector"),
    }


def _singles(df: DataFrame) -> DataFrame:
    return df.withColumns(_payload(F.array(F.struct("id", "label", "vector"))))


def _packs(df: DataFrame, slot: list[str], slot_rows: int, slots: int, dim: int) -> DataFrame:
    """Rows of a slot gathered into packs of bounded size, which are cheap to copy to many cells.

    The number of partitions is set by hand: packs are small, but each is copied many times later.
    """
    pack_rows = max(1, min(_PACK_ROWS, _PACK_BYTES // (4 * dim + 16)))
    per_slot = math.ceil(slot_rows / pack_rows)
    pack = F.pmod(F.xxhash64("id", F.lit("pack")), F.lit(per_slot))
    n_parts = min(slots * per_slot, parallelism(df.sparkSession))
    packed = df.withColumn("pack", pack).repartition(n_parts, *slot, "pack").groupBy(*slot, "pack")
    return packed.agg(F.collect_list(F.struct("id", "label", "vector")).alias("rows"))


def _hidden_sets(hidden: DataFrame, grid: dict[str, Column]) -> DataFrame:
    """Hidden candidates per query and sub-block: each set is distinct and no larger than a sub-block."""
    pairs = hidden.select(F.col("qid").cast("bigint").alias("id"), F.col("cid").cast("bigint").alias("cid"))
    pairs = pairs.withColumns(grid).withColumns(_candidate_slot("cid"))
    sets = pairs.groupBy("id", "vb", "sub").agg(F.collect_set("cid").alias("ids")).withColumns(grid)
    return sets.withColumns(
        {
            **_query_slot(),
            "owner": F.col("id"),
            "labels": F.lit(None).cast("array<bigint>"),
            "vectors": F.lit(None).cast("array<array<float>>"),
        }
    )


def _score_cells(k: int, has_hidden: bool, keep_hidden: bool, skip_self: bool):
    """Task function over rows sorted by cell, then candidates, then query blocks with their hidden pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = scorer = None
        for key, block, kind, sub, ids, labels, vectors in _runs(batches):
            if key != cell:
                if scorer is not None:
                    yield from scorer.finish()
                cell, scorer = key, _CellScorer(k, has_hidden, keep_hidden, skip_self)
            if block != scorer.block:
                yield from scorer.finish()
                scorer.block = block
            scorer.add(kind, sub, ids, labels, vectors)
        if scorer is not None:
            yield from scorer.finish()

    return run


def _runs(batches: Iterator[pa.RecordBatch]):
    """Cut Arrow batches where the cell or the step changes, and unfold the packed arrays of each run."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n_keys = batch.num_columns - len(_PAYLOAD) + 1
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
            *cell, step = (int(x) for x in keys[:, start])
            block, rest = divmod(step, 1 << _BLOCK_BITS)
            sub, kind = divmod(rest, _KINDS)
            at = block - 1, kind, sub - 1
            owner, ids, labels, vectors = (batch.column(n_keys + i).slice(start, stop - start) for i in range(4))
            unfolded = ids.flatten().to_numpy(zero_copy_only=False)
            if kind == _HIDDEN:
                sizes = ids.value_lengths().to_numpy(zero_copy_only=False)
                yield cell, *at, np.repeat(owner.to_numpy(zero_copy_only=False), sizes), unfolded, None
            else:
                yield cell, *at, unfolded, labels.flatten().to_numpy(zero_copy_only=False), vectors.flatten()


class _CellScorer:
    """Keeps the candidates of one cell, then scores its queries block by block against them."""

    def __init__(self, k: int, has_hidden: bool, keep_hidden: bool, skip_self: bool):
        self.k, self.has_hidden, self.keep_hidden, self.skip_self = k, has_hidden, keep_hidden, skip_self
        self.kept, self.pieces, self.piece_sub, self.held = [], [], None, 0
        self.block = _BEFORE_ALL
        self._clear()

    def _clear(self):
        self.queries, self.pairs, self.sub, self.next, self.top = [], [], None, 0, None

    def add(self, kind, sub, ids, labels, vectors):
        if kind == _CANDIDATE:
            full = self.held >= _BLOCK and not self.has_hidden
            if self.pieces and (sub != self.piece_sub or full):
                self._keep()
            self.pieces.append((ids, labels, vectors))
            self.piece_sub = sub
            self.held += len(ids)
        elif kind == _QUERY:
            self.queries.append((ids, labels, vectors))
        else:
            if sub != self.sub:
                self._push_before(sub)
                self.sub = sub
            self.pairs.append((ids, labels))

    def _keep(self):
        if self.pieces:
            self.kept.append((self.piece_sub, *_stack(self.pieces)))
            self.pieces, self.held = [], 0

    def _push_before(self, sub):
        """Offer the candidates of all sub-blocks before ``sub``, with the pairs gathered for their own one."""
        self._keep()
        if self.queries and self.kept and self.top is None:
            qid, qlabel, q, q_missing = _stack(self.queries)
            by_id = np.argsort(qid, kind="stable")
            self.qid, self.qlabel = qid[by_id], qlabel[by_id]
            self.top = RunningTopK(q[by_id], q_missing[by_id], self.k)
        while self.top is not None and self.next < len(self.kept) and (sub is None or self.kept[self.next][0] < sub):
            its_sub, cid, label, v, missing = self.kept[self.next]
            v = _fit(v, missing, self.top.q.shape[1])
            hidden = self._hidden(cid, its_sub)
            self.top.push(cid, label, v, missing, *hidden, self.keep_hidden)
            self.next += 1
        self.pairs = []

    def _hidden(self, cid, sub):
        if self.skip_self:
            own = np.flatnonzero(np.isin(self.qid, cid))
            return own, self.qid[own]
        if not self.pairs or sub != self.sub:
            return None, None
        qid = np.concatenate([p[0] for p in self.pairs])
        hidden = np.concatenate([p[1] for p in self.pairs])
        at = np.searchsorted(self.qid, qid)
        known = at < len(self.qid)
        known[known] = self.qid[at[known]] == qid[known]
        return at[known], hidden[known]

    def finish(self) -> Iterator[pa.RecordBatch]:
        """The results of the block of queries gathered last."""
        self._push_before(None)
        if self.top is not None:
            yield _result_batch(self.top, self.qid, self.qlabel)
        self._clear()


def _result_batch(top: RunningTopK, qid, qlabel) -> pa.RecordBatch:
    row, cid, clabel, score, rank = top.results()
    columns = {
        "qid": pa.array(qid[row], pa.int64()),
        "qlabel": pa.array(qlabel[row], pa.int64()),
        "cid": pa.array(cid, pa.int64()),
        "clabel": pa.array(clabel, pa.int64()),
        "score": pa.array(score, pa.float64(), mask=score == MISSING),
        "rank": pa.array(rank, pa.int32()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _stack(pieces):
    """Join pieces of ``(ids, labels, vectors)``; a missing vector becomes a zero row that is marked."""
    vectors = pa.concat_arrays([p[2] for p in pieces])
    missing = vectors.is_null().to_numpy(zero_copy_only=False)
    lengths = vectors.value_lengths().drop_null().to_numpy(zero_copy_only=False)
    dim = int(lengths[0]) if len(lengths) else 0
    if len(lengths) and (lengths != dim).any():
        raise ValueError(f"vectors differ in length: {sorted(set(lengths.tolist()))}")
    flat = vectors.flatten()
    if flat.null_count:
        raise ValueError("a vector has a NULL element")
    flat = flat.to_numpy(zero_copy_only=False)
    if not np.isfinite(flat).all():
        raise ValueError("a vector has an element that is NaN or infinite")
    matrix = np.zeros((len(vectors), dim), dtype=np.float32)
    matrix[~missing] = flat.reshape(-1, dim) if dim else np.zeros((int((~missing).sum()), 0), dtype=np.float32)
    ids = np.concatenate([p[0] for p in pieces])
    labels = np.concatenate([p[1] for p in pieces])
    return ids, labels, matrix, missing


def _fit(v, missing, dim):
    """``v`` in ``dim`` columns: a block without any vector takes any width, and so do queries without one."""
    if v.shape[1] == dim:
        return v
    if missing.all():
        return np.zeros((len(v), dim), dtype=np.float32)
    if dim == 0:
        return v[:, :0]
    raise ValueError(f"vectors differ in length: {sorted((dim, v.shape[1]))}")


def nearest_to(candidates: DataFrame, query: list[float] | None, k: int) -> DataFrame:
    """The ``k`` candidates ``(id, vector)`` nearest to one vector, as ``(id, distance)``.

    The table is scanned in place and every task keeps its own best k. Those of very many tasks are merged in as many
    groups as the tasks' number has roots, then in one.
    """
    matrix = np.asarray([query if query is not None else []], dtype=np.float32)
    if not np.isfinite(matrix).all():
        raise ValueError("the query vector has an element that is NaN or infinite")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = RunningTopK(matrix, np.array([query is None]), k)
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                cid, label, v, missing = _stack([(ids, ids, batch.column(1))])
                top.push(cid, label, _fit(v, missing, matrix.shape[1]), missing)
        _, cid, _, score, _ = top.results()
        distance = pa.array(0.0 - score, pa.float64(), mask=score == MISSING)
        yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), distance], names=["id", "distance"])

    scan = candidates.select(
        F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<float>").alias("vector")
    )
    best = scan.mapInArrow(run, "id bigint, distance double")
    tasks = scan.rdd.getNumPartitions()
    if tasks > _MERGED_AT_ONCE:
        # Each group keeps its best k where it is, before the last merge.
        groups = math.isqrt(tasks)
        best = best.withColumn("group", F.spark_partition_id() % groups).repartition(groups, "group").drop("group")
    return best.orderBy(F.col("distance").asc_nulls_last(), "id").limit(k)
