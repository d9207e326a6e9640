"""Approximate nearest neighbours by inner product: a neighbour graph from NN-descent, searched greedily.

Equal vectors are one node of the graph, with their smallest ids. Nodes are dealt to shards by the hash of their vector;
a shard has a bounded number of nodes and a graph of its own, so its vectors fit in a task, and shards are built and
searched side by side. For the graph, vectors get a coordinate that makes all lengths equal: then the nearest by angle
are also the nearest by inner product, and a search for any query may follow the same edges.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import Scratch, release

SHARD_ROWS = 8192
QUERY_BLOCK = 1024
DEGREE = 32  # neighbours that a node keeps
SAMPLE = 14  # neighbours in either direction through which candidates are exchanged in a round
ROUNDS = 5
BEAM = 128
ENTRIES = 32
TOP = 20
SEED = 5


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, vec`` of the rows with an id and a vector that is not empty, null, zero or partly null or non-finite."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    taken = df.where(F.col(id_col).isNotNull() & v.isNotNull()).where(finite & F.exists(v, lambda x: x != 0))
    vec = F.transform(v, lambda x: x.cast("double") + F.lit(0.0))  # no negative zero
    return taken.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))


def _nodes(vectors: DataFrame, top: int) -> DataFrame:
    """One row per different vector: ``vec, ids``; of a vector's ids only the ``top + 1`` smallest can be an answer."""
    smallest = Window.partitionBy("vec").orderBy("vec_id")
    kept = vectors.withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= top + 1)
    return kept.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.ChunkedArray, dim: int, kind: type = np.float32) -> np.ndarray:
    """Vectors as rows: in single precision for the graph and the search, in double for the scores that come out."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel(), kind))


def _level(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one more coordinate, so that all have the length of the longest."""
    rest = np.maximum(longest**2 - np.einsum("ij,ij->i", x, x, dtype=np.float64), 0)
    return np.column_stack([x, np.sqrt(rest)]).astype(np.float32)


def _best(owner, other, sim, fresh, n: int, k: int):
    """The ``k`` most similar others of every owner, each once: ids (-1 where there are fewer), similarities, freshness."""
    order = np.lexsort((fresh, other, -sim, owner))  # of equal pairs the old entry stands first
    owner, other, sim, fresh = owner[order], other[order], sim[order], fresh[order]
    new = np.ones(owner.size, bool)
    new[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, other, sim, fresh = owner[new], other[new], sim[new], fresh[new]
    place = np.arange(owner.size) - np.searchsorted(owner, owner)
    top = place < k
    ids, sims, marks = np.full((n, k), -1, np.int32), np.full((n, k), -np.inf, np.float32), np.zeros((n, k), bool)
    at = owner[top], place[top]
    ids[at], sims[at], marks[at] = other[top], sim[top], fresh[top]
    return ids, sims, marks


def _similar(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(a.size, np.float32)
    for i in range(0, a.size, 1 << 17):
        out[i : i + (1 << 17)] = np.einsum("ij,ij->i", x[a[i : i + (1 << 17)]], x[b[i : i + (1 << 17)]])
    return out


NODE_SCHEMA = "shard long, node int, dim int, vec array<double>, ids array<long>, near array<int>, sims array<float>, fresh array<boolean>"
NODE_COLUMNS = ["shard", "node", "dim", "vec", "ids", "near", "sims", "fresh"]


def _node_table(table: pa.Table, node: np.ndarray, lists) -> pa.Table:
    ids, sims, fresh = lists
    return pa.table([
        table["shard"], pa.array(node.astype(np.int32)), table["dim"], table["vec"], table["ids"],
        _lists(ids, pa.int32()), _lists(sims, pa.float32()), _lists(fresh, pa.bool_()),
    ], NODE_COLUMNS)


def _start(longest: float, degree: int):
    """First lists of a shard: neighbours in a few random orders, by projection, of the shard's nodes."""

    def run(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        x = _level(_matrix(table["vec"], dim), longest)
        n, rng = len(x), np.random.default_rng(SEED)
        owners, others = [], []
        for _ in range(2):
            order = np.argsort(x @ rng.standard_normal(x.shape[1]).astype(np.float32), kind="stable")
            for step in range(1, min(degree // 2, n - 1) + 1):
                owners += [order, np.roll(order, -step)]
                others += [np.roll(order, -step), order]
        owner = np.concatenate(owners) if owners else np.zeros(0, int)
        other = np.concatenate(others) if others else np.zeros(0, int)
        lists = _best(owner, other, _similar(x, owner, other), np.ones(owner.size, bool), n, degree)
        return _node_table(table, np.arange(n), lists)

    return run


def _exchange(nodes: DataFrame, sample: int) -> DataFrame:
    """Neighbours of neighbours: ``to_shard, node, candidates``, a join of the sampled graph with itself.

    Each node passes its neighbours, in either direction, to each of them. At most ``sample`` in a direction take part, in
    an order by hash with the fresh ones first; through a neighbour that is not fresh only fresh ones are passed.
    """
    edge = F.explode(F.arrays_zip("near", "fresh")).alias("e")
    out = nodes.select("shard", "node", edge).select(
        "shard", F.col("node").alias("a"), F.col("e.near").alias("b"), F.col("e.fresh").alias("fresh")
    ).where("b >= 0")
    either = out.select("shard", "a", "b", "fresh", F.lit(0).alias("way")).union(
        out.select("shard", F.col("b").alias("a"), F.col("a").alias("b"), "fresh", F.lit(1).alias("way"))
    )
    turn = Window.partitionBy("shard", "a", "way").orderBy(F.col("fresh").desc(), F.xxhash64("a", "b", "way"), "b")
    chosen = either.withColumn("nth", F.row_number().over(turn)).where(F.col("nth") <= sample)
    middle = chosen.groupBy("shard", "a").agg(
        F.collect_set("b").alias("all"), F.collect_set(F.when(F.col("fresh"), F.col("b"))).alias("new")
    )
    passed = chosen.select("shard", "a", F.col("b").alias("node"), "fresh").join(middle, ["shard", "a"])
    candidates = F.when(F.col("fresh"), F.col("all")).otherwise(F.col("new"))
    passed = passed.select(F.col("shard").alias("to_shard"), "node", candidates.alias("candidates"))
    return passed.where(F.size("candidates") > 0)


def _improve(longest: float, degree: int):
    """Lists of a shard after the candidates that came by exchange."""

    def run(key, table: pa.Table, passed: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        n, dim = table.num_rows, table["dim"][0].as_py()
        x = _level(_matrix(table["vec"], dim), longest)
        ids = table["near"].combine_chunks().flatten().to_numpy().reshape(n, degree)
        sims = table["sims"].combine_chunks().flatten().to_numpy().reshape(n, degree)
        have = ids >= 0
        owner, other, sim = np.nonzero(have)[0], ids[have], sims[have]
        fresh = np.zeros(owner.size, bool)
        if passed.num_rows:
            lists = passed["candidates"].combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            a = np.repeat(passed["node"].to_numpy().astype(np.int64), sizes)
            b = lists.flatten().to_numpy().astype(np.int64)
            codes = np.unique((a * n + b)[a != b])
            codes = np.setdiff1d(codes, owner.astype(np.int64) * n + other, assume_unique=True)
            a, b = codes // n, codes % n
            s = _similar(x, a, b)
            better = s > sims[a, -1]
            owner, other = np.concatenate([owner, a[better]]), np.concatenate([other, b[better]])
            sim, fresh = np.concatenate([sim, s[better]]), np.concatenate([fresh, np.ones(better.sum(), bool)])
        return _node_table(table, np.arange(n), _best(owner, other, sim, fresh, n, degree))

    return run


def build_graph(nodes: DataFrame, scratch: Scratch, rounds: int = ROUNDS, degree: int = DEGREE) -> DataFrame:
    """Neighbour lists of all nodes: rows of ``NODE_SCHEMA``, a written table.

    ``nodes`` has ``shard, dim, vec, ids``. Every round is a join of the graph with itself and a grouping by shard.
    """
    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = math.sqrt(nodes.agg(F.max(squares)).first()[0] or 0.0)
    graph = scratch.save(nodes.groupBy("shard").applyInArrow(_start(longest, degree), NODE_SCHEMA), "graph-0")
    for i in range(1, rounds + 1):
        passed = _exchange(graph, SAMPLE)
        better = graph.groupBy("shard").cogroup(passed.groupBy("to_shard")).applyInArrow(_improve(longest, degree), NODE_SCHEMA)
        graph = scratch.save(better, f"graph-{i}")
        scratch.drop(f"graph-{i - 1}")
        del passed, better
        release(nodes.sparkSession)
    return graph


def _edges(ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Neighbours in either direction, the nearest ``width`` of each node; -1 where there are fewer."""
    have = ids >= 0
    a, b, s = np.nonzero(have)[0], ids[have], sims[have]
    both = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
    return _best(*both, np.zeros(2 * a.size, bool), len(ids), width)[0]


def greedy_search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """The ``beam`` best nodes found for every query, best first; -1 where there are fewer nodes.

    From a few entries, or all nodes if they fit in the beam, each query follows the edges of its best node not yet
    followed, until all that its beam holds have been. The queries take their steps side by side.
    """
    m, n = len(queries), len(x)
    rng = np.random.default_rng(SEED)
    entries = np.arange(n) if n <= beam else rng.choice(n, ENTRIES, replace=False)
    seen = np.zeros((m, n + 1), bool)
    seen[:, entries] = True
    seen[:, n] = True  # stands for no neighbour
    ids, sims = np.full((m, beam), n), np.full((m, beam), -np.inf, np.float32)
    ids[:, : entries.size], sims[:, : entries.size] = entries, queries @ x[entries].T
    done = ids == n
    edges = np.where(edges < 0, n, edges)
    active = np.arange(m)
    while active.size:
        open_sims = np.where(done[active], -np.inf, sims[active])
        pick = open_sims.argmax(axis=1)
        going = np.isfinite(open_sims[np.arange(active.size), pick])
        active, pick = active[going], pick[going]
        if not active.size:
            break
        done[active, pick] = True
        near = edges[ids[active, pick]]
        new = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        row, column = np.nonzero(new)
        s = np.full(near.shape, -np.inf, np.float32)
        s[row, column] = np.einsum("ij,ij->i", queries[active[row]], x[near[row, column]])
        all_sims = np.concatenate([sims[active], s], axis=1)
        keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        rows = np.arange(active.size)[:, None]
        sims[active] = all_sims[rows, keep]
        ids[active] = np.concatenate([ids[active], near], axis=1)[rows, keep]
        done[active] = np.concatenate([done[active], ~new], axis=1)[rows, keep]
    order = np.argsort(-sims, axis=1, kind="stable")
    found = np.take_along_axis(ids, order, axis=1)
    return np.where(np.isfinite(np.take_along_axis(sims, order, axis=1)), found, -1)


FOUND_SCHEMA = "query_id long, query_vec long, vec_id long, score double"


def _search(top: int, degree: int, beam: int):
    def run(key, table: pa.Table, asked: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        if table.num_rows and asked.num_rows:
            table = table.sort_by("node")
            n, dim = table.num_rows, table["dim"][0].as_py()
            x, q = _matrix(table["vec"], dim), _matrix(asked["vec"], dim)
            near = table["near"].combine_chunks().flatten().to_numpy().reshape(n, degree)
            sims = table["sims"].combine_chunks().flatten().to_numpy().reshape(n, degree)
            found = greedy_search(x, _edges(near, sims, 2 * degree), q, beam)
            query, column = np.nonzero(found >= 0)
            node = found[query, column]
            exact, asked_exact = (_matrix(t["vec"], dim, np.float64) for t in (table, asked))
            score = np.einsum("ij,ij->i", asked_exact[query], exact[node])
            lists = table["ids"].combine_chunks()
            ends, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            sizes = (ends[1:] - ends[:-1])[node]
            at = np.repeat(ends[node], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            vec_id, query, score = flat[at], np.repeat(query, sizes), np.repeat(score, sizes)
            query_id = asked["query_id"].to_numpy()
            other = vec_id != query_id[query]
            vec_id, query, score = vec_id[other], query[other], score[other]
            order = np.lexsort((vec_id, -score, query))
            place = np.arange(order.size) - np.searchsorted(query[order], query[order])
            order = order[place < top]
            out = [query_id[query[order]], asked["query_vec"].to_numpy()[query[order]], vec_id[order], score[order]]
        return pa.table(out, ["query_id", "query_vec", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, top: int = TOP, shard_rows: int = SHARD_ROWS, rounds: int = ROUNDS,
    degree: int = DEGREE, beam: int = BEAM,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every query the ``top`` nearest rows found, by inner product in double.

    ``vectors`` and ``queries`` are ``vec_id, vec`` as ``usable`` gives them; vectors meet only queries of the same
    length. A query's own id is never its neighbour; ties go to the smaller id; rows that repeat a vector are neighbours
    each on their own, and rows that repeat an id and a vector are one query. Where there are fewer candidates than
    ``top``, all are returned. Empty tables give no rows.

    Every query goes to every shard of its length, in blocks: a shard's graph and a block of queries make a task.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    nodes = scratch.save(_nodes(vectors, top).withColumn("dim", F.size("vec")), "nodes")
    asked = scratch.save(
        queries.select(F.col("vec_id").alias("query_id"), "vec").distinct().withColumns(
            {"dim": F.size("vec"), "query_vec": F.xxhash64("vec")}
        ), "queries",
    )
    shards = max(1, -(-nodes.count() // shard_rows))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    shard = F.pmod(F.xxhash64("vec"), F.lit(shards)) + F.col("dim").cast("long") * shards
    graph = build_graph(nodes.withColumn("shard", shard), scratch, rounds, degree)
    left = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).drop("fresh")
    right = asked.select(
        "query_id", "query_vec", "vec", F.pmod(F.xxhash64("query_id", "query_vec"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("nth"), "dim",
    ).withColumn("shard", F.col("nth") + F.col("dim").cast("long") * shards)
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        _search(top, degree, beam), FOUND_SCHEMA
    )
    rank = F.row_number().over(Window.partitionBy("query_id", "query_vec").orderBy(F.col("score").desc(), "vec_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def self_search(df: DataFrame, every: int = 20, **settings) -> DataFrame:
    """``nearest`` with the rows whose ``vec_id`` is divisible by ``every`` as queries against all others."""
    vectors = usable(df)
    return nearest(vectors, vectors.where(F.col("vec_id") % every == 0), **settings)
