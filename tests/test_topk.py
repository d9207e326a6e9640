"""Blocked top-k on DataFrames against a full sort in numpy, with blocks small enough to cut everything."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise import session
from shelfwise.operators import topk
from shelfwise.operators.topk import block_top_k, nearest_to
from shelfwise.session import parallelism

from support import plan_of

GROUPED = "g1 int, g2 int, id bigint, label bigint, vector array<float>"
PLAIN = "id bigint, label bigint, vector array<float>"


@pytest.fixture(params=["whole", "cut"])
def cells(request, monkeypatch):
    if request.param == "cut":
        monkeypatch.setattr(topk, "_MAX_QUERIES", 9)
        monkeypatch.setattr(topk, "_MIN_QUERIES", 4)
        monkeypatch.setattr(topk, "_MIN_CELL_PAIRS", 50)
        monkeypatch.setattr(topk, "_BLOCK", 20)
        monkeypatch.setattr(topk, "_MAX_CELL_BYTES", 2000)
        monkeypatch.setattr(topk, "_PACK_ROWS", 6)
    return request.param


def vectors(seed, n, d=4, missing=0.1, copies=0.2):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d)).astype("f4")
    v[rng.random(n) < copies] = v[0]
    return [None if rng.random() < missing else x for x in v]


def score(a, b):
    return None if a is None or b is None else float((a.astype("f8") * b.astype("f8")).sum())


def ranked(candidates, q, k, skip=()):
    """``[(id, score)]`` of the best k of ``{id: vector}``, NULL scores last, ties by id."""
    scored = [(c, score(q, v)) for c, v in candidates.items() if c not in skip]
    scored.sort(key=lambda x: (x[1] is None, -(x[1] or 0.0), x[0]))
    return scored[:k]


def as_rows(table):
    return [(i, i * 10, None if v is None else v.tolist()) for i, v in table.items()]


def collected(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        assert r["qlabel"] == r["qid"] * 10 and r["clabel"] == r["cid"] * 10
        out.setdefault(r["qid"], []).append((r["cid"], r["score"], r["rank"]))
    return out


def same(got, want):
    assert [(c, n) for c, _, n in got] == [(c, i + 1) for i, (c, _) in enumerate(want)]
    for (_, a, _), (_, b) in zip(got, want):
        assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)


@pytest.mark.parametrize("k", [3, 500])
def test_plain(spark, cells, k):
    q, v = dict(enumerate(vectors(1, 40))), dict(enumerate(vectors(2, 130)))
    got = collected(block_top_k(spark.createDataFrame(as_rows(q), PLAIN), spark.createDataFrame(as_rows(v), PLAIN), k))
    assert set(got) == set(q)
    for i, x in q.items():
        same(got[i], ranked(v, x, k))


@pytest.mark.parametrize("keep", [False, True])
def test_hidden_pairs_with_a_hot_query(spark, cells, keep):
    """Query 0 hides most candidates, and every pair is listed several times."""
    q, v = dict(enumerate(vectors(3, 30, missing=0))), dict(enumerate(vectors(4, 90, missing=0)))
    rng = np.random.default_rng(0)
    hidden = {(0, c) for c in range(85)} | {(int(a), int(b)) for a, b in rng.integers(0, (30, 90), (200, 2))}
    hidden |= {(5, 4000), (4000, 5)}
    pairs = spark.createDataFrame(sorted(hidden) * 3, "qid bigint, cid bigint")
    got = collected(block_top_k(
        spark.createDataFrame(as_rows(q), PLAIN), spark.createDataFrame(as_rows(v), PLAIN), 12, hidden=pairs,
        keep_hidden=keep,
    ))
    for i, x in q.items():
        mine = {c for a, c in hidden if a == i}
        want = ranked(v, x, 12, skip=mine)
        if keep:
            want = (want + [(c, None) for c in sorted(mine) if c in v])[:12]
        same(got[i], want)


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_groups_with_one_holding_most_rows(spark, cells, monkeypatch, limit):
    monkeypatch.setattr(session, "BROADCAST_BYTES", limit)
    v = dict(enumerate(vectors(5, 160)))
    group = {i: (1, 1) if i % 3 else (i % 4, i % 5) for i in v}
    group[7] = (None, 1)
    table = [(*group[i], *row) for i, row in zip(v, as_rows(v))]
    df = spark.createDataFrame(table, GROUPED)
    got = collected(block_top_k(df, df, 9, skip_self=True))
    assert 7 not in got
    for i, x in v.items():
        if i != 7:
            own = {c: y for c, y in v.items() if group[c] == group[i]}
            want = ranked(own, x, 9, skip={i})
            same(got.get(i, []), want)


def test_empty_sides(spark):
    some = spark.createDataFrame(as_rows({1: np.ones(2, "f4")}), PLAIN)
    none = spark.createDataFrame([], PLAIN)
    for q, v in ((some, none), (none, some), (none, none)):
        assert block_top_k(q, v, 3).count() == 0
    grouped = some.select(F.lit(1).alias("g1"), F.lit(1).alias("g2"), "*")
    assert block_top_k(grouped, grouped.where("id < 0"), 3).count() == 0


@pytest.mark.parametrize("bad,message", [([1.0], "differ in length"), ([1.0, float("nan")], "NaN or infinite")])
def test_bad_vectors_are_an_error(spark, bad, message):
    q = spark.createDataFrame([(1, 1, [1.0, 2.0])], PLAIN)
    v = spark.createDataFrame([(1, 1, [1.0, 2.0]), (2, 2, bad)], PLAIN)
    with pytest.raises(Exception, match=message):
        block_top_k(q, v, 3).collect()
    with pytest.raises(Exception, match=message):
        nearest_to(v.select("id", "vector"), [1.0, 2.0], 3).collect()


@pytest.mark.parametrize("query", [[0.5, -1.0, 2.0, 0.25], None])
def test_nearest_to(spark, query):
    v = dict(enumerate(vectors(6, 200)))
    df = spark.createDataFrame(as_rows(v), PLAIN).select("id", "vector").repartition(7)
    got = [tuple(r) for r in nearest_to(df, query, 195).collect()]
    want = ranked(v, None if query is None else np.array(query, "f4"), 195)
    assert [c for c, _ in got] == [c for c, _ in want]
    assert [None if d is None else round(-d, 9) for _, d in got] == [None if s is None else round(s, 9) for _, s in want]


def test_plan_makes_no_pairs_and_one_partition_per_cell(spark, cells):
    q, v = dict(enumerate(vectors(1, 40))), dict(enumerate(vectors(2, 130)))
    plan = plan_of(block_top_k(spark.createDataFrame(as_rows(q), PLAIN), spark.createDataFrame(as_rows(v), PLAIN), 5))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if cells == "cut":
        assert "shufflepartitionidpassthrough" in plan


def test_slices_follow_the_cores_and_not_the_queries(spark):
    """A run of candidates is copied once per slice; a thousand times the queries add no copy and no partition."""
    grids = []
    for nq in (10**6, 10**7, 10**8):
        limits = topk._Limits.of(spark, nq * 10**5, 16, 100)
        grids.append(limits.grid(nq, 10**5, math.ceil, max, min))
    slices, blocks, runs, _ = zip(*grids)
    assert len(set(slices)) == 1 and set(runs) == {1}
    assert max(s * r for s, r in zip(slices, runs)) <= topk._CELLS_PER_CORE * parallelism(spark) + 1
    assert blocks[2] > 50 * blocks[0] // 2 and all(s * b * limits.queries >= 10**6 for s, b in zip(slices, blocks))
    # Beyond what a task should do in one piece, slices grow with the work, each a full cell.
    limits = topk._Limits.of(spark, 10**10 * 10**8, 16, 100)
    slices, _, runs, _ = limits.grid(10**10, 10**8, math.ceil, max, min)
    assert 10**18 / slices / runs > topk._MAX_CELL_PAIRS / 2


def test_copies_do_not_follow_the_shuffle_partitions(spark, monkeypatch):
    """Partitions are set by the input's size: slices that follow them copy the square of the input."""
    monkeypatch.setattr(topk, "_MIN_CELL_PAIRS", 100)
    v = spark.createDataFrame(as_rows(dict(enumerate(vectors(2, 300)))), PLAIN)
    q = spark.createDataFrame(as_rows(dict(enumerate(vectors(1, 30_000, d=2, missing=0.1)))), PLAIN)
    q = q.withColumn("vector", F.concat("vector", "vector"))
    cells, most = [], topk._CELLS_PER_CORE * max(spark.sparkContext.defaultParallelism, topk._LEAST_CORES)
    set_before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (12, 600):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            cells.append(block_top_k(q, v, 3).rdd.getNumPartitions())
            limits = topk._Limits.of(spark, 540_000 * 615_000, 64, 100)
            slices, _, runs, _ = limits.grid(540_000, 615_000, math.ceil, max, min)
            assert slices * runs <= most
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", set_before)
    assert max(cells) <= most


def test_partitions_do_not_grow_with_the_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "_MIN_CELL_PAIRS", 2000)
    monkeypatch.setattr(topk, "_MIN_QUERIES", 16)
    monkeypatch.setattr(topk, "_PACK_ROWS", 8)
    v = spark.createDataFrame(as_rows(dict(enumerate(vectors(2, 128)))), PLAIN)
    copied = []
    for block_size in (1000, 4):
        monkeypatch.setattr(topk, "_MAX_QUERIES", block_size)
        q = spark.createDataFrame(as_rows(dict(enumerate(vectors(1, 400)))), PLAIN)
        found = block_top_k(q, v, 3)
        assert found.count() == 1200
        copied.append(found.rdd.getNumPartitions())
    assert copied[0] == copied[1]


def test_one_query_over_many_tasks_merges_in_stages(spark, monkeypatch):
    monkeypatch.setattr(topk, "_MERGED_AT_ONCE", 4)
    v = dict(enumerate(vectors(6, 200)))
    df = spark.createDataFrame(as_rows(v), PLAIN).select("id", "vector").repartition(36)
    found = nearest_to(df, [0.5, -1.0, 2.0, 0.25], 50)
    assert "hashpartitioning(group" in plan_of(found) and ", 6)" in plan_of(found)
    want = ranked(v, np.array([0.5, -1.0, 2.0, 0.25], "f4"), 50)
    assert [r["id"] for r in found.collect()] == [c for c, _ in want]


def test_plan_of_one_query_scans_in_place(spark):
    df = spark.range(100).select("id", F.array(F.lit(1.0).cast("float")).alias("vector"))
    plan = plan_of(nearest_to(df, [1.0], 5))
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
