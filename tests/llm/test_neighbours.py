import math

import numpy as np
from helpers import clashing

from shelfwise.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, top):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % every == 0:
            s = np.einsum("j,ij->i", v, x)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:top]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(got, want):
    hits = sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


def as_lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_order_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 32)) * rng.uniform(0.3, 2, (1500, 1))
    x[200:700] = x[0]  # a third of all rows is one vector
    x[700:800] += x[1] * 5
    rows = [(i, x[i].astype(np.float32).tolist()) for i in range(len(x))]
    df = clashing(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), "node", "vec", "shard", "score")
    got = as_lists(neighbours.self_search(df, shard_rows=600))
    want = brute(rows, 20, 20)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
    by_id = dict(rows)
    for q, found in got.items():
        assert found == sorted(found, key=lambda f: (-f[1], f[0])) and len(found) == 20
        for v, s in found:
            assert math.isclose(s, float(np.dot(np.float64(by_id[q]), np.float64(by_id[v]))), rel_tol=1e-9, abs_tol=1e-9)
    assert [v for v, _ in got[0]] == list(range(200, 220))  # ties go to the smaller id, itself apart


def test_recall_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert recall(as_lists(neighbours.self_search(df, shard_rows=1024)), brute(rows, 20, 20)) >= 0.9


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, None), (40, [nan, 1.0]), (60, [inf, 1.0]), (80, [0.0, 0.0]), (2, [None, 1.0]),
            (None, [1.0, 1.0]), (3, [1.0, 0.0]), (100, [1.0, 2.0, 3.0]), (4, []), (0, [1.0, 0.0])]
    got = as_lists(neighbours.self_search(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)))
    assert got == {0: [(3, 1.0), (1, 0.5)]}
    assert neighbours.self_search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_double_vectors_are_scored_as_they_are(spark):
    rows = [(i, [0.1 * i + 0.01, 0.17, -0.3 * (i % 7)]) for i in range(41)]
    got = neighbours.self_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by_id = dict(rows)
    assert len(got) == 60
    for r in got:
        want = float(np.einsum("i,i", np.array(by_id[r.query_id]), np.array(by_id[r.vec_id])))
        assert abs(r.score - want) <= 4e-16 * max(1.0, abs(want))
