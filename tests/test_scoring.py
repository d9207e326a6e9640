"""The task-side scoring step against a full sort, on one process and without Spark."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwise.operators import scoring
from shelfwise.operators.scoring import MISSING, RunningTopK


def brute(q, q_missing, v, v_missing, ids, k, hidden=(), keep_hidden=False):
    out = []
    for i in range(len(q)):
        ranked = []
        for j in range(len(v)):
            score = MISSING if q_missing[i] or v_missing[j] else float(
                (q[i].astype(np.float64) * v[j].astype(np.float64)).sum())
            if (i, ids[j]) in hidden:
                if not keep_hidden:
                    continue
                score = MISSING
            ranked.append((-score, ids[j]))
        out.append([(c, -s) for s, c in sorted(ranked)[:k]])
    return out


def run(q, q_missing, v, v_missing, ids, k, hidden=(), keep_hidden=False, block=50):
    top = RunningTopK(q, q_missing, k)
    for s in range(0, len(ids), block):
        part = slice(s, s + block)
        pairs = [(r, c) for r, c in hidden if c in set(ids[part].tolist())] or None
        hide = (np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])) if pairs else (None, None)
        top.push(ids[part], ids[part], v[part], v_missing[part], *hide, keep_hidden)
    row, cid, label, score, rank = top.results()
    assert (label == cid).all()
    got = [[] for _ in q]
    for r, c, s, n in zip(row, cid, score, rank):
        assert n == len(got[r]) + 1
        got[r].append((int(c), float(s)))
    return got


def check(*args, **kwargs):
    got, want = run(*args, **kwargs), brute(*args, **{k: v for k, v in kwargs.items() if k != "block"})
    assert [[c for c, _ in row] for row in got] == [[c for c, _ in row] for row in want]
    for a, b in zip(got, want):
        np.testing.assert_allclose([s for _, s in a], [s for _, s in b], rtol=1e-12, atol=1e-12)


@pytest.fixture(params=["one tile", "many tiles"])
def tiles(request, monkeypatch):
    if request.param == "many tiles":
        monkeypatch.setattr(scoring, "TILE", 16)
        monkeypatch.setattr(scoring, "ROWS", 3)


def data(seed, nq=11, nv=300, d=5, missing=0.0, copies=0.0, integers=False):
    rng = np.random.default_rng(seed)
    q, v = rng.normal(size=(nq, d)).astype("f4"), rng.normal(size=(nv, d)).astype("f4")
    if integers:
        q, v = np.rint(q).astype("f4"), np.rint(v).astype("f4")
    v[rng.random(nv) < copies] = v[0]
    ids = rng.permutation(10 * nv)[:nv].astype(np.int64)
    return q, rng.random(nq) < missing, v, rng.random(nv) < missing, ids


@pytest.mark.parametrize("k", [1, 7, 299, 1000])
def test_random(tiles, k):
    check(*data(1), k)


@pytest.mark.parametrize("k", [3, 40])
def test_ties_go_to_the_lower_id(tiles, k):
    check(*data(2, integers=True), k)


@pytest.mark.parametrize("k", [2, 30])
def test_a_third_of_the_candidates_are_copies(tiles, k):
    check(*data(3, copies=0.34), k)


def test_zero_queries_and_candidates(tiles):
    q, qm, v, vm, ids = data(4)
    q[::2] = 0
    v[::3] = 0
    check(q, qm, v, vm, ids, 12)


def test_missing_vectors_come_last_by_id(tiles):
    check(*data(5, nv=60, missing=0.4), 55)


def test_hidden_pairs_left_out(tiles):
    q, qm, v, vm, ids = data(6, copies=0.3)
    rng = np.random.default_rng(0)
    hidden = {(int(r), int(ids[c])) for r, c in zip(rng.integers(0, 11, 900), rng.integers(0, 300, 900))}
    check(q, qm, v, vm, ids, 20, hidden=hidden)
    check(q, qm, v, vm, ids, 290, hidden=hidden)


def test_hidden_pairs_kept_at_the_end(tiles):
    q, qm, v, vm, ids = data(7, nv=80, copies=0.3)
    hidden = {(i, int(c)) for i in range(11) for c in ids[i::3]}
    check(q, qm, v, vm, ids, 80, hidden=hidden, keep_hidden=True)


def test_near_ties_below_single_precision(tiles):
    """All vectors point the same way, so single precision cannot tell them apart."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=6)
    q = (base * (1 + 1e-7 * rng.normal(size=(9, 1)))).astype("f4")
    v = (base * (1 + 1e-7 * rng.normal(size=(400, 1)))).astype("f4")
    check(q, np.zeros(9, bool), v, np.zeros(400, bool), np.arange(400)[::-1].copy(), 15)


def test_very_long_vectors_do_not_overflow(tiles):
    q, qm, v, vm, ids = data(9)
    check(q * np.float32(1e25), qm, v * np.float32(1e25), vm, ids, 10)


@settings(max_examples=60, deadline=None)
@given(
    seed=st.integers(0, 10**6), k=st.integers(1, 30), integers=st.booleans(),
    missing=st.sampled_from([0.0, 0.2, 0.9]), copies=st.sampled_from([0.0, 0.5]), block=st.sampled_from([7, 64, 500]),
)
def test_property(seed, k, integers, missing, copies, block):
    check(*data(seed, nq=5, nv=90, d=3, missing=missing, copies=copies, integers=integers), k, block=block)
