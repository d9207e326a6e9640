"""Task-side scoring: the best candidates per query by inner product, one block of candidates at a time."""

from __future__ import annotations

import numpy as np

TILE = 4096
ROWS = 1024
MISSING = np.finfo(np.float64).min
_NO_ID = np.iinfo(np.int64).max
_FLOAT32_SAFE = 1e30


class RunningTopK:
    """Best ``k`` candidates of each query seen so far: score descending, then candidate id ascending.

    Vectors are single precision, scores are their inner products in double precision. A fast product in
    single precision only finds which candidates may still enter, with a margin above its rounding
    error; those are scored again exactly. Candidates are tried longest first, and a query stops at the
    length that can no longer reach its k-th score. A query or candidate without a vector scores
    ``MISSING``, below all others. Memory depends on the number of queries, ``k`` and the tile sizes alone.
    """

    def __init__(self, vectors: np.ndarray, missing: np.ndarray, k: int):
        self.q = np.ascontiguousarray(vectors, dtype=np.float32)
        self.q_missing = missing
        self.q_norm = _norms(self.q)
        self.k = k
        self.score = np.full((len(vectors), k), -np.inf)
        self.cid = np.full((len(vectors), k), _NO_ID, dtype=np.int64)
        self.label = np.zeros((len(vectors), k), dtype=np.int64)

    def push(self, cid, label, vectors, missing, hide_row=None, hide_cid=None, keep_hidden=False):
        """Offer a block of candidates. Pairs ``(hide_row[i], hide_cid[i])`` are left out, or score
        ``MISSING`` if ``keep_hidden`` is set."""
        norm = np.where(missing, -1.0, _norms(vectors))
        order = np.lexsort((cid, -norm))
        if hide_row is None:
            hide_row = hide_cid = np.empty(0, dtype=np.int64)
        if not (keep_hidden and len(hide_row)):
            spare = int(np.bincount(hide_row).max()) if len(hide_row) else 0
            order = _drop_spare_copies(order, norm, vectors, self.k + spare)
        cid, label, norm, missing = cid[order], label[order], norm[order], missing[order]
        vectors = np.ascontiguousarray(vectors[order], dtype=np.float32)
        hide_row, hide_col = _locate(hide_row, hide_cid, cid)
        for start in range(0, len(cid), TILE):
            tile = slice(start, min(start + TILE, len(cid)))
            top_norm = max(norm[start], 0.0)
            reach = np.where(self.q_missing | (norm[start] < 0), MISSING, self.q_norm * top_norm)
            active = np.flatnonzero(reach + self._margin(top_norm, np.float32) >= self.score[:, -1])
            if not len(active):
                break
            in_tile = (hide_col >= tile.start) & (hide_col < tile.stop)
            tile_hide = (hide_row[in_tile], hide_col[in_tile] - tile.start)
            for i in range(0, len(active), ROWS):
                self._offer(
                    active[i : i + ROWS], cid[tile], label[tile], vectors[tile], missing[tile], top_norm,
                    tile_hide, keep_hidden,
                )

    def _margin(self, top_norm: float, dtype) -> np.ndarray:
        """More than the rounding error of a fast inner product, per query."""
        dim = self.q.shape[1]
        return (4 * dim + 16) * np.finfo(dtype).eps * self.q_norm * top_norm

    def _offer(self, rows, cid, label, vectors, missing, top_norm, hide, keep_hidden):
        local = np.full(len(self.q), -1)
        local[rows] = np.arange(len(rows))
        mine = local[hide[0]] >= 0
        hidden = (local[hide[0][mine]], hide[1][mine])
        small = max(self.q_norm[rows].max(), 1.0) * max(top_norm, 1.0) < _FLOAT32_SAFE
        for dtype in (np.float32, np.float64) if small else (np.float64,):
            margin = self._margin(top_norm, dtype)[rows]
            fast, hits = self._hits(rows, vectors, missing, hidden, keep_hidden, margin, dtype)
            at = np.flatnonzero(hits)
            crowded = len(at) > 4 * self.k * len(rows)
            if not crowded:
                break
        if not len(at):
            return
        r, c = np.divmod(at, fast.shape[1])
        score = _exact(self.q[rows], vectors, r, c)
        score[fast.ravel()[at] == np.finfo(dtype).min] = MISSING
        if crowded:
            best = _best_in_tile(fast.shape, r, c, score, cid, self.k)
            r, c, score = r[best], c[best], score[best]
        self._merge(rows, r, score, cid[c], label[c])

    def _hits(self, rows, vectors, missing, hidden, keep_hidden, margin, dtype):
        """Fast scores of a tile, and which of them may belong to a row's best ``k``."""
        lowest = np.finfo(dtype).min
        fast = self.q[rows].astype(dtype, copy=False) @ vectors.astype(dtype, copy=False).T
        fast[:, missing] = lowest
        fast[self.q_missing[rows]] = lowest
        fast[hidden] = lowest
        floor = self.score[rows, -1] - margin
        unfilled = np.flatnonzero(floor <= MISSING)
        at = fast.shape[1] - self.k
        if len(unfilled) and at > 0:
            floor[unfilled] = np.partition(fast[unfilled], at, axis=1)[:, at] - 2 * margin[unfilled]
        with np.errstate(over="ignore"):
            hits = fast >= np.nextafter(floor.astype(dtype), dtype(-np.inf))[:, None]
        if not keep_hidden:
            hits[hidden] = False
        return fast, hits

    def _merge(self, rows, r, score, cid, label):
        """Take in hits, given by ascending row: new ones are set beside the kept ones and each row sorted."""
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        kept = rows[r[first]]
        place = _place_in_run(r)
        slot = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(r)]))
        width = self.k + int(place.max()) + 1
        scores = np.full((len(kept), width), -np.inf)
        cids = np.full((len(kept), width), _NO_ID, dtype=np.int64)
        labels = np.zeros((len(kept), width), dtype=np.int64)
        for wide, old, new in ((scores, self.score, score), (cids, self.cid, cid), (labels, self.label, label)):
            wide[:, : self.k] = old[kept]
            wide[slot, self.k + place] = new
        order = np.argsort(-scores, axis=1)
        ranked = np.take_along_axis(scores, order, axis=1)
        level = (ranked[:, 1:] == ranked[:, :-1]) & np.isfinite(ranked[:, 1:])
        for i in np.flatnonzero(level[:, : self.k].any(axis=1)):
            order[i] = np.lexsort((cids[i], -scores[i]))
        order = order[:, : self.k]
        for wide, old in ((scores, self.score), (cids, self.cid), (labels, self.label)):
            old[kept] = np.take_along_axis(wide, order, axis=1)

    def results(self):
        """``(query row, candidate id, label, score, rank)`` arrays, best first per query."""
        row, slot = np.nonzero(self.cid != _NO_ID)
        return row, self.cid[row, slot], self.label[row, slot], self.score[row, slot], slot + 1


def _norms(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, dtype=np.float64)
    return np.sqrt((v * v).sum(axis=1))


def _exact(q, vectors, r, c) -> np.ndarray:
    """Double-precision inner products of the pairs; the same two vectors give the same value anywhere."""
    out = np.empty(len(r))
    step = max(1, (1 << 21) // max(q.shape[1], 1))
    for i in range(0, len(r), step):
        part = slice(i, i + step)
        out[part] = (q[r[part]].astype(np.float64) * vectors[c[part]]).sum(axis=1)
    return out


def _best_in_tile(shape, r, c, score, cid, k) -> np.ndarray:
    """Which hits are among the ``k`` best of their row in this tile, lower ids first among equals."""
    if shape[1] <= k:
        return np.ones(len(r), dtype=bool)
    column = np.empty(shape[1], dtype=np.int64)
    column[np.argsort(cid, kind="stable")] = np.arange(shape[1])
    dense = np.full(shape, -np.inf)
    dense[r, column[c]] = score
    kth = np.partition(dense, shape[1] - k, axis=1)[:, shape[1] - k, None]
    above = dense > kth
    level = dense == kth
    keep = above | (level & (level.cumsum(axis=1) <= k - above.sum(axis=1, keepdims=True)))
    return keep[r, column[c]]


def _place_in_run(sorted_keys: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal keys."""
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return np.arange(len(sorted_keys)) - np.repeat(starts, np.diff(np.r_[starts, len(sorted_keys)]))


def _locate(hide_row, hide_cid, cid):
    """Positions in ``cid`` of the hidden ids; ids that are not in this block fall away."""
    if not len(hide_row):
        return hide_row, hide_cid
    by_id = np.argsort(cid, kind="stable")
    at = np.searchsorted(cid[by_id], hide_cid)
    found = at < len(cid)
    found[found] = cid[by_id[at[found]]] == hide_cid[found]
    return hide_row[found], by_id[at[found]]


def _drop_spare_copies(order, norm, vectors, keep):
    """Of equal vectors only the ``keep`` lowest ids can enter a result; drop the rest of each block.

    Equal vectors have equal norms, so the exact comparison runs only where a norm repeats that often.
    """
    sorted_norm = norm[order]
    place = _place_in_run(sorted_norm)
    if not len(place) or place.max() < keep:
        return order
    rows = np.ascontiguousarray(vectors[order], dtype=np.float64) + 0.0
    rows[sorted_norm < 0] = 0.0
    code = np.unique(np.c_[sorted_norm, rows], axis=0, return_inverse=True)[1].ravel()
    by_code = np.argsort(code, kind="stable")
    spare = np.empty(len(order), dtype=bool)
    spare[by_code] = _place_in_run(code[by_code]) >= keep
    return order[~spare]
