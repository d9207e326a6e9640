"""Products to recommend: the best unseen items of every trained user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.indexing import IndexTable
from shelfwise.operators.topk import block_top_k


def top_n_unseen(
    users: DataFrame,
    items: DataFrame,
    seen: DataFrame,
    n: int,
    mode: str = "strict",
    user_ids: IndexTable | None = None,
    item_ids: IndexTable | None = None,
) -> DataFrame:
    """Top ``n`` items per user: ``(user_idx, item_idx, rank, score)``.

    ``users`` is ``(user_idx, features)``, ``items`` is ``(item_idx, features)``, and ``seen`` holds the
    ``(user_idx, item_idx)`` pairs of the train rows, repeats allowed. Scores are double-precision inner
    products; ties go to the lower ``item_idx``. ``strict`` never returns a seen item. ``pad`` fills up
    with seen items by ascending ``item_idx`` when fewer than ``n`` unseen are left; their score is NULL.
    Every row of ``users`` is served, users without seen items too.

    With ``user_ids`` and ``item_ids`` the result also has ``member_id`` and ``product_id``. They are joined
    to the factor tables, one row per id, and not to the n times larger result.
    """
    if mode not in ("strict", "pad"):
        raise ValueError(f"mode must be 'strict' or 'pad', got {mode!r}")
    queries = _vectors(users, "user_idx", user_ids)
    candidates = _vectors(items, "item_idx", item_ids)
    hidden = seen.select(F.col("user_idx").alias("qid"), F.col("item_idx").alias("cid"))
    item_side = items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("dim")).first()
    shape = (users.count(), item_side["n"], item_side["dim"] or 1)
    found = block_top_k(queries, candidates, n, hidden=hidden, keep_hidden=mode == "pad", shape=shape)
    names = []
    if user_ids is not None:
        names.append(F.col("qlabel").alias(user_ids.id_col))
    if item_ids is not None:
        names.append(F.col("clabel").alias(item_ids.id_col))
    return found.select(
        F.col("qid").cast("int").alias("user_idx"), F.col("cid").cast("int").alias("item_idx"), *names, "rank", "score"
    )


def _vectors(factors: DataFrame, idx_col: str, ids: IndexTable | None) -> DataFrame:
    label = F.col(idx_col)
    if ids is not None:
        factors = factors.join(ids.df, idx_col)
        label = F.col(ids.id_col)
    return factors.select(F.col(idx_col).alias("id"), label.alias("label"), F.col("features").alias("vector"))
