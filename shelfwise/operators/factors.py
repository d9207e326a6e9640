"""Explicit-feedback ALS: fit, predict, factors."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.config import RunConfig
from shelfwise.functions.vectors import inner_product
from shelfwise.operators.indexing import IndexTable
from shelfwise.session import lookup_join, shared_root

_CHECKPOINT_INTERVAL = 5


def fit_als(train: DataFrame, cfg: RunConfig) -> ALSModel:
    """Fit on ``(user_idx, item_idx, rating)``, repeated pairs counting as often as they occur.

    The starting factors are drawn per block, so ``cfg.als_blocks`` belongs to the model: raise it for very many
    ratings, and keep it to get the same model again. Long lineages are cut every few iterations by checkpoints in the
    shared folder. ``train`` should be a stored table, so that
    a lost executor re-reads the same rows.
    """
    shared_root(train.sparkSession)
    als = ALS(
        userCol="user_idx",
        itemCol="item_idx",
        ratingCol="rating",
        implicitPrefs=False,
        maxIter=cfg.max_iter,
        regParam=cfg.reg_param,
        rank=cfg.rank,
        nonnegative=cfg.nonnegative,
        coldStartStrategy=cfg.cold_start_strategy,
        seed=cfg.model_seed,
        numUserBlocks=cfg.als_blocks,
        numItemBlocks=cfg.als_blocks,
        checkpointInterval=_CHECKPOINT_INTERVAL,
    )
    return als.fit(train.select("user_idx", "item_idx", "rating"))


# Bytes of a rating within a block: two ids, the rating and its place.
_RATING_BYTES = 16


def block_loads(train: DataFrame, blocks: int) -> DataFrame:
    """Per side ``(side, blocks, n_ids, most_rows_of_id, most_rows_of_block, most_block_bytes)`` of a fit on ``train``.

    The fit deals ids to blocks by remainder and keeps all ratings of a block in one task, so these are the rows that
    its largest tasks hold. One pass per side with partial counts; nothing but the two rows is collected by a reader.
    """

    def side(name: str, idx: str) -> DataFrame:
        per_id = train.groupBy(idx).agg(F.count(F.lit(1)).alias("n"))
        per_block = per_id.groupBy(F.pmod(F.col(idx), F.lit(blocks)).alias("block")).agg(
            F.sum("n").alias("rows"), F.max("n").alias("most"), F.count(F.lit(1)).alias("ids")
        )
        return per_block.agg(
            F.coalesce(F.sum("ids"), F.lit(0)).alias("n_ids"), F.coalesce(F.max("most"), F.lit(0)).alias("most_rows_of_id"),
            F.coalesce(F.max("rows"), F.lit(0)).alias("most_rows_of_block"),
        ).select(
            F.lit(name).alias("side"), F.lit(blocks).cast("bigint").alias("blocks"), "n_ids", "most_rows_of_id",
            "most_rows_of_block", (F.col("most_rows_of_block") * _RATING_BYTES).alias("most_block_bytes"),
        )

    return side("user", "user_idx").unionByName(side("item", "item_idx"))


def check_loads(loads: list[dict], limit: int) -> None:
    """Refuse a fit whose largest block would hold more than ``limit`` rows, and say what would help."""
    for load in loads:
        if load["most_rows_of_id"] > limit:
            raise ValueError(
                f"one {load['side']} has {load['most_rows_of_id']} ratings, over als_block_rows = {limit}; no number of "
                "als_blocks parts them: raise als_block_rows if a task can hold them, or drop the id"
            )
        if load["most_rows_of_block"] > limit:
            wanted = -(-load["blocks"] * load["most_rows_of_block"] // limit)
            raise ValueError(
                f"a {load['side']} block would hold {load['most_rows_of_block']} ratings, over als_block_rows = {limit}; "
                f"set als_blocks to {wanted} or more, which makes another model"
            )


def predict(model: ALSModel, pairs: DataFrame) -> DataFrame:
    """Add ``prediction``; NaN where the user or item was not trained (or no row, if the model drops those)."""
    return model.transform(pairs)


def predict_stored(
    users: DataFrame, items: DataFrame, pairs: DataFrame, user_ids: IndexTable, item_ids: IndexTable
) -> DataFrame:
    """Add ``prediction`` to indexed ``pairs`` from stored factor tables; NULL where a side was not trained.

    Unlike ``predict`` it does not depend on the model's cached blocks, and a user or item with very many
    pairs is spread over tasks.
    """
    rank = items.select(F.size("features").alias("rank")).first()
    row_bytes = 64 + 4 * (rank["rank"] if rank else 0)
    for idx_col, factors, ids in (("user_idx", users, user_ids), ("item_idx", items, item_ids)):
        vectors = factors.select(idx_col, F.col("features").alias(f"_{idx_col}"))
        dim = ids.df.select(idx_col, "n_rows").join(vectors, idx_col, "left")
        pairs = lookup_join(pairs, dim, [idx_col], "n_rows", ids.size, ids.total_rows, row_bytes)
    score = inner_product(F.col("_user_idx"), F.col("_item_idx"))
    return pairs.withColumn("prediction", score).drop("_user_idx", "_item_idx")


def user_factors(model: ALSModel) -> DataFrame:
    """``(user_idx, features)``, one row per trained user. ``ordered_factors`` sorts for an export."""
    return model.userFactors.select(F.col("id").alias("user_idx"), "features")


def item_factors(model: ALSModel) -> DataFrame:
    return model.itemFactors.select(F.col("id").alias("item_idx"), "features")


def ordered_factors(factors: DataFrame) -> DataFrame:
    """Factor rows for an export, by ascending index: a range-partitioned sort, not one task."""
    return factors.orderBy(factors.columns[0])


def factor_dims(model: ALSModel) -> DataFrame:
    """``(side, n_ids, rank)`` of the two factor tables."""

    def dims(side: str, factors: DataFrame) -> DataFrame:
        return factors.agg(F.count(F.lit(1)).alias("n_ids"), F.max(F.size("features")).alias("rank")).select(
            F.lit(side).alias("side"), "n_ids", F.col("rank").cast("bigint").alias("rank")
        )

    return dims("user", model.userFactors).unionByName(dims("item", model.itemFactors))
