"""Weighted ratings and their split into train and test rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from shelfwise.config import check_weights
from shelfwise.operators.indexing import IndexTable

RATING_KEY = ("user_idx", "item_idx", "interaction_type")

_MAX_PREFIX_STEP = 4
_SMALL_BUCKET = 10_000


def rating_of(interaction_type: Column, weights: dict[str, float]) -> Column:
    """Weight of a type; a type without one fails the query instead of giving a NULL rating."""
    pairs = [F.lit(x) for kind, weight in weights.items() for x in (kind, float(weight))]
    unknown = F.raise_error(F.concat(F.lit("no weight for interaction type "), interaction_type))
    return F.coalesce(F.create_map(*pairs)[interaction_type], unknown.cast("double"))


def to_ratings(
    interactions: DataFrame, users: IndexTable, items: IndexTable, weights: dict[str, float]
) -> DataFrame:
    """``(user_idx, item_idx, interaction_type, rating)``: one row per interaction.

    A pair with several types keeps several ratings; ALS counts each of them.
    """
    check_weights(weights)
    indexed = items.attach_index(users.attach_index(interactions))
    return indexed.select(
        "user_idx", "item_idx", "interaction_type", rating_of(F.col("interaction_type"), weights).alias("rating")
    )


@dataclass(frozen=True)
class Split:
    train: DataFrame
    test: DataFrame | None
    n_train: int
    n_test: int


def split_ratings(
    ratings: DataFrame, ratio: float, seed: int, keys: tuple[str, ...] = RATING_KEY
) -> Split:
    """Seeded random split with exactly ``ceil(ratio * n)`` test rows.

    Rows are ordered by the md5 of ``keys`` and ``seed``, and the first ones are the test rows. Only the
    last test row is looked for, by counting ever longer md5 prefixes (at most 65,536 counts reach the
    driver), so both sides are plain row filters: no sort, no join and no shuffle of the ratings.
    ``keys`` must be unique and not NULL. ``ratings`` is read several times and should be a stored table.
    """
    if not 0 < ratio < 1:
        raise ValueError(f"ratio must lie between 0 and 1, got {ratio}")
    total = ratings.count()
    n_test = math.ceil(ratio * total)
    if n_test >= total:
        raise ValueError(f"{total} ratings are too few to hold out a share of {ratio}")
    digest = F.md5(F.concat_ws("|", *keys, F.lit(str(seed))))
    last = _row_at(ratings.select(digest.alias("_h"), *keys), total, n_test, keys)
    bound = [F.lit(last["_h"]), *[F.lit(last[k]).cast(ratings.schema[k].dataType) for k in keys]]
    in_test = F.struct(digest, *keys) <= F.struct(*bound)
    return Split(ratings.where(~in_test), ratings.where(in_test), total - n_test, n_test)


def _row_at(hashed: DataFrame, total: int, position: int, keys: tuple[str, ...]) -> Row:
    """Row number ``position`` (1-based) of ``hashed``, which has ``total`` rows, in the order of ``_h`` and ``keys``.

    The one check of uniqueness is that the rows on either side of the cut differ, whatever their number.
    """
    prefix, expected = "", total
    while True:
        digits = min(_MAX_PREFIX_STEP, max(1, math.ceil(math.log(max(expected, 2) / _SMALL_BUCKET * 10, 16))))
        scope = hashed.where(F.col("_h").startswith(prefix))
        step = F.substring("_h", len(prefix) + 1, digits)
        for row in scope.groupBy(step.alias("p")).count().orderBy("p").collect():
            if position <= row["count"]:
                break
            position -= row["count"]
        prefix += row["p"]
        expected = row["count"]
        if expected <= _SMALL_BUCKET or len(prefix) >= 32:
            break
    bucket = hashed.where(F.col("_h").startswith(prefix)).orderBy("_h", *keys)
    found = bucket.offset(position - 1).limit(2).collect()
    if len(found) == 2 and found[0] == found[1]:
        raise ValueError(f"the columns {', '.join(keys)} do not identify a row")
    return found[0]


def split_or_all(ratings: DataFrame, enabled: bool, ratio: float, seed: int) -> Split:
    """The split, or everything as train rows when it is switched off."""
    if not enabled:
        return Split(ratings, None, ratings.count(), 0)
    return split_ratings(ratings, ratio, seed)
