"""Behaviour logs to de-duplicated ``(member_id, product_id, interaction_type)`` rows."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.config import INTERACTION_PRIORITY, Thresholds
from shelfwise.functions.columns import lookback_start, position_in, tier, to_id
from shelfwise.sources.tables import BehaviourLogs

PAIR = ["member_id", "product_id"]

# Log event names and the interaction type each one means.
EVENT_TYPES = {"LikedEvent": "like", "CartItemPutEvent": "cart"}


def _recent_pairs(df: DataFrame, as_of: datetime, days: int, member: str, product: str, *extra) -> DataFrame:
    """Rows since the look-back start (inclusive, no upper bound) that have both ids."""
    start = lookback_start(as_of, days, df.schema["created_at"].dataType)
    return (
        df.where((F.col("created_at") >= start) & F.col(member).isNotNull() & F.col(product).isNotNull())
        .select(to_id(member).alias("member_id"), to_id(product).alias("product_id"), *extra)
        .dropna(subset=PAIR)
    )


def tiered_impressions(product_impression: DataFrame, as_of: datetime, days: int, thresholds: Thresholds) -> DataFrame:
    """One row per pair that reached an impression tier; every impression row counts."""
    pairs = _recent_pairs(product_impression, as_of, days, "member_id", "product_id")
    counted = pairs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    kind = tier(F.col("n"), "impression", thresholds.impression)
    return counted.select(*PAIR, kind.alias("interaction_type")).where(F.col("interaction_type").isNotNull())


def tiered_views(product_view: DataFrame, as_of: datetime, days: int, thresholds: Thresholds) -> DataFrame:
    """One row per pair that reached a view tier; a view id counts once.

    Spark first makes (pair, id) distinct, spread over all ids, and then counts, so even one pair with
    a third of all views is never gathered in a single task.
    """
    pairs = _recent_pairs(product_view, as_of, days, "member_id", "product_id", "id")
    counted = pairs.groupBy(*PAIR).agg(F.count_distinct("id").alias("n"))
    kind = tier(F.col("n"), "view", thresholds.view)
    return counted.select(*PAIR, kind.alias("interaction_type")).where(F.col("interaction_type").isNotNull())


def logged_actions(action_log: DataFrame, as_of: datetime, days: int, ignore_case: bool = False) -> DataFrame:
    """Likes and cart puts from one scan. Event names match exactly unless ``ignore_case`` is set."""
    name = F.col("event_name")
    types = dict(EVENT_TYPES)
    if ignore_case:
        name = F.lower(name)
        types = {event.lower(): kind for event, kind in types.items()}
    kind = reduce(lambda acc, e: acc.when(name == e, F.lit(types[e])), types, F)
    rows = action_log.where(name.isin(*types))
    return _recent_pairs(rows, as_of, days, "member_id", "product_id", kind.alias("interaction_type")).distinct()


def purchases(purchased_product: DataFrame, as_of: datetime, days: int) -> DataFrame:
    pairs = _recent_pairs(purchased_product, as_of, days, "customer_id", "archived_id").distinct()
    return pairs.withColumn("interaction_type", F.lit("purchase"))


def build_interactions(
    logs: BehaviourLogs, as_of: datetime, days: int, thresholds: Thresholds, ignore_case: bool = False
) -> DataFrame:
    """All interactions, each ``(member_id, product_id, interaction_type)`` once.

    Ids are cast before grouping, so ``'1'`` and ``'01'`` are one member. The four parts cannot share a
    type, so each is made distinct on its own, behind a map-side partial step, and the union needs no
    shuffle of its own.
    """
    parts = (
        tiered_views(logs.product_view, as_of, days, thresholds),
        tiered_impressions(logs.product_impression, as_of, days, thresholds),
        logged_actions(logs.action_log, as_of, days, ignore_case),
        purchases(logs.purchased_product, as_of, days),
    )
    return reduce(DataFrame.unionByName, parts)


def with_priority(interactions: DataFrame) -> DataFrame:
    """Add ``priority``, 1 for the strongest type (purchase) and 0 for an unknown one."""
    return interactions.withColumn("priority", position_in(F.col("interaction_type"), INTERACTION_PRIORITY))


def ordered_interactions(interactions: DataFrame) -> DataFrame:
    """Export order: member, product, strongest type first."""
    return with_priority(interactions).orderBy(*PAIR, "priority")


def interaction_stats(interactions: DataFrame) -> DataFrame:
    """One row: interactions, distinct members, distinct products."""
    return interactions.agg(
        F.count(F.lit(1)).alias("n_interactions"),
        F.count_distinct("member_id").alias("n_users"),
        F.count_distinct("product_id").alias("n_items"),
    )


def interaction_type_counts(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("interaction_type").agg(F.count(F.lit(1)).alias("n"))
