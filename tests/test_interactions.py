import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from shelfwise.config import Thresholds
from shelfwise.operators import interactions
from shelfwise.sources.tables import BehaviourLogs

from support import AS_OF, plan_of, rows

T = datetime(2024, 1, 25)
TIERS = Thresholds(view=(1, 4, 7), impression=(1, 4, 7))


def logs(spark, views=(), impressions=(), actions=(), purchases=()):
    """Logs from ``(member, product[, id or event][, time])`` tuples."""
    return BehaviourLogs(
        product_impression=spark.createDataFrame(
            list(impressions), "member_id string, product_id string, created_at timestamp"),
        product_view=spark.createDataFrame(
            list(views), "id bigint, member_id string, product_id string, created_at timestamp"),
        action_log=spark.createDataFrame(
            list(actions), "member_id string, product_id string, event_name string, created_at timestamp"),
        purchased_product=spark.createDataFrame(
            list(purchases), "customer_id string, archived_id string, created_at timestamp"),
    )


def build(spark, **tables):
    return rows(interactions.build_interactions(logs(spark, **tables), AS_OF, 10, TIERS))


@pytest.mark.parametrize("count,tier", [(1, 1), (3, 1), (4, 2), (6, 2), (7, 3), (9, 3)])
def test_tiers_of_views_and_impressions(spark, count, tier):
    got = build(
        spark,
        views=[(i, "5", "50", T) for i in range(count)],
        impressions=[("5", "50", T)] * count,
    )
    assert got == [(5, 50, f"impression{tier}"), (5, 50, f"view{tier}")]


def test_pairs_below_the_first_tier_are_left_out(spark):
    tiers = Thresholds(view=(2, 4, 7), impression=(2, 4, 7))
    some = logs(spark, views=[(1, "5", "50", T)], impressions=[("5", "50", T)])
    assert rows(interactions.build_interactions(some, AS_OF, 10, tiers)) == []


def test_a_view_id_counts_once_an_impression_row_always(spark):
    got = build(spark, views=[(1, "5", "50", T)] * 4, impressions=[("5", "50", T)] * 4)
    assert got == [(5, 50, "impression2"), (5, 50, "view1")]


def test_lookback_is_inclusive_and_open_ended(spark):
    edge = AS_OF - timedelta(days=10)
    got = build(
        spark,
        purchases=[("1", "1", edge), ("2", "2", edge - timedelta(microseconds=1)), ("3", "3", AS_OF + timedelta(days=5))],
    )
    assert got == [(1, 1, "purchase"), (3, 3, "purchase")]


def test_rows_without_an_id_are_left_out_of_every_source(spark):
    got = build(
        spark,
        views=[(1, None, "1", T), (2, "1", None, T)],
        impressions=[(None, "1", T), ("1", None, T)],
        actions=[(None, "1", "LikedEvent", T), ("1", None, "CartItemPutEvent", T)],
        purchases=[(None, "1", T), ("1", None, T)],
    )
    assert got == []


def test_dirty_ids(spark):
    got = build(spark, purchases=[(m, "1", T) for m in ("abc", "12abc", "1.5", " 7 ", "01")])
    assert got == [(1, 1, "purchase"), (7, 1, "purchase")]


def test_ids_are_cast_before_counting(spark):
    got = build(spark, views=[(1, "1", "9", T), (2, "01", "9", T), (3, "1", "9", T), (4, "001", "9", T)])
    assert got == [(1, 9, "view2")]


def test_same_type_once_different_types_each(spark):
    got = build(
        spark,
        actions=[("1", "2", "LikedEvent", T), ("1", "2", "LikedEvent", T), ("1", "2", "CartItemPutEvent", T),
                 ("1", "2", "OtherEvent", T)],
        views=[(i, "1", "2", T) for i in range(4)],
    )
    assert got == [(1, 2, "cart"), (1, 2, "like"), (1, 2, "view2")]


def test_event_names_match_exactly_unless_told_otherwise(spark):
    some = logs(spark, actions=[("1", "2", "likedevent", T)])
    assert rows(interactions.build_interactions(some, AS_OF, 10, TIERS)) == []
    assert rows(interactions.build_interactions(some, AS_OF, 10, TIERS, ignore_case=True)) == [(1, 2, "like")]


def test_order_and_stats(spark):
    data = [(1, 2, "impression1"), (1, 2, "purchase"), (1, 1, "view3"), (0, 9, "cart")]
    df = spark.createDataFrame(data, "member_id bigint, product_id bigint, interaction_type string")
    ordered = [(r["member_id"], r["product_id"], r["interaction_type"])
               for r in interactions.ordered_interactions(df).collect()]
    assert ordered == [(0, 9, "cart"), (1, 1, "view3"), (1, 2, "purchase"), (1, 2, "impression1")]
    assert tuple(interactions.interaction_stats(df).first()) == (4, 2, 3)
    assert rows(interactions.interaction_type_counts(df)) == [
        ("cart", 1), ("impression1", 1), ("purchase", 1), ("view3", 1)]


def test_against_plain_python_with_one_hot_pair(spark):
    """A third of all rows belong to one pair; the result must still be whole."""
    rng = random.Random(3)

    def pair():
        return ("7", "70") if rng.random() < 0.34 else (str(rng.randrange(20)), str(rng.randrange(30)))

    views = [(rng.randrange(900), *pair(), T) for _ in range(2000)]
    impressions = [(*pair(), T) for _ in range(2000)]
    actions = [(*pair(), rng.choice(["LikedEvent", "CartItemPutEvent", "x"]), T) for _ in range(600)]
    bought = [(*pair(), T) for _ in range(300)]
    ids = defaultdict(set)
    for i, m, p, _ in views:
        ids[int(m), int(p)].add(i)
    seen = Counter((int(m), int(p)) for m, p, _ in impressions)

    def tier(n):
        return 3 if n >= 7 else 2 if n >= 4 else 1

    want = {(*k, f"view{tier(len(v))}") for k, v in ids.items()}
    want |= {(*k, f"impression{tier(n)}") for k, n in seen.items()}
    names = {"LikedEvent": "like", "CartItemPutEvent": "cart"}
    want |= {(int(m), int(p), names[e]) for m, p, e, _ in actions if e in names}
    want |= {(int(m), int(p), "purchase") for m, p, _ in bought}
    got = build(spark, views=views, impressions=impressions, actions=actions, purchases=bought)
    assert got == sorted(want, key=repr)


def test_plan_filters_at_the_scan_and_shuffles_each_part_on_its_own(spark, tmp_path):
    some = logs(spark, views=[(1, "1", "2", T)], actions=[("1", "2", "LikedEvent", T)])
    some.action_log.write.parquet(f"{tmp_path}/a")
    stored = BehaviourLogs(some.product_impression, some.product_view, spark.read.parquet(f"{tmp_path}/a"),
                           some.purchased_product)
    plan = plan_of(interactions.build_interactions(stored, AS_OF, 10, TIERS))
    assert "GreaterThanOrEqual(created_at" in plan and "In(event_name" in plan
    assert plan.count("Exchange hashpartitioning") == 5  # two for distinct views, one for each other part
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan
