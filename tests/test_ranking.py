import random

import pytest

from shelfwise.operators.indexing import item_index, user_index
from shelfwise.operators.ranking import top_n_unseen

from support import rows

SEEN = "user_idx int, item_idx int"


def one_user(spark):
    users = spark.createDataFrame([(0, [1.0])], "user_idx int, features array<float>")
    items = spark.createDataFrame([(i, [s]) for i, s in enumerate((0.9, 0.8, 0.7, 0.6))],
                                  "item_idx int, features array<float>")
    return users, items, spark.createDataFrame([(0, 0), (0, 2)], SEEN)


def test_strict_and_pad(spark):
    got = top_n_unseen(*one_user(spark), 4)
    assert [r["item_idx"] for r in got.orderBy("rank").collect()] == [1, 3]
    got = top_n_unseen(*one_user(spark), 4, mode="pad").orderBy("rank").collect()
    assert [r["item_idx"] for r in got] == [1, 3, 0, 2]
    assert [r["score"] is None for r in got] == [False, False, True, True]
    with pytest.raises(ValueError, match="mode"):
        top_n_unseen(*one_user(spark), 4, mode="loose")


def test_ties_go_to_the_lower_index(spark):
    users = spark.createDataFrame([(0, [1.0, 2.0])], "user_idx int, features array<float>")
    items = spark.createDataFrame([(i, [0.5, 0.25]) for i in (5, 2, 9)], "item_idx int, features array<float>")
    got = top_n_unseen(users, items, spark.createDataFrame([], SEEN), 2)
    assert [r["item_idx"] for r in got.orderBy("rank").collect()] == [2, 5]


def test_ids_ride_along(spark):
    rng = random.Random(0)
    pairs = sorted({(rng.randrange(100, 120), rng.randrange(500, 540)) for _ in range(150)})
    df = spark.createDataFrame([(m, p, "like") for m, p in pairs],
                               "member_id bigint, product_id bigint, interaction_type string")
    users, items = user_index(df), item_index(df)
    uf = spark.createDataFrame([(i, [rng.random(), rng.random()]) for i in range(users.size)],
                               "user_idx int, features array<float>")
    vf = spark.createDataFrame([(i, [rng.random(), rng.random()]) for i in range(items.size)],
                               "item_idx int, features array<float>")
    seen = items.attach_index(users.attach_index(df)).select("user_idx", "item_idx")
    got = top_n_unseen(uf, vf, seen, 5, "strict", users, items)
    joined = items.attach_id(users.attach_id(top_n_unseen(uf, vf, seen, 5)))
    assert rows(got, "member_id", "product_id", "rank") == rows(joined, "member_id", "product_id", "rank")
    assert not set(pairs) & {(m, p) for m, p, _ in rows(got, "member_id", "product_id", "rank")}
