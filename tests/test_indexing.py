import random

import pytest
from pyspark.sql import functions as F

from shelfwise import session
from shelfwise.operators import indexing

from support import plan_of, rows

SCHEMA = "member_id bigint, product_id bigint, interaction_type string"


def interactions(spark, pairs):
    return spark.createDataFrame([(m, p, "like") for m, p in pairs], SCHEMA)


def test_first_appearance_order(spark):
    df = interactions(spark, [(5, 20), (5, 30), (9, 10)])
    assert rows(indexing.user_index(df).df, "member_id", "user_idx") == [(5, 0), (9, 1)]
    assert rows(indexing.item_index(df).df, "product_id", "item_idx") == [(10, 2), (20, 0), (30, 1)]


def test_dense_and_ordered_over_many_partitions(spark):
    ids = random.Random(1).sample(range(10**9), 5000)
    df = spark.createDataFrame([(i,) for i in ids], "k bigint").repartition(13)
    numbered, size, _ = indexing.dense_index(df, ["k"], "n")
    assert size == 5000
    assert rows(numbered, "n", "k") == sorted(enumerate(sorted(ids)), key=repr)


def test_empty(spark):
    table = indexing.user_index(interactions(spark, []))
    assert table.size == 0 and table.df.count() == 0


def test_items_against_plain_python(spark):
    rng = random.Random(2)
    pairs = {(rng.randrange(50), rng.randrange(80)) for _ in range(600)}
    first = {}
    for m, p in sorted(pairs):
        first.setdefault(p, len(first))
    table = indexing.item_index(interactions(spark, pairs))
    assert rows(table.df, "product_id", "item_idx") == sorted(first.items(), key=repr)
    assert table.total_rows == len(pairs)


def test_counting_rows_uses_no_single_partition_sort(spark):
    df = interactions(spark, [(i % 97, i) for i in range(500)])
    keys = df.groupBy("member_id").agg(F.count(F.lit(1)).alias("n_rows"))
    placed = keys.repartitionByRange("member_id").sortWithinPartitions("member_id")
    assert "rangepartitioning" in plan_of(placed) and "SinglePartition" not in plan_of(placed)


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_lookups_both_ways_with_a_hot_member(spark, monkeypatch, limit):
    """Half of all rows are one member's; with limit 0 nothing is broadcast and hot keys are salted."""
    monkeypatch.setattr(session, "BROADCAST_BYTES", limit)
    pairs = [(7, p) for p in range(400)] + [(m, m % 11) for m in range(400) if m != 7]
    df = interactions(spark, pairs)
    users, items = indexing.user_index(df), indexing.item_index(df)
    indexed = items.attach_index(users.attach_index(df))
    assert indexed.count() == len(pairs)
    back = items.attach_id(users.attach_id(indexed.select("user_idx", "item_idx")))
    assert rows(back, "member_id", "product_id") == sorted(pairs, key=repr)


def test_salting_spreads_the_hot_key(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    df = interactions(spark, [(7, p) for p in range(2000)] + [(m, 0) for m in range(100, 400)])
    joined = indexing.user_index(df).attach_index(df)
    plan = plan_of(joined)
    assert "_salt" in plan
    assert joined.count() == 2300


def test_index_must_fit_an_integer(spark, monkeypatch):
    monkeypatch.setattr(indexing, "MAX_INDEX", 2)
    with pytest.raises(ValueError, match="integer range"):
        indexing.user_index(interactions(spark, [(m, 1) for m in range(3)]))
