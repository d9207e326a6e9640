import hashlib
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfwise.config import DEFAULT_WEIGHTS
from shelfwise.operators import ratings as ratings_module
from shelfwise.operators.indexing import item_index, user_index
from shelfwise.operators.ratings import split_or_all, split_ratings, to_ratings

from support import plan_of, rows

INTERACTIONS = "member_id bigint, product_id bigint, interaction_type string"
RATINGS = "user_idx int, item_idx int, interaction_type string, rating double"


def rated(spark, data, weights=DEFAULT_WEIGHTS):
    df = spark.createDataFrame(data, INTERACTIONS)
    return to_ratings(df, user_index(df), item_index(df), weights)


def test_a_pair_keeps_one_rating_per_type(spark):
    got = rows(rated(spark, [(1, 2, "like"), (1, 2, "cart"), (1, 2, "view2"), (3, 2, "impression3")]))
    assert got == [(0, 0, "cart", 7.0), (0, 0, "like", 5.0), (0, 0, "view2", 4.0), (1, 0, "impression3", -3.0)]


def test_incomplete_weights_are_refused(spark):
    weights = {k: v for k, v in DEFAULT_WEIGHTS.items() if k != "purchase"}
    with pytest.raises(ValueError, match="purchase"):
        rated(spark, [(1, 2, "like")], weights)


def test_unknown_type_fails_loudly(spark):
    with pytest.raises(Exception, match="no weight for interaction type swipe"):
        rated(spark, [(1, 2, "swipe")]).collect()


def sample(spark, n):
    return spark.createDataFrame([(i % 17, i, "like", 5.0) for i in range(n)], RATINGS)


def expected_test_rows(n, ratio, seed):
    def key(i):
        return hashlib.md5(f"{i % 17}|{i}|like|{seed}".encode()).hexdigest()

    return sorted(sorted(range(n), key=key)[: math.ceil(ratio * n)])


@pytest.mark.parametrize("n,ratio", [(2, 0.1), (10, 0.25), (1000, 0.1), (997, 0.5)])
def test_split_has_the_exact_size_and_loses_nothing(spark, n, ratio):
    split = split_ratings(sample(spark, n), ratio, 42)
    test = sorted(r["item_idx"] for r in split.test.collect())
    train = sorted(r["item_idx"] for r in split.train.collect())
    assert test == expected_test_rows(n, ratio, 42)
    assert sorted(test + train) == list(range(n))
    assert (split.n_train, split.n_test) == (len(train), len(test))


def test_split_through_several_prefix_rounds(spark, monkeypatch):
    monkeypatch.setattr(ratings_module, "_SMALL_BUCKET", 1)
    monkeypatch.setattr(ratings_module, "_MAX_PREFIX_STEP", 1)
    split = split_ratings(sample(spark, 500), 0.3, 7)
    assert sorted(r["item_idx"] for r in split.test.collect()) == expected_test_rows(500, 0.3, 7)


def test_seed_changes_the_split(spark):
    df = sample(spark, 300)
    a, b = (sorted(r["item_idx"] for r in split_ratings(df, 0.2, s).test.collect()) for s in (1, 2))
    assert a != b


def test_split_keys_must_identify_a_row(spark):
    df = spark.createDataFrame([(1, 1, "like", 5.0)] * 20, RATINGS)
    with pytest.raises(ValueError, match="do not identify"):
        split_ratings(df, 0.5, 42)


def test_split_sides_are_plain_filters(spark):
    split = split_ratings(sample(spark, 100), 0.1, 42)
    for side in (split.train, split.test):
        assert "Exchange" not in plan_of(side) and "Join" not in plan_of(side)


def test_split_off_or_impossible(spark):
    off = split_or_all(sample(spark, 10), False, 0.1, 42)
    assert off.test is None and off.n_train == 10
    with pytest.raises(ValueError, match="too few"):
        split_ratings(sample(spark, 1), 0.5, 42)
    with pytest.raises(ValueError, match="between 0 and 1"):
        split_ratings(sample(spark, 5), 1.0, 42)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(3, 60), ratio=st.floats(0.05, 0.6), seed=st.integers(0, 10**6))
def test_split_property(spark, n, ratio, seed):
    split = split_ratings(sample(spark, n), ratio, seed)
    test = sorted(r["item_idx"] for r in split.test.collect())
    assert test == expected_test_rows(n, ratio, seed)
