import pytest

from shelfwise.operators import similarity

from support import rows

SCHEMA = (
    "id bigint, status string, primary_category_id int, secondary_category_id int, image_vector array<float>"
)


@pytest.fixture(scope="module")
def products(spark):
    data = [
        (1, "SALE", 1, 1, [1.0, 0.0]),
        (2, "SALE", 1, 1, [10.0, 10.0]),
        (3, "SALE", 1, 1, [0.9, 0.1]),
        (4, "SOLD_OUT", 1, 1, [5.0, 0.0]),
        (5, "SALE", 1, 1, None),
        (6, "SALE", 1, 2, [9.0, 0.0]),
        (7, "SALE", None, 1, [9.0, 0.0]),
        (8, "SALE", 1, None, [9.0, 0.0]),
    ]
    return spark.createDataFrame(data, SCHEMA).cache()


def test_similar_in_the_same_categories_by_inner_product(products):
    got = rows(similarity.similar_products(products, [1], 10))
    assert [(r[1], r[3]) for r in sorted(got, key=lambda r: r[3])] == [(2, 1), (3, 2), (5, 3)]
    distances = {r[1]: r[2] for r in got}
    assert distances[2] == -10.0 and abs(distances[3] + 0.9) < 1e-6 and distances[5] is None


def test_a_sold_out_product_is_answered_but_never_offered(products):
    got = rows(similarity.similar_products(products, [4], 10))
    assert sorted(r[1] for r in got) == [1, 2, 3, 5]
    everything = similarity.similar_products(products, None, 10)
    assert 4 not in {r[1] for r in rows(everything)}


def test_null_categories_match_nothing(products):
    assert rows(similarity.similar_products(products, [7, 8], 10)) == []


def test_empty_and_unknown_ids(products):
    assert similarity.similar_products(products, [], 10).count() == 0
    assert similarity.similar_products(products, [99], 10).count() == 0
    assert similarity.similar_to(products, 99, 10).count() == 0
    assert similarity.product_vectors(products, []).count() == 0
    assert similarity.product_vector(products, 99) is None


def test_ids_from_a_table_or_a_long_list(spark, products):
    ids = spark.createDataFrame([(1,), (1,), (None,), (99,)], "x bigint")
    want = rows(similarity.similar_products(products, [1], 2))
    assert rows(similarity.similar_products(products, ids, 2)) == want
    assert rows(similarity.similar_products(products, [1, *range(1000, 3000)], 2)) == want


def test_similar_to_ignores_status_and_category(products):
    got = [r["id"] for r in similarity.similar_to(products, 1, 4).collect()]
    assert got == [2, 6, 7, 8]


def test_similar_to_a_product_without_a_vector(products):
    got = [tuple(r) for r in similarity.similar_to(products, 5, 3).collect()]
    assert got == [(1, None), (2, None), (3, None)]


def test_search_by_vector(products):
    got = [tuple(r) for r in similarity.search_by_vector(products, [1.0, 0.0], 3).collect()]
    assert got == [(2, -10.0), (6, -9.0), (7, -9.0)]
    for nothing in (None, []):
        assert similarity.search_by_vector(products, [1.0, 0.0], 9, nothing).count() == 7
    left = [r["id"] for r in similarity.search_by_vector(products, [1.0, 0.0], 3, [2, 7]).collect()]
    assert left == [6, 8, 1]
    with pytest.raises(ValueError, match="NULL"):
        similarity.search_by_vector(products, [1.0, 0.0], 3, [2, None])


def test_search_raises_instead_of_returning_nothing(products):
    with pytest.raises(Exception, match="differ in length"):
        similarity.search_by_vector(products, [1.0, 0.0, 0.0], 3).collect()


def test_search_by_many_vectors_equals_one_by_one(spark, products):
    queries = {11: [1.0, 0.0], 12: [-1.0, 0.5], 13: [0.0, 0.0]}
    df = spark.createDataFrame(list(queries.items()), "query_id bigint, vector array<float>")
    got = similarity.search_by_vectors(products, df, 4, [3]).orderBy("query_id", "rank").collect()
    for q, vector in queries.items():
        one = [tuple(r) for r in similarity.search_by_vector(products, vector, 4, [3]).collect()]
        assert [(r["id"], r["distance"]) for r in got if r["query_id"] == q] == one


def test_vectors_and_lists(products):
    assert similarity.product_vector(products, 2) == [10.0, 10.0]
    assert rows(similarity.product_vectors(products, [2, 99, 4])) == [(2, [10.0, 10.0]), (4, [5.0, 0.0])]
    lists = similarity.similar_lists(similarity.similar_products(products, [1], 10))
    assert rows(lists) == [(1, [2, 3, 5])]
