import pytest
from pyspark.sql import functions as F

from shelfwise.functions import columns, vectors

from support import rows


def test_to_id_drops_what_is_not_a_whole_number(spark):
    raw = ["abc", "12abc", "1.5", " 7 ", "01", "-1", None]
    df = spark.createDataFrame([(x,) for x in raw], "x string")
    got = [r[0] for r in df.select(columns.to_id("x")).collect()]
    assert got == [None, None, None, 7, 1, -1, None]


def test_tier_edges(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 3, 4, 6, 7, 9)], "n int")
    got = [r[0] for r in df.select(columns.tier(F.col("n"), "view", (1, 4, 7))).collect()]
    assert got == [None, "view1", "view1", "view2", "view2", "view3", "view3"]


def test_position_in(spark):
    df = spark.createDataFrame([("b",), ("z",)], "x string")
    assert [r[0] for r in df.select(columns.position_in(F.col("x"), ["a", "b"])).collect()] == [2, 0]


def test_image_url(spark):
    df = spark.createDataFrame([(None,), ("",), ("a.jpg",)], "f string")
    got = [r[0] for r in df.select(columns.image_url(F.col("f"), "cdn.example.com")).collect()]
    assert got == [None, None, "https://cdn.example.com/a.jpg"]
    for unset in (None, ""):
        assert [r[0] for r in df.select(columns.image_url(F.col("f"), unset)).collect()] == [None] * 3


def test_vector_text(spark):
    df = spark.createDataFrame([("[1,2.5, 3]",), ("1,2",), ("[1,x]",), (None,)], "t string")
    good, bad = vectors.split_parsable(df, "t", "v")
    assert rows(good) == [(None,), ([1.0, 2.0],), ([1.0, 2.5, 3.0],)]
    assert rows(bad) == [("[1,x]",)]


def test_vector_text_round_trip(spark):
    df = spark.createDataFrame([([0.1, -2.0, 3e-8],)], "v array<float>")
    text = vectors.format_vector(F.col("v"))
    back = df.select(F.col("v"), vectors.parse_vector(text).alias("w")).first()
    assert back["v"] == back["w"]


def test_inner_product(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vectors.negative_inner_product(F.col("a"), F.col("b"))).collect()] == [-11.0, None]


def test_inner_product_of_unequal_lengths_is_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="differ in length"):
        df.select(vectors.inner_product(F.col("a"), F.col("b"))).collect()


def test_bad_elements(spark):
    inf = float("inf")
    data = [([1.0, 2.0],), ([1.0, None],), ([float("nan")],), ([inf],), (None,)]
    df = spark.createDataFrame(data, "v array<float>")
    assert [r[0] for r in df.select(vectors.has_bad_element(F.col("v"))).collect()] == [False, True, True, True, False]
