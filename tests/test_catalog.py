import pytest
from pyspark.sql import functions as F

from shelfwise.operators import catalog

from support import rows

SCHEMA = "id bigint, main_image string, status string, primary_category_id int, secondary_category_id int"


@pytest.fixture(scope="module")
def products(spark):
    data = [(i, None if i == 3 else "" if i == 4 else f"{i}.jpg", "SALE" if i % 2 else "SOLD_OUT", i, 1)
            for i in range(10)]
    return spark.createDataFrame(data, SCHEMA).repartition(4).cache()


def test_no_predicate_no_rows(products):
    assert catalog.product_page(products).count() == 0
    assert catalog.product_urls(products).count() == 0
    assert catalog.product_ids(products).count() == 0


def test_predicate_as_text_or_column(products):
    assert rows(catalog.product_ids(products, "status = 'SALE' AND id > 4")) == [(5,), (7,), (9,)]
    assert rows(catalog.product_ids(products, F.col("id") < 2)) == [(0,), (1,)]


def test_pages(products):
    pages = [[r["id"] for r in catalog.product_urls(products, F.lit(True), 3, n).collect()]
             for n in range(5)]
    assert pages == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9], []]
    with pytest.raises(ValueError):
        catalog.product_urls(products, F.lit(True), 3, -1)


def test_one_ordered_plan_for_every_page(products):
    for n in (0, 10_000_000):
        plan = catalog.page(products, 3, n)._jdf.queryExecution().optimizedPlan().toString()
        assert "Sort" in plan and "Limit" in plan and plan.index("Limit") < plan.index("Sort")


def test_pages_by_key_range(products):
    found, last = [], None
    while page := [r["id"] for r in catalog.page_after(products, last, 4).collect()]:
        found.append(page)
        last = page[-1]
    assert found == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]


def test_all_pages_at_once(products):
    numbered = catalog.page_numbers(products.select("id"), 3)
    assert rows(numbered, "id", "batch_no") == [(i, i // 3) for i in range(10)]


def test_urls(products):
    got = dict(rows(catalog.product_links(products, [2, 3, 4, 99], "img.example.com")))
    assert got == {2: "https://img.example.com/2.jpg", 3: None, 4: None}
    assert set(dict(rows(catalog.product_links(products, [2]))).values()) == {None}


def test_page_columns(products):
    row = catalog.product_page(products, "id = 7", domain="d").first()
    assert row.asDict() == {
        "id": 7, "image_url": "https://d/7.jpg", "status": "SALE", "primary_category_id": 7,
        "secondary_category_id": 1,
    }


def test_all_ids(products):
    assert catalog.all_product_ids(products).count() == 10


def test_directory_pages_are_those_of_the_sorted_table(spark):
    ids = [7 * i % 1009 - 300 for i in range(1000)]
    df = spark.createDataFrame([(i, f"f{i}") for i in ids], "id bigint, main_image string").repartition(5)
    directory = catalog.page_directory(df, 64)
    assert directory.count() == 16
    for no in (0, 1, 9, 15, 16):
        got = [r["id"] for r in catalog.page_of_directory(df, directory, no).collect()]
        assert got == sorted(ids)[64 * no : 64 * no + 64]
    links = catalog.product_urls(df, F.lit(True), batch_no=15, domain="d", directory=directory)
    assert [r["id"] for r in links.collect()] == sorted(ids)[960:]
    assert catalog.page_directory(df.where("id > 5000"), 10).count() == 0
    with pytest.raises(ValueError, match="at least one row"):
        catalog.page_directory(df, 0)
    with pytest.raises(ValueError, match="not be negative"):
        catalog.page_of_directory(df, directory, -1)


def test_a_deep_page_reads_its_key_range_alone(spark, tmp_path):
    spark.range(1000).selectExpr("id", "CAST(id AS STRING) AS main_image").write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")
    page = catalog.page_of_directory(df, catalog.page_directory(df, 100), 7)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,700)" in plan and "LessThanOrEqual(id,799)" in plan
