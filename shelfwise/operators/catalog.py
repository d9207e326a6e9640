"""Product catalog: pages, ids and image links by a caller's predicate."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import image_url
from shelfwise.operators.indexing import dense_index
from shelfwise.operators.similarity import among
from shelfwise.session import materialize


def matching(products: DataFrame, condition: Column | str | None = None) -> DataFrame:
    """Rows that satisfy ``condition``, a Column or SQL text. Without one, no row does."""
    if condition is None:
        return products.where(F.lit(False))
    return products.where(F.expr(condition) if isinstance(condition, str) else condition)


def page(rows: DataFrame, limit: int, batch_no: int) -> DataFrame:
    """Page ``batch_no`` of ``limit`` rows by ascending ``id``, so pages never overlap.

    One ordered plan for every position. Far down the sorted rows before the page are passed over, so a sweep is better
    done with a ``page_directory`` or ``page_after``, whose key ranges are pushed to the scan, or at once with
    ``page_numbers``.
    """
    if limit < 0 or batch_no < 0:
        raise ValueError("limit and batch_no must not be negative")
    return rows.orderBy("id").offset(batch_no * limit).limit(limit)


def page_after(rows: DataFrame, last_id: int | None, limit: int) -> DataFrame:
    """The ``limit`` rows that follow ``last_id`` by ascending ``id``; the first page without one."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return (rows if last_id is None else rows.where(F.col("id") > last_id)).orderBy("id").limit(limit)


def page_numbers(rows: DataFrame, limit: int) -> DataFrame:
    """Every row with its ``batch_no``: all pages of a sweep at once instead of one query per page."""
    numbered, _, _ = dense_index(rows, ["id"], "_row")
    return numbered.withColumn("batch_no", F.floor(F.col("_row") / limit)).drop("_row")


def page_directory(rows: DataFrame, limit: int) -> DataFrame:
    """``(batch_no, first_id, last_id, n_rows)`` of every page of a sweep, stored once for all its pages.

    Ids are unique and not NULL. One range-partitioned sort of the ids alone; a page is then a key range, see
    ``page_of_directory``.
    """
    if limit < 1:
        raise ValueError("a page of a directory has at least one row")
    pages = page_numbers(rows.select("id"), limit).groupBy("batch_no")
    found = pages.agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n_rows"))
    return materialize(found, "page-directory")


def page_of_directory(rows: DataFrame, directory: DataFrame, batch_no: int) -> DataFrame:
    """Page ``batch_no`` by its key range, which is pushed to the scan: no row outside the page is sorted, however far
    down it is. Rows that came after the directory was made join the page whose range they fall into."""
    if batch_no < 0:
        raise ValueError("batch_no must not be negative")
    found = directory.where(F.col("batch_no") == batch_no).first()
    if found is None:
        return rows.limit(0)
    return rows.where(F.col("id").between(found["first_id"], found["last_id"])).orderBy("id")


def _one_page(rows: DataFrame, limit: int, batch_no: int, directory: DataFrame | None) -> DataFrame:
    return page(rows, limit, batch_no) if directory is None else page_of_directory(rows, directory, batch_no)


def product_page(
    products: DataFrame, condition: Column | str | None = None, limit: int = 500, batch_no: int = 0,
    domain: str | None = None, directory: DataFrame | None = None,
) -> DataFrame:
    """``(id, image_url, status, primary_category_id, secondary_category_id)`` of one page.

    With a ``directory`` of the same condition the page is a key range and ``limit`` is the directory's.
    """
    columns = ["id", "main_image", "status", "primary_category_id", "secondary_category_id"]
    rows = _one_page(matching(products, condition).select(*columns), limit, batch_no, directory)
    return rows.select(
        "id", _url(domain), "status", "primary_category_id", "secondary_category_id"
    )


def product_urls(
    products: DataFrame, condition: Column | str | None = None, limit: int = 5000, batch_no: int = 0,
    domain: str | None = None, directory: DataFrame | None = None,
) -> DataFrame:
    """``(id, image_url)`` of one page; ``directory`` as for ``product_page``."""
    rows = _one_page(matching(products, condition).select("id", "main_image"), limit, batch_no, directory)
    return rows.select("id", _url(domain))


def product_ids(products: DataFrame, condition: Column | str | None = None) -> DataFrame:
    """Ids that satisfy ``condition``."""
    return matching(products, condition).select("id")


def all_product_ids(products: DataFrame) -> DataFrame:
    return products.select("id")


def product_links(products: DataFrame, ids: Iterable[int] | DataFrame, domain: str | None = None) -> DataFrame:
    """``(id, image_url)`` of the listed products."""
    return among(products, ids).select("id", _url(domain))


def _url(domain: str | None) -> Column:
    return image_url(F.col("main_image"), domain).alias("image_url")
