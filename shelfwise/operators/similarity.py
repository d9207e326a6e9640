"""Product similarity on ``(id, status, primary_category_id, secondary_category_id, image_vector)``.

The distance is the negative inner product, whatever the length of the vectors. A product without a
vector is ranked last with a NULL distance; ties go to the lower id. Vectors of unequal length are an error.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.vectors import has_bad_element, parse_vector
from shelfwise.operators.topk import block_top_k, nearest_to

ON_SALE = "SALE"
_INLINE_IDS = 1000


def id_frame(like: DataFrame, ids: Iterable[int] | DataFrame) -> DataFrame:
    """Distinct, non-NULL ids as a one-column DataFrame ``id``."""
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).cast("bigint").alias("id")).dropna().distinct()
    listed = list(ids)
    if any(i is None for i in listed):
        raise ValueError("an id list must not hold NULL")
    return like.sparkSession.createDataFrame([(int(i),) for i in sorted(set(listed))], "id bigint")


def among(df: DataFrame, ids: Iterable[int] | DataFrame) -> DataFrame:
    """Rows whose ``id`` is listed. A short list becomes a pushed-down filter, a long one a semi join."""
    if not isinstance(ids, DataFrame):
        ids = list(ids)
        if len(ids) <= _INLINE_IDS and None not in ids:
            return df.where(F.col("id").isin([int(i) for i in ids]))
    return df.join(id_frame(df, ids), "id", "left_semi")


def excluding(df: DataFrame, ids: Iterable[int] | DataFrame | None) -> DataFrame:
    """Rows whose ``id`` is known and not listed, however long the list; no list keeps every row."""
    if ids is None:
        return df
    if not isinstance(ids, DataFrame):
        ids = list(ids)
        if not ids:
            return df
        if len(ids) <= _INLINE_IDS and None not in ids:
            return df.where(F.col("id").isNotNull() & ~F.col("id").isin([int(i) for i in ids]))
    return df.where(F.col("id").isNotNull()).join(id_frame(df, ids), "id", "left_anti")


def similar_products(
    products: DataFrame, product_ids: Iterable[int] | DataFrame | None = None, top_k: int = 100
) -> DataFrame:
    """``(product_id, similar_id, distance, rank)``: nearest on-sale products with the same two categories.

    ``product_ids`` limits the queries, whose own status does not matter; None asks for every product.
    A NULL category matches nothing.
    """
    queries = products if product_ids is None else among(products, product_ids)
    on_sale = products.where(F.col("status") == ON_SALE)
    found = block_top_k(_grouped(queries), _grouped(on_sale), top_k, skip_self=True)
    return found.select(
        F.col("qid").alias("product_id"), F.col("cid").alias("similar_id"), _distance().alias("distance"), "rank"
    )


def similar_to(products: DataFrame, product_id: int, top_k: int = 100) -> DataFrame:
    """``(id, distance)`` of the products nearest to one product, of any status or category.

    Empty when the product is unknown.
    """
    row = products.where(F.col("id") == product_id).select("image_vector").first()
    others = products.where(F.col("id") != product_id)
    if row is None:
        return products.sparkSession.createDataFrame([], "id bigint, distance double")
    return nearest_to(_plain(others), row["image_vector"], top_k)


def search_by_vector(
    products: DataFrame, query_vector: Iterable[float] | str, top_k: int = 100, exclude_ids: Iterable[int] | None = None
) -> DataFrame:
    """``(id, distance)`` of the on-sale products nearest to a free vector; ``exclude_ids`` are left out.

    The vector may be given as text, such as ``"[1,2.5]"``; an element that is no number is an error.
    """
    if isinstance(query_vector, str):
        parsed = parse_vector(F.lit(query_vector))
        row = products.sparkSession.range(1).select(parsed.alias("v"), has_bad_element(parsed).alias("bad")).first()
        if row["bad"]:
            raise ValueError("the query vector has a non-numeric element")
        query_vector = row["v"]
    candidates = excluding(products.where(F.col("status") == ON_SALE), exclude_ids)
    return nearest_to(_plain(candidates), [float(x) for x in query_vector], top_k)


def search_by_vectors(
    products: DataFrame, queries: DataFrame, top_k: int = 100, exclude_ids: Iterable[int] | DataFrame | None = None
) -> DataFrame:
    """``search_by_vector`` for a table of queries ``(query_id, vector)``: ``(query_id, id, distance, rank)``."""
    candidates = excluding(products.where(F.col("status") == ON_SALE), exclude_ids)
    asked = queries.select(F.col("query_id").alias("id"), F.col("query_id").alias("label"), "vector")
    found = block_top_k(asked, _plain(candidates), top_k)
    return found.select(
        F.col("qid").alias("query_id"), F.col("cid").alias("id"), _distance().alias("distance"), "rank"
    )


def product_vector(products: DataFrame, product_id: int) -> list[float] | None:
    """Vector of one product, or None."""
    row = products.where(F.col("id") == product_id).select("image_vector").first()
    return row["image_vector"] if row else None


def product_vectors(products: DataFrame, product_ids: Iterable[int] | DataFrame) -> DataFrame:
    """``(id, image_vector)`` of the listed products; unknown ids have no row."""
    return among(products, product_ids).select("id", "image_vector")


def similar_lists(similar: DataFrame) -> DataFrame:
    """``(product_id, similar_ids)``: the at most top-k ids of a product in rank order."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "similar_id")))
    return similar.groupBy("product_id").agg(ranked.getField("similar_id").alias("similar_ids"))


def _plain(products: DataFrame) -> DataFrame:
    return products.select("id", F.col("id").alias("label"), F.col("image_vector").alias("vector"))


def _grouped(products: DataFrame) -> DataFrame:
    return products.select(
        F.col("primary_category_id").alias("g1"),
        F.col("secondary_category_id").alias("g2"),
        "id",
        F.col("id").alias("label"),
        F.col("image_vector").alias("vector"),
    )


def _distance():
    return F.lit(0.0) - F.col("score")
