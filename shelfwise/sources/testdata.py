"""The engine's source tables as views of the generated star-schema test tables.

All rows of a test table take part. Attributes the tables lack, such as a product's status, are derived
from the values of each row.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.config import Thresholds
from shelfwise.session import materialize
from shelfwise.sources.tables import BehaviourLogs

EVENTS_AS_OF = datetime(2024, 1, 31)
EVENTS_DAYS = 10
ORDERS_AS_OF = datetime(2002, 1, 1)
ORDERS_DAYS = 4000
LOW_TIERS = Thresholds(view=(1, 2, 3), impression=(1, 2, 3))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_logs(spark: SparkSession, sf_dir: str) -> BehaviourLogs:
    """``events``: views, clicks as impressions, sign-ups as likes, errors as cart puts, purchases."""
    events = table(spark, sf_dir, "events")
    member = F.col("user_id").cast("string")
    product = F.get_json_object("props", "$.k")
    pair = (member.alias("member_id"), product.alias("product_id"))
    created = F.col("ts").alias("created_at")
    kind = F.col("event_type")
    event_name = F.when(kind == "signup", "LikedEvent").when(kind == "error", "CartItemPutEvent").otherwise(kind)
    return BehaviourLogs(
        product_impression=events.where(kind == "click").select(*pair, created),
        product_view=events.where(kind == "view").select(F.col("event_id").alias("id"), *pair, created),
        action_log=events.where(kind.isin("signup", "error")).select(*pair, event_name.alias("event_name"), created),
        purchased_product=events.where(kind == "purchase").select(
            member.alias("customer_id"), product.alias("archived_id"), created
        ),
    )


def order_logs(spark: SparkSession, sf_dir: str) -> BehaviourLogs:
    """``orders`` and ``lineitem``, customers against suppliers: every line is a view; returned lines are
    impressions, accepted ones likes, the others cart puts; closed lines are purchases."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    # The four logs come from one join, stored with the columns they need.
    lines = materialize(
        lines.select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus", "o_custkey"),
        "order-lines",
    )
    pair = (F.col("o_custkey").alias("member_id"), F.col("l_suppkey").alias("product_id"))
    created = F.col("l_shipdate").alias("created_at")
    flag = F.col("l_returnflag")
    event_name = F.when(flag == "A", "LikedEvent").when(flag == "N", "CartItemPutEvent").otherwise("Returned")
    line_id = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return BehaviourLogs(
        product_impression=lines.where(flag == "R").select(*pair, created),
        product_view=lines.select(line_id.alias("id"), *pair, created),
        action_log=lines.select(*pair, event_name.alias("event_name"), created),
        purchased_product=lines.where(F.col("l_linestatus") == "F").select(
            pair[0].alias("customer_id"), pair[1].alias("archived_id"), created
        ),
    )


def large_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``purchased_product`` of customers against parts, one row per order line."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return lines.select(
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("archived_id"),
        F.col("o_orderdate").alias("created_at"),
    )


def product_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as products: label and two signs give the categories, two more the status."""
    vector = F.col("embedding")
    sold_out = (vector[0] < 0) & (vector[1] < 0)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(sold_out, "SOLD_OUT").otherwise("SALE").alias("status"),
        F.col("label").alias("primary_category_id"),
        ((vector[2] > 0).cast("int") + (vector[3] > 0).cast("int")).alias("secondary_category_id"),
        vector.alias("image_vector"),
    )


def product_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as a catalog: brand number and size are the categories; some types have no image file."""
    kind = F.col("p_type")
    image = (
        F.when(kind == "PROMO", F.lit(None).cast("string"))
        .when(kind == "SMALL", F.lit(""))
        .otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit(".jpg")))
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        image.alias("main_image"),
        F.when(F.col("p_retailprice") < 950, "SALE").otherwise("SOLD_OUT").alias("status"),
        F.substring("p_brand", 7, 3).cast("int").alias("primary_category_id"),
        F.col("p_size").alias("secondary_category_id"),
    )
