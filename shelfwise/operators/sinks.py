"""Write recommendations: one row per member, ids comma-joined in rank order."""

from __future__ import annotations

import logging
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfwise.functions.columns import join_ids

log = logging.getLogger(__name__)

TABLE = "recommendations"
_JDBC_TYPES = {"postgres": "jdbc:postgresql:", "mysql": "jdbc:mysql:"}


def item_lists(recommendations: DataFrame, member: str = "member_id", product: str = "product_id") -> DataFrame:
    """``(member, items)``: the at most n products of a member as an array in rank order."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", product)))
    return recommendations.groupBy(member).agg(ranked.getField(product).alias("items"))


def wide_results(recommendations: DataFrame, member: str = "member_id", product: str = "product_id") -> DataFrame:
    """``(user_id, recommended_items)`` with the items as comma-joined text."""
    lists = item_lists(recommendations, member, product)
    return lists.select(F.col(member).alias("user_id"), join_ids(F.col("items")).alias("recommended_items"))


def recommendation_rows(recommendations: DataFrame, created_at: datetime | None = None) -> DataFrame:
    """``(member_id, product_ids, created_at)``, one row per member; ``created_at`` is now unless given."""
    stamp = F.current_timestamp() if created_at is None else F.lit(created_at.isoformat(" ")).cast("timestamp")
    lists = item_lists(recommendations)
    return lists.select("member_id", join_ids(F.col("items")).alias("product_ids"), stamp.alias("created_at"))


def write_csv(recommendations: DataFrame, path: str) -> None:
    """Result files with a header, replacing what is at ``path``."""
    wide_results(recommendations).write.mode("overwrite").option("header", True).csv(path)


def jdbc_write_options(db_type: str, url: str, table: str = TABLE, batch_size: int = 1000, **extra: str) -> dict:
    """Options of an append over JDBC; rows go out in batches of ``batch_size``."""
    if db_type not in _JDBC_TYPES:
        raise ValueError(f"unsupported database type: {db_type}")
    if not url.startswith(_JDBC_TYPES[db_type]):
        raise ValueError(f"a {db_type} URL starts with {_JDBC_TYPES[db_type]}")
    return {"url": url, "dbtable": table, "batchsize": str(batch_size), **extra}


def save_options(target: str, **where: str) -> dict:
    """Options of the append to ``target``; an unknown target, a missing path or a wrong URL is an error."""
    if target == "parquet":
        if "path" not in where:
            raise ValueError("a parquet target needs a path")
        return {"path": where["path"]}
    return jdbc_write_options(target, **where)


def save_recommendations(
    recommendations: DataFrame, target: str, created_at: datetime | None = None, **where: str
) -> dict:
    """Append to the ``recommendations`` table and report ``{table_name, record_count, status}``.

    ``target`` is ``"parquet"`` (with ``path=``), ``"postgres"`` or ``"mysql"`` (with ``url=`` and driver
    options); anything else is an error at once. A failing write gives ``{status: "error", error}``.
    """
    options = save_options(target, **where)
    written = Observation(TABLE)
    rows = recommendation_rows(recommendations, created_at).observe(written, F.count(F.lit(1)).alias("n"))
    writer = rows.write.mode("append").format("parquet" if target == "parquet" else "jdbc").options(**options)
    try:
        writer.save()
    except (PySparkException, Py4JJavaError) as e:
        log.error("recommendations could not be saved: %s", e)
        return {"status": "error", "error": str(e)}
    return {"table_name": TABLE, "record_count": written.get["n"], "status": "success"}
