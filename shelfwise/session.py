"""Shared-storage tables that cut lineage, and joins that stay level when one key is hot."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup side is broadcast only when its counted rows, times the size of a row, stay below this.
BROADCAST_BYTES = 16 << 20
ROW_BYTES = 64
# A key with more rows than this is spread over as many partitions as it holds this number of rows.
ROWS_PER_TASK = 2_000_000

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, which all executors must reach.

    Only a local session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_roots.setdefault(sc.applicationId, "")
        if not root:
            root = _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="shelfwise-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/shelfwise/{sc.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Lineage ends there, so a lost executor costs a re-read and not a re-run, values such as partition
    positions are fixed, and later readers prune columns and know the table's size.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; call it when its results are no longer read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    """Tasks worth planning for; a starting cluster may still report few cores, hence the second term."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fits_broadcast(rows: int, row_bytes: int = ROW_BYTES) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def lookup_join(
    facts: DataFrame, dim: DataFrame, on: list[str], load: str, dim_rows: int, total: int, row_bytes: int = ROW_BYTES
) -> DataFrame:
    """Inner join of ``facts`` to ``dim``, whose key ``on`` is unique, level even if one key holds most facts.

    ``load`` is the column of ``dim`` with the number of fact rows of the key, ``total`` their sum and
    ``dim_rows`` the counted rows of ``dim``. A small ``dim`` is broadcast, else see ``spread_join``.
    """
    if fits_broadcast(dim_rows, row_bytes):
        return facts.join(F.broadcast(dim.drop(load)), on)
    return spread_join(facts, dim, on, load, total)


def spread_join(facts: DataFrame, dim: DataFrame, on: list[str], load: str, total: int) -> DataFrame:
    """``lookup_join`` by a shuffle, however small ``dim`` is, so its rows do not pass through the driver.

    A key with more than ``ROWS_PER_TASK`` facts is spread over ``ceil(load / ROWS_PER_TASK)`` partitions, and all others
    are joined as usual. There are at most ``total / ROWS_PER_TASK`` such keys; the number grows with ``total`` where
    their table, which goes to every task, would pass ``BROADCAST_BYTES``.
    """
    most = max(ROWS_PER_TASK, -(-total * ROW_BYTES // max(1, BROADCAST_BYTES)))
    salts = F.ceil(F.col(load) / most).cast("int")
    hot = dim.where(F.col(load) > most).select(*on, salts.alias("_salts"))
    salted_dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop(load)
    drawn = F.pmod(F.xxhash64(*[F.col(c) for c in facts.columns]), F.col("_salts")).cast("int")
    salted_facts = (
        facts.join(F.broadcast(hot), on, "left").withColumn("_salt", F.coalesce(drawn, F.lit(0))).drop("_salts")
    )
    return salted_facts.join(salted_dim, [*on, "_salt"]).drop("_salt")
