"""Dense integer indices for members and products, as ALS wants them."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import fits_broadcast, lookup_join, materialize

MAX_INDEX = 2**31 - 1


@dataclass(frozen=True)
class IndexTable:
    """``df`` holds ``(id_col, idx_col, n_rows)`` with ``n_rows`` interactions per id; both columns are unique."""

    df: DataFrame
    id_col: str
    idx_col: str
    size: int
    total_rows: int

    def attach_index(self, facts: DataFrame) -> DataFrame:
        """Id to index for a table of interactions; rows with an unknown id drop out."""
        return lookup_join(facts, self.df, [self.id_col], "n_rows", self.size, self.total_rows)

    def attach_id(self, facts: DataFrame) -> DataFrame:
        """Index to id. ``facts`` may hold any number of rows per index and is counted if the table is large."""
        names = self.df.select(self.idx_col, self.id_col)
        if fits_broadcast(self.size):
            return facts.join(F.broadcast(names), self.idx_col)
        load = facts.groupBy(self.idx_col).agg(F.count(F.lit(1)).alias("n_rows"))
        return lookup_join(
            facts, names.join(load, self.idx_col), [self.idx_col], "n_rows", self.size, facts.count()
        )


def dense_index(
    keys: DataFrame, order: list[str], idx_col: str, weight: str | None = None
) -> tuple[DataFrame, int, int]:
    """Number the rows of ``keys`` 0, 1, 2, ... by ``order``, which must be unique.

    Returns the numbered rows, their count and the sum of their ``weight`` column.

    The rows are range-partitioned, sorted within partitions and written with their place in the
    partition; the start of each partition is a running sum over one count per partition. No step puts
    all rows into one task, and only the partition counts reach the driver.
    """
    spot = F.monotonically_increasing_id()
    placed = (
        keys.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.shiftright(spot, 33).cast("int"))
        .withColumn("_pos", spot.bitwiseAND(F.lit((1 << 33) - 1)))
    )
    placed = materialize(placed, idx_col)
    total = F.sum(weight) if weight else F.lit(0)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), total.alias("w")).collect()
    counts = sorted(counts, key=lambda r: r["_part"])
    ends = list(accumulate(r["n"] for r in counts))
    size = ends[-1] if ends else 0
    starts = [(r["_part"], end - r["n"]) for r, end in zip(counts, ends)]
    offsets = keys.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    indexed = placed.join(F.broadcast(offsets), "_part").withColumn(idx_col, F.col("_start") + F.col("_pos"))
    return indexed.drop("_part", "_pos", "_start"), size, sum(r["w"] for r in counts)


def _as_table(keys: DataFrame, order: list[str], id_col: str, idx_col: str) -> IndexTable:
    indexed, size, total = dense_index(keys, order, idx_col, "n_rows")
    if size > MAX_INDEX:
        raise ValueError(f"{size} distinct values of {id_col} exceed the integer range of ALS ids")
    df = indexed.select(id_col, F.col(idx_col).cast("int").alias(idx_col), "n_rows")
    return IndexTable(df, id_col, idx_col, size, total)


def user_index(interactions: DataFrame) -> IndexTable:
    """Members numbered by ascending id, which is their order of first appearance in the sorted set."""
    keys = interactions.groupBy("member_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return _as_table(keys, ["member_id"], "member_id", "user_idx")


def item_index(interactions: DataFrame) -> IndexTable:
    """Products numbered by first appearance in the sorted set: by smallest member, then product."""
    keys = interactions.groupBy("product_id").agg(
        F.min("member_id").alias("first_member"), F.count(F.lit(1)).alias("n_rows")
    )
    return _as_table(keys, ["first_member", "product_id"], "product_id", "item_idx")
