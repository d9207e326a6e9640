"""Read the source tables from files or over JDBC, always by the contract of ``schemas``: every column has its declared
type, by a declared cast where it was stored otherwise, and rows that a cast cannot read are set aside."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from shelfwise.schemas import TABLES, by_contract
from shelfwise.sources import files

LOG_TABLES = ("product_impression", "product_view", "action_log", "purchased_product")


@dataclass(frozen=True)
class BehaviourLogs:
    """The four log tables an interaction set is built from."""

    product_impression: DataFrame
    product_view: DataFrame
    action_log: DataFrame
    purchased_product: DataFrame
    source: str = ""
    paths: tuple[str, ...] = ()

    def identity(self) -> str:
        """What tells these logs from others, as of now.

        Files: where they are, and a fingerprint of their names, sizes and times, so a file that is added, removed or
        written anew makes other logs. Databases: their address and tables. Frames of any other origin: their counts
        and the sums of their rows' hashes, at the price of a scan. All of it is worked out by Spark; the driver gets
        a line per table.
        """
        if self.paths:
            return "|".join([self.source, *(files.fingerprint(self.action_log.sparkSession, p) for p in self.paths)])
        if self.source:
            return self.source
        return "|".join(_content(getattr(self, name)) for name in LOG_TABLES)

    @classmethod
    def from_files(
        cls, spark: SparkSession, root: str, fmt: str = "parquet", casts: dict[str, dict[str, str]] | None = None
    ) -> BehaviourLogs:
        """The four log tables below ``root``; ``casts[name]`` declares casts of table ``name``."""
        found = {n: read_table(spark, f"{root}/{n}", n, fmt, (casts or {}).get(n)) for n in LOG_TABLES}
        paths = tuple(f"{root}/{name}" for name in LOG_TABLES)
        return cls(**found, source=f"{fmt}:{root} {sorted((casts or {}).items())}", paths=paths)

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, tables: dict[str, dict] | None = None, **options) -> BehaviourLogs:
        """The four log tables of a database. ``options`` hold for all, ``tables[name]`` for one, such as the column and
        bounds of a partitioned scan, another ``table`` name, or ``casts``."""
        tables = tables or {}
        found = {
            name: read_jdbc(spark, name, **{"url": url, "table": name, **options, **tables.get(name, {})})
            for name in LOG_TABLES
        }
        return cls(**found, source=f"{url} {sorted(tables.items())}")


def _content(df: DataFrame) -> str:
    row = F.xxhash64(*df.columns).cast("decimal(38,0)")
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("sum")).first()
    return f"{df.schema.simpleString()} {seen['n']} {seen['sum'] or 0}"


def read_table(
    spark: SparkSession, path: str, name: str, fmt: str = "parquet", casts: dict[str, str] | None = None
) -> DataFrame:
    """Table ``name`` of ``schemas.TABLES`` from parquet or CSV files, without the rows that ``read_parted`` sets aside."""
    return read_parted(spark, path, name, fmt, casts)[0]


def read_parted(
    spark: SparkSession, path: str, name: str, fmt: str = "parquet", casts: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows of a table that fit its schema, and those set aside; see ``schemas.by_contract``.

    CSV is text, so every column of another type has a cast; ``casts`` may name a pattern of times instead.
    """
    schema = TABLES[name]
    if fmt == "parquet":
        return by_contract(spark.read.parquet(path), schema, name, casts)
    if fmt == "csv":
        text = StructType([StructField(f.name, StringType()) for f in schema.fields])
        every = {f.name: "cast" for f in schema.fields if f.dataType != StringType()}
        return by_contract(spark.read.schema(text).option("header", True).csv(path), schema, name, every | (casts or {}))
    raise ValueError(f"unsupported file format: {fmt}")


def jdbc_read_options(
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: int | str | None = None,
    upper: int | str | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
    **extra: str,
) -> dict[str, str]:
    """Options of a JDBC scan; with a partition column the table is read in parallel key ranges."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **extra}
    if partition_column is not None:
        if lower is None or upper is None or partitions is None:
            raise ValueError("a partitioned JDBC scan needs lower, upper and partitions")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, name: str, casts: dict[str, str] | None = None, **options) -> DataFrame:
    """Scan table ``name`` over JDBC by the contract. Filters and column choices made later are sent to the database.

    A vector column arrives as text and becomes an array; rows whose vector does not parse are left out.
    """
    schema = TABLES[name]
    vectors = {f.name: "cast" for f in schema.fields if isinstance(f.dataType, ArrayType)}
    df = spark.read.format("jdbc").options(**jdbc_read_options(**options)).load()
    return by_contract(df, schema, name, vectors | (casts or {}))[0]
