"""What the operators of this package share: table reading, scratch tables, text chunks, connected components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

import shelfwise
from shelfwise.session import shared_root

# A Python task looks at this many bytes of text at a time, so its memory follows the longest text only.
CHUNK_BYTES = 1 << 20

# Rows that Spark hands to a Python task at a time, unless the session sets a number of its own.
BATCH_ROWS = 1000

# Links that one task of a round of ``components`` takes, where there are more than the cores can share.
LINKS_PER_TASK = 500_000

# The white space that separates words everywhere in this package.
SPACES = " \t\n\x0b\x0c\r"


_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, wherever they have been started."""
    sc = spark.sparkContext
    # Batches of whole documents: at the default of 10,000 rows one fills tens of megabytes on both sides of a task.
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if sc.applicationId not in _shipped:
        root = Path(shelfwise.__file__).parent
        # The driver's own copy stays as long as the process: Spark hands it to executors that start late.
        folder = tempfile.TemporaryDirectory(prefix="shelfwise-package-")
        path = f"{folder.name}/shelfwise-package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, f"{root.name}/{file.relative_to(root)}")
        sc.addPyFile(path)
        _shipped[sc.applicationId] = folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so other columns may have any name; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


class Scratch:
    """Tables in the shared folder that cut lineage; ``drop`` deletes those that are no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.saved = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back: a lost executor costs a re-read and no re-run."""
        path = f"{self.root}/{name}-{self.saved}"
        self.saved += 1
        # Texts take a quarter less room in this than in Spark's default.
        df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict]:
        """``save``, and the ``figures`` (aggregates) of the rows, taken as they are written: no query more for them."""
        seen = Observation()
        table = self.save(df.observe(seen, *[c.alias(k) for k, c in figures.items()]), name)
        return table, seen.get

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.paths.pop(name))

    def clear(self) -> None:
        """Deletes all tables, once nothing reads one of them any more."""
        self.paths.clear()
        self._delete(self.root)

    def _delete(self, place: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more; called between large steps.

    The first collection frees the plans, the second the shuffles that only they held. Executors collect as well: a heap
    that one step has filled is otherwise kept whole, beside the Python workers of the next.
    """
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.5)
    gc.collect()
    spark._jvm.System.gc()
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return  # the driver is the executor
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def lean(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``; at its end the Python worker hands free memory back to the system.

    Spark keeps workers for later tasks, and what their allocators hold on to stays beside the next stage's heap.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library than glibc
            pass

    return wrapped


def text_chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``most`` bytes in ``column``, or one row."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if len(sizes) > start:
        yield batch.slice(start)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows ``(node, root)`` for every node of the undirected ``links (a, b)``; the root is the smallest node reached.

    Large-star and small-star steps in turn: every step keeps at most one edge per edge or node, and the number of
    rounds follows the logarithm of the longest path. Each round is a written table, and one query. Its tasks follow the
    number of links and the cores, not the shuffle partitions: the driver keeps a record of every task that has run.
    """
    slots = scratch.spark.sparkContext.defaultParallelism
    # Every table has the larger node first, so links that are stars around their smallest nodes end after one round.
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    figures = {"n": F.count(F.lit(1)), "s": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    edges, mark = scratch.counted(links, "links", **figures)
    saved = ["links"]
    for step in range(100):
        tasks = max(slots, -(-mark["n"] // LINKS_PER_TASK))
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
        name = f"edges-{step}"
        edges, seen = scratch.counted(
            small.where("u <> v").coalesce(tasks).distinct().coalesce(tasks).select(F.col("u").alias("a"), F.col("v").alias("b")),
            name, **figures,
        )
        scratch.drop(*saved)
        saved = [name]
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
