"""Small files and folders of the shared storage, by way of the session's own file systems."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, place = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _place(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new file; False, and nothing written, if it is there already."""
    fs, place = _place(spark, path)
    try:
        stream = fs.create(place, False)
    except Py4JJavaError as e:
        if fs.exists(place):
            return False
        raise e
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.delete(place, True)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, modified)`` of every file below a folder. No file is opened, and Spark lists large trees by
    a job of its own."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def fingerprint(spark: SparkSession, path: str) -> str:
    """Short text that changes when a file below ``path`` is added, removed, renamed or written anew."""
    row = F.xxhash64("path", "length", "modified").cast("decimal(38,0)")
    seen = listing(spark, path).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.sum(row).alias("sum")
    ).first()
    return f"{seen['n']} files, {seen['bytes']} bytes, {seen['sum'] or 0}"
