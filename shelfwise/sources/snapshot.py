"""Dated snapshot of the interaction set: read it if it is there, else build and keep it."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from shelfwise.config import RunConfig
from shelfwise.schemas import INTERACTIONS, require_types
from shelfwise.session import materialize

log = logging.getLogger(__name__)


def snapshot_path(root: str, cfg: RunConfig, as_of: datetime, source: str = "") -> str:
    """Folder of the snapshot for these settings, this moment and the logs known as ``source``."""
    return f"{root.rstrip('/')}/as_of_date={as_of:%Y%m%d}/days={cfg.days}/{cfg.snapshot_key(as_of, source)}"


def is_complete(spark: SparkSession, path: str) -> bool:
    """A finished Spark write leaves a ``_SUCCESS`` marker; a half-written folder has none."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_through(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Interactions from ``path`` if a complete snapshot is there, else from ``build()``, then kept at ``path``.

    An unreadable snapshot is reported and built again. A failing write is reported too and the
    run goes on with an intermediate table. NULL ids are dropped on every way.
    """
    ids = ["member_id", "product_id"]
    try:
        if is_complete(spark, path):
            cached = require_types(spark.read.parquet(path), INTERACTIONS, path)
            cached.first()
            return cached.dropna(subset=ids)
    except (PySparkException, Py4JJavaError, ValueError) as e:
        log.warning("snapshot %s cannot be read and is built again: %s", path, e)
    fresh = build().select(*INTERACTIONS.names).dropna(subset=ids)
    try:
        fresh.write.mode("overwrite").parquet(path)
        return spark.read.schema(INTERACTIONS).parquet(path)
    except (PySparkException, Py4JJavaError) as e:
        log.warning("snapshot %s cannot be written: %s", path, e)
        return materialize(fresh, "interactions")
