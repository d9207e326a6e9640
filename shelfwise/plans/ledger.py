"""A stored table of runs, one row each: what was asked, what came of it, and where it went."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, LongType, StringType, StructType, TimestampType

RUNNING, DONE, FAILED, NOT_SAVED = "running", "success", "failed", "not saved"

LEDGER = StructType()
for _name in ("run_id", "status", "error", "as_of", "mode", "settings"):
    LEDGER.add(_name, StringType())
for _name in ("started_at", "finished_at"):
    LEDGER.add(_name, TimestampType())
COUNTS = ("n_interactions", "n_users", "n_items", "n_train", "n_test", "n_recommended", "n_without_factors", "n_saved")
for _name in COUNTS:
    LEDGER.add(_name, LongType())
for _name in ("mae", "rmse"):
    LEDGER.add(_name, DoubleType())
for _name in ("results_path", "saved_to"):
    LEDGER.add(_name, StringType())


class Ledger:
    """Appends to the ledger at ``path``: a row when the run begins and one when it ends, both of its ``run_id``.

    A run that dies without a word leaves its first row, so it shows as running. ``runs`` gives one row per run.
    """

    def __init__(self, spark: SparkSession, path: str, settings: dict, mode: str):
        self.spark, self.path = spark, path
        self.row = dict.fromkeys(LEDGER.names) | {
            "run_id": uuid.uuid4().hex, "started_at": datetime.now(timezone.utc), "mode": mode,
            "settings": json.dumps(settings, sort_keys=True),
        }
        self._append(RUNNING)

    def _append(self, status: str) -> None:
        row = self.row | {"status": status}
        self.spark.createDataFrame([tuple(row[n] for n in LEDGER.names)], LEDGER).coalesce(1).write.mode("append").parquet(self.path)

    def finish(self, report: dict, results_path: str | None) -> None:
        """Enter the counts of a finished run. A failing save of its rows is the run's status, with the reason."""
        found, split, saved = report["interactions"], report["split"], report.get("saved")
        metrics = report.get("metrics") or {}
        self.row |= {
            "finished_at": datetime.now(timezone.utc), "as_of": report["as_of"], "results_path": results_path, **found,
            "n_train": split["train"], "n_test": split["test"], "n_recommended": report["users_recommended"],
            "n_without_factors": report["users_without_factors"], "mae": metrics.get("mae"), "rmse": metrics.get("rmse"),
        }
        failed = saved is not None and saved["status"] != "success"
        if saved is not None:
            self.row |= {"n_saved": saved.get("record_count"), "saved_to": saved.get("table_name"), "error": saved.get("error")}
        self._append(NOT_SAVED if failed else DONE)

    def fail(self, error: BaseException) -> None:
        self.row |= {"finished_at": datetime.now(timezone.utc), "error": f"{type(error).__name__}: {error}"[:4000]}
        self._append(FAILED)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per run: its last one. Each run has two, so they are told apart without a window over the table."""
    entries = spark.read.schema(LEDGER).parquet(path)
    ended = entries.where(f"status <> '{RUNNING}'")
    open_ = entries.where(f"status = '{RUNNING}'").join(ended.select("run_id"), "run_id", "left_anti")
    return ended.unionByName(open_.select(*LEDGER.names))
