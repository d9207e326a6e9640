"""Command line of a whole run, for spark-submit or ``python -m shelfwise``."""

from __future__ import annotations

import argparse
import json
from datetime import datetime

from pyspark.sql import SparkSession

from shelfwise.config import RunConfig
from shelfwise.plans.recommend import run
from shelfwise.session import clear
from shelfwise.sources.tables import BehaviourLogs


def save_target(args: argparse.Namespace) -> dict | None:
    """Connection options named on the command line."""
    given = {"url": args.save_url, "table": args.save_table, "driver": args.save_driver, "user": args.save_user}
    return {k: v for k, v in given.items() if v} if args.save_url else None


def behaviour_logs(spark: SparkSession, args: argparse.Namespace) -> BehaviourLogs:
    """The logs from files, or from a database where a URL is given; a JSON file may hold casts, or settings by table."""
    by_table = {}
    if args.logs_tables:
        with open(args.logs_tables, encoding="utf-8") as f:
            by_table = json.load(f)
    if not args.logs_url:
        return BehaviourLogs.from_files(spark, args.logs, args.format, {k: v.get("casts", {}) for k, v in by_table.items()})
    given = {"driver": args.logs_driver, "user": args.logs_user}
    return BehaviourLogs.from_jdbc(spark, args.logs_url, by_table, **{k: v for k, v in given.items() if v})


def main(argv: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="shelfwise", description="Behaviour logs to ranked products per member.")
    parser.add_argument("config", help="flat JSON file of settings")
    origin = parser.add_mutually_exclusive_group(required=True)
    origin.add_argument("--logs", help="folder with the four log tables")
    origin.add_argument("--logs-url", help="JDBC URL of a database that holds the four log tables")
    parser.add_argument("--logs-driver", help="JDBC driver class for the logs")
    parser.add_argument("--logs-user", help="database user for the logs; the driver reads the password")
    parser.add_argument("--logs-tables", help="JSON file of settings by log table: table, partition_column, casts, ...")
    parser.add_argument("--format", default="parquet", choices=("parquet", "csv"), help="file format of the logs")
    parser.add_argument("--results", required=True, help="folder for the CSV result")
    parser.add_argument("--snapshots", help="folder of dated interaction snapshots to read through")
    parser.add_argument("--as-of", type=datetime.fromisoformat, help="end of the look-back window (default: now)")
    parser.add_argument("--mode", default="strict", choices=("strict", "pad"))
    parser.add_argument("--save-url", help="JDBC URL for the recommendations table, used if save_to_db is set")
    parser.add_argument("--save-table", help="name of that table")
    parser.add_argument("--save-driver", help="JDBC driver class")
    parser.add_argument("--save-user", help="database user; the password is read from the environment by the driver")
    parser.add_argument("--ledger", help="stored table of runs to enter this one in")
    args = parser.parse_args(argv)

    cfg = RunConfig.load(args.config)
    spark = SparkSession.builder.appName("shelfwise").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    result = run(
        behaviour_logs(spark, args),
        cfg,
        args.as_of,
        args.snapshots,
        args.results,
        save_target(args),
        args.mode,
        args.ledger,
    )
    print(json.dumps(result.report, default=str))
    clear(spark)
    return result.report


if __name__ == "__main__":
    main()
