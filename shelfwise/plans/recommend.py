"""From behaviour logs to recommendations and their error, as one run."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame

from shelfwise.config import RunConfig
from shelfwise.operators import factors as als
from shelfwise.operators.evaluation import regression_metrics
from shelfwise.operators.indexing import IndexTable, item_index, user_index
from shelfwise.operators.interactions import build_interactions, interaction_type_counts
from shelfwise.operators.ranking import top_n_unseen
from shelfwise.operators.ratings import Split, split_or_all, to_ratings
from shelfwise.operators.sinks import save_options, save_recommendations, write_csv
from shelfwise.plans.ledger import Ledger
from shelfwise.session import materialize
from shelfwise.sources.snapshot import read_through, snapshot_path
from shelfwise.sources.tables import BehaviourLogs


@dataclass(frozen=True)
class Prepared:
    """Stored interactions and ratings with their two index tables."""

    interactions: DataFrame
    users: IndexTable
    items: IndexTable
    ratings: DataFrame


@dataclass(frozen=True)
class Trained:
    """A fitted model, its stored factors and the rows it was fitted on."""

    split: Split
    model: ALSModel
    user_factors: DataFrame
    item_factors: DataFrame
    block_loads: list[dict]


@dataclass(frozen=True)
class RunResult:
    recommendations: DataFrame
    metrics: DataFrame | None
    report: dict


def prepare(
    logs: BehaviourLogs, cfg: RunConfig, as_of: datetime, snapshot_root: str | None = None
) -> Prepared:
    """Interactions (from a snapshot, if there is one), indices and ratings."""
    spark = logs.action_log.sparkSession

    def build() -> DataFrame:
        return build_interactions(logs, as_of, cfg.days, cfg.interaction_thresholds, cfg.ignore_case)

    if snapshot_root is None:
        interactions = materialize(build(), "interactions")
    else:
        interactions = read_through(spark, snapshot_path(snapshot_root, cfg, as_of, logs.identity()), build)
    return index_and_rate(interactions, cfg)


def index_and_rate(interactions: DataFrame, cfg: RunConfig) -> Prepared:
    """Indices and ratings of stored interactions."""
    users, items = user_index(interactions), item_index(interactions)
    ratings = materialize(to_ratings(interactions, users, items, cfg.interaction_weights), "ratings")
    return Prepared(interactions, users, items, ratings)


def train(ratings: DataFrame, cfg: RunConfig) -> Trained:
    """Split and fit, after a look at what the fit's largest tasks will hold. The factors are stored: they are read by
    several later steps."""
    split = split_or_all(ratings, cfg.split_test_data, cfg.test_ratio, cfg.random_seed)
    loads = [r.asDict() for r in als.block_loads(split.train, cfg.als_blocks).collect()]
    als.check_loads(loads, cfg.als_block_rows)
    model = als.fit_als(split.train, cfg)
    return Trained(
        split,
        model,
        materialize(als.user_factors(model), "user_factors"),
        materialize(als.item_factors(model), "item_factors"),
        loads,
    )


def recommend(prepared: Prepared, trained: Trained, n: int, mode: str = "strict") -> DataFrame:
    """Top-n for every trained user: ``(user_idx, item_idx, member_id, product_id, rank, score)``.

    A member whose interactions all fell into the test rows has no factors and gets none.
    """
    return top_n_unseen(
        trained.user_factors,
        trained.item_factors,
        trained.split.train.select("user_idx", "item_idx"),
        n,
        mode,
        prepared.users,
        prepared.items,
    )


def evaluate(prepared: Prepared, trained: Trained) -> DataFrame | None:
    """``(n, mae, rmse)`` on the held-out rows, or None when nothing was held out."""
    if trained.split.test is None:
        return None
    predicted = als.predict_stored(
        trained.user_factors, trained.item_factors, trained.split.test, prepared.users, prepared.items
    )
    return regression_metrics(predicted)


def run(
    logs: BehaviourLogs,
    cfg: RunConfig,
    as_of: datetime | None = None,
    snapshot_root: str | None = None,
    results_path: str | None = None,
    save_to: dict | None = None,
    mode: str = "strict",
    ledger_path: str | None = None,
) -> RunResult:
    """The whole run. ``as_of`` is the end of the look-back window, unless given the start of the current day by Spark's
    clock in the session's zone: all runs of a day share their window, and so their snapshot.

    ``results_path`` receives the CSV result. With ``cfg.save_to_db`` the rows are also appended to the
    ``recommendations`` table of ``cfg.db_type``; ``save_to`` has the connection options, or
    ``{"target": "parquet", "path": ...}`` for a file table. ``ledger_path`` is a stored table of runs, see ``ledger``:
    this one is entered there, a failing one too.
    """
    ledger = None
    if ledger_path is not None:
        ledger = Ledger(logs.action_log.sparkSession, ledger_path, cfg.echo(), mode)
    try:
        result = _run(logs, cfg, as_of, snapshot_root, results_path, save_to, mode)
    except Exception as e:
        if ledger is not None:
            ledger.fail(e)
        raise
    if ledger is not None:
        ledger.finish(result.report, results_path)
    return result


def _run(
    logs: BehaviourLogs, cfg: RunConfig, as_of: datetime | None, snapshot_root: str | None, results_path: str | None,
    save_to: dict | None, mode: str,
) -> RunResult:
    if cfg.save_to_db:
        if save_to is None:
            raise ValueError("save_to_db is set but save_to names no target")
        save_to = {"target": cfg.db_type, **save_to}
        save_options(**save_to)
    if as_of is None:
        today = logs.action_log.sparkSession.sql("SELECT CAST(current_date() AS STRING) AS d").first()["d"]
        as_of = datetime.fromisoformat(today)
    prepared = prepare(logs, cfg, as_of, snapshot_root)
    trained = train(prepared.ratings, cfg)
    recommendations = materialize(recommend(prepared, trained, cfg.top_n, mode), "recommendations")
    metrics = evaluate(prepared, trained)
    report = {"settings": cfg.echo(), "mode": mode, "as_of": as_of.isoformat()}
    report["interactions"] = {
        "n_interactions": prepared.users.total_rows, "n_users": prepared.users.size, "n_items": prepared.items.size,
    }
    report["interaction_types"] = {
        r["interaction_type"]: r["n"] for r in interaction_type_counts(prepared.interactions).collect()
    }
    report["split"] = {"train": trained.split.n_train, "test": trained.split.n_test}
    report["als_block_loads"] = trained.block_loads
    report["users_recommended"] = recommendations.select("user_idx").distinct().count()
    report["users_without_factors"] = prepared.users.size - trained.user_factors.count()
    if metrics is not None:
        metrics = materialize(metrics, "metrics")
        report["metrics"] = metrics.first().asDict()
    if results_path is not None:
        write_csv(recommendations, results_path)
    if cfg.save_to_db:
        report["saved"] = save_recommendations(recommendations, **save_to)
    return RunResult(recommendations, metrics, report)
