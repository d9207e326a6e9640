import argparse
import dataclasses
import json

import pytest

from shelfwise.__main__ import main
from shelfwise.config import RunConfig
from shelfwise.plans import ledger, recommend
from shelfwise.session import materialize, shared_root
from shelfwise.sources import testdata

from support import plan_of, rows

SMALL = "/root/testdata/sf0.001"
CFG = RunConfig(interaction_thresholds=testdata.LOW_TIERS, split_test_data=True, test_ratio=0.1, top_n=10, rank=5)


def test_whole_run(spark, tmp_path):
    cfg = dataclasses.replace(CFG, save_to_db=True)
    result = recommend.run(
        testdata.event_logs(spark, SMALL), cfg, testdata.EVENTS_AS_OF, snapshot_root=f"{tmp_path}/cache",
        results_path=f"{tmp_path}/results", save_to={"target": "parquet", "path": f"{tmp_path}/table"},
    )
    report = result.report
    assert report["interactions"] == {"n_interactions": 297, "n_users": 15, "n_items": 98}
    assert report["interaction_types"] == {
        "cart": 50, "impression1": 70, "like": 60, "purchase": 53, "view1": 62, "view2": 2}
    assert report["split"] == {"train": 267, "test": 30}
    assert report["users_recommended"] == 15 and report["users_without_factors"] == 0
    assert report["saved"] == {"table_name": "recommendations", "record_count": 15, "status": "success"}
    assert 0 < report["metrics"]["n"] <= 30 and report["metrics"]["rmse"] >= report["metrics"]["mae"]
    recs = result.recommendations
    assert recs.count() == 150
    prepared = recommend.prepare(testdata.event_logs(spark, SMALL), cfg, testdata.EVENTS_AS_OF,
                                 f"{tmp_path}/cache")
    trained = recommend.train(prepared.ratings, cfg)
    hidden = trained.split.train.select("user_idx", "item_idx")
    assert recs.join(hidden, ["user_idx", "item_idx"]).count() == 0
    written = spark.read.option("header", True).csv(f"{tmp_path}/results")
    assert written.count() == 15
    again = recommend.recommend(prepared, trained, 10)
    assert rows(again, "member_id", "product_id", "rank") == rows(recs, "member_id", "product_id", "rank")


def test_run_without_split_has_no_metrics(spark):
    cfg = dataclasses.replace(CFG, split_test_data=False, top_n=200)
    result = recommend.run(testdata.event_logs(spark, SMALL), cfg, testdata.EVENTS_AS_OF, mode="pad")
    assert result.metrics is None and result.report["split"] == {"train": 297, "test": 0}
    assert result.recommendations.count() == 15 * 98  # padded with seen products to all there are


def test_save_needs_a_target(spark):
    with pytest.raises(ValueError, match="names no target"):
        recommend.run(testdata.event_logs(spark, SMALL), dataclasses.replace(CFG, save_to_db=True))


def test_intermediate_tables_cut_lineage(spark):
    stored = materialize(spark.range(10).repartition(3), "probe")
    plan = plan_of(stored)
    assert "Exchange" not in plan and shared_root(spark).split("/")[-1] in plan
    assert stored.count() == 10


def test_shared_folder_is_the_session_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        assert shared_root(spark).startswith(root)
    assert spark.sparkContext.getCheckpointDir() is not None


def test_command_line(spark, tmp_path, capsys):
    logs = testdata.event_logs(spark, SMALL)
    for name in ("product_impression", "product_view", "action_log", "purchased_product"):
        getattr(logs, name).write.parquet(f"{tmp_path}/logs/{name}")
    settings = {
        "rank": 3, "max_iter": 2, "top_n": 5, "days": 10, "split_test_data": True, "test_ratio": 0.1,
        "interaction_thresholds": {"view1": 1, "view2": 2, "view3": 3, "impression1": 1, "impression2": 2,
                                   "impression3": 3},
    }
    (tmp_path / "settings.json").write_text(json.dumps(settings))
    report = main([
        str(tmp_path / "settings.json"), "--logs", f"{tmp_path}/logs", "--results", f"{tmp_path}/out",
        "--snapshots", f"{tmp_path}/cache", "--as-of", "2024-01-31",
    ])
    assert report["interactions"]["n_interactions"] == 297
    assert json.loads(capsys.readouterr().out)["settings"]["top_n"] == 5
    out = spark.read.option("header", True).csv(f"{tmp_path}/out")
    assert out.count() == 15 and all(len(r["recommended_items"].split(",")) == 5 for r in out.collect())


def test_ledger_holds_one_row_per_run(spark, tmp_path):
    """A run that saves, one whose target cannot be written, one that fails, and one that died."""
    logs, path = testdata.event_logs(spark, SMALL), f"{tmp_path}/runs"
    (tmp_path / "file").write_text("in the way")
    saving = dataclasses.replace(CFG, save_to_db=True, db_type="parquet")
    recommend.run(logs, saving, testdata.EVENTS_AS_OF, save_to={"path": f"{tmp_path}/saved"}, ledger_path=path)
    recommend.run(logs, saving, testdata.EVENTS_AS_OF, save_to={"path": f"{tmp_path}/file/saved"}, ledger_path=path)
    with pytest.raises(ValueError, match="als_block"):
        recommend.run(logs, dataclasses.replace(CFG, als_block_rows=3), testdata.EVENTS_AS_OF, ledger_path=path)
    ledger.Ledger(spark, path, {"top_n": 1}, "strict")
    found = {r["status"]: r for r in ledger.runs(spark, path).collect()}
    assert set(found) == {"success", "not saved", "failed", "running"}
    done, unsaved, failed = (found[s] for s in ("success", "not saved", "failed"))
    assert done["n_saved"] == done["n_recommended"] == spark.read.parquet(f"{tmp_path}/saved").count()
    assert done["error"] is None and done["saved_to"] == "recommendations" and done["rmse"] > 0
    assert unsaved["n_saved"] is None and unsaved["error"] and unsaved["n_recommended"] == done["n_recommended"]
    assert failed["error"].startswith("ValueError") and failed["n_train"] is None
    assert done["started_at"] < done["finished_at"] and found["running"]["finished_at"] is None
    assert json.loads(done["settings"])["db_type"] == "parquet"


def test_report_tells_what_the_fit_will_hold(spark):
    result = recommend.run(testdata.event_logs(spark, SMALL), CFG, testdata.EVENTS_AS_OF)
    assert [r["side"] for r in result.report["als_block_loads"]] == ["user", "item"]


def test_command_line_takes_logs_from_files_or_a_database(spark, tmp_path, monkeypatch):
    from shelfwise import __main__ as cli

    seen = {}
    monkeypatch.setattr(cli.BehaviourLogs, "from_jdbc", classmethod(lambda cls, spark, url, tables, **o: seen.update(url=url, tables=tables, **o)))
    (tmp_path / "t.json").write_text('{"action_log": {"table": "log.actions", "casts": {"created_at": "cast"}}}')
    args = argparse.Namespace(logs=None, logs_url="jdbc:mysql://db/x", logs_driver="d.D", logs_user=None, logs_tables=f"{tmp_path}/t.json", format="parquet")
    cli.behaviour_logs(spark, args)
    assert seen["url"] == "jdbc:mysql://db/x" and seen["driver"] == "d.D" and seen["tables"]["action_log"]["table"] == "log.actions"
    with pytest.raises(SystemExit):
        cli.main(["settings.json", "--results", "r"])
    with pytest.raises(SystemExit):
        cli.main(["settings.json", "--results", "r", "--logs", "a", "--logs-url", "b"])
