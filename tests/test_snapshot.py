from shelfwise.config import RunConfig, Thresholds
from shelfwise.sources.snapshot import is_complete, read_through, snapshot_path

from support import AS_OF, rows

SCHEMA = "member_id bigint, product_id bigint, interaction_type string"


class Builder:
    def __init__(self, spark, data):
        self.spark, self.data, self.calls = spark, data, 0

    def __call__(self):
        self.calls += 1
        return self.spark.createDataFrame(self.data, SCHEMA)


def test_built_once_then_read(spark, tmp_path):
    path = snapshot_path(str(tmp_path), RunConfig(), AS_OF)
    build = Builder(spark, [(1, 2, "like"), (None, 3, "cart")])
    for _ in range(3):
        assert rows(read_through(spark, path, build)) == [(1, 2, "like")]
    assert build.calls == 1


def test_null_ids_in_a_stored_snapshot_are_dropped_too(spark, tmp_path):
    path = f"{tmp_path}/s"
    spark.createDataFrame([(1, 2, "like"), (1, None, "cart")], SCHEMA).write.parquet(path)
    assert rows(read_through(spark, path, Builder(spark, []))) == [(1, 2, "like")]


def test_an_unfinished_snapshot_is_not_used(spark, tmp_path):
    path = tmp_path / "s"
    spark.createDataFrame([(1, 2, "like")], SCHEMA).write.parquet(str(path))
    (path / "_SUCCESS").unlink()
    assert not is_complete(spark, str(path))
    build = Builder(spark, [(5, 6, "cart")])
    assert rows(read_through(spark, str(path), build)) == [(5, 6, "cart")]
    assert build.calls == 1 and is_complete(spark, str(path))


def test_a_damaged_snapshot_is_built_again(spark, tmp_path):
    path = tmp_path / "s"
    path.mkdir()
    (path / "part-0.parquet").write_bytes(b"not parquet")
    (path / "_SUCCESS").touch()
    assert rows(read_through(spark, str(path), Builder(spark, [(5, 6, "cart")]))) == [(5, 6, "cart")]


def test_a_failing_write_only_warns(spark, tmp_path):
    (tmp_path / "file").write_text("in the way")
    got = read_through(spark, f"{tmp_path}/file/s", Builder(spark, [(5, 6, "cart")]))
    assert rows(got) == [(5, 6, "cart")]


def test_path_tells_settings_apart(tmp_path):
    a = snapshot_path("/x", RunConfig(), AS_OF)
    assert a.startswith("/x/as_of_date=20240131/days=10/")
    assert a != snapshot_path("/x", RunConfig(interaction_thresholds=Thresholds((1, 2, 3))), AS_OF)


def test_other_logs_have_another_snapshot(spark, tmp_path):
    from shelfwise.plans.recommend import prepare
    from shelfwise.schemas import TABLES
    from shelfwise.sources.tables import BehaviourLogs

    def logs(root, member):
        data = {"product_impression": [], "product_view": [], "purchased_product": [(member, "9", AS_OF)],
                "action_log": []}
        for name, rows_ in data.items():
            spark.createDataFrame(rows_, TABLES[name]).write.parquet(f"{root}/{name}")
        return BehaviourLogs.from_files(spark, str(root))

    cfg, root = RunConfig(), f"{tmp_path}/snapshots"
    one, two = logs(tmp_path / "one", "1"), logs(tmp_path / "two", "2")
    assert rows(prepare(one, cfg, AS_OF, root).interactions) == [(1, 9, "purchase")]
    assert rows(prepare(two, cfg, AS_OF, root).interactions) == [(2, 9, "purchase")]
    assert rows(prepare(one, cfg, AS_OF, root).interactions) == [(1, 9, "purchase")]
    assert len(list((tmp_path / "snapshots").rglob("_SUCCESS"))) == 2


def test_a_snapshot_that_lacks_a_column_is_built_again(spark, tmp_path):
    path = f"{tmp_path}/s"
    spark.createDataFrame([(1, 2)], "member_id bigint, product_id bigint").write.parquet(path)
    assert rows(read_through(spark, path, Builder(spark, [(5, 6, "cart")]))) == [(5, 6, "cart")]
