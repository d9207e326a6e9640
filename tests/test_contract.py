"""Typed reads: what is taken as it is, what needs a declared cast, and what is set aside."""

import pytest
from pyspark.sql import functions as F

from shelfwise.schemas import ACTION_LOG, PRODUCT_EMBEDDINGS, PRODUCT_VIEW, by_contract
from shelfwise.sources import files
from shelfwise.sources.tables import BehaviourLogs, read_parted, read_table

from support import AS_OF, rows

TEXT_TIMES = "member_id string, product_id string, event_name string, created_at string"


def test_text_times_are_refused_by_name_and_read_by_declaration(spark, tmp_path):
    data = [("1", "2", "x", "2024-01-30 10:00:00"), ("1", "3", "x", "30th of January"), ("2", None, None, None)]
    spark.createDataFrame(data, TEXT_TIMES).write.parquet(f"{tmp_path}/a")
    with pytest.raises(ValueError, match="created_at is string, not timestamp"):
        read_table(spark, f"{tmp_path}/a", "action_log")
    good, aside = read_parted(spark, f"{tmp_path}/a", "action_log", casts={"created_at": "cast"})
    assert good.schema == ACTION_LOG
    assert rows(good.select("product_id", F.col("created_at").cast("string"))) == [("2", "2024-01-30 10:00:00"), (None, None)]
    assert rows(aside) == [("1", "3", "x", "30th of January", "created_at")]


def test_a_pattern_of_times(spark):
    df = spark.createDataFrame([("1", "2", "x", "30/01/2024"), ("1", "3", "x", "2024-01-30")], TEXT_TIMES)
    good, aside = by_contract(df, ACTION_LOG, "t", {"created_at": "dd/MM/yyyy"})
    assert [r["created_at"].day for r in good.collect()] == [30] and aside.count() == 1


def test_narrower_numbers_fit_wider_do_not(spark):
    df = spark.createDataFrame([(1, 2, 3, AS_OF)], "id int, member_id bigint, product_id smallint, created_at timestamp")
    good, aside = by_contract(df, PRODUCT_VIEW, "t")
    assert good.schema == PRODUCT_VIEW and rows(good)[0][:3] == (1, "2", "3") and aside.count() == 0
    wide = df.withColumn("id", F.lit(1).cast("decimal(20,0)"))
    with pytest.raises(ValueError, match="id is decimal"):
        by_contract(wide, PRODUCT_VIEW, "t")
    assert rows(by_contract(wide, PRODUCT_VIEW, "t", {"id": "cast"})[0])[0][0] == 1
    beyond = df.withColumn("id", F.lit("99999999999999999999"))
    assert by_contract(beyond, PRODUCT_VIEW, "t", {"id": "cast"})[1].count() == 1


def test_dates_and_times_without_a_zone_stand_for_times(spark):
    df = spark.createDataFrame([("1", "2", "x", AS_OF)], ACTION_LOG)
    for kind in ("date", "timestamp_ntz"):
        good, _ = by_contract(df.withColumn("created_at", F.col("created_at").cast(kind)), ACTION_LOG, "t")
        assert good.schema["created_at"].dataType.simpleString() == kind


def test_vectors_as_text_and_several_unfit_columns(spark):
    schema = "id string, status string, primary_category_id int, secondary_category_id int, image_vector string"
    data = [("1", "SALE", 1, 1, "[1,2.5]"), ("x", "SALE", 1, 1, "[1,y]"), ("3", "SALE", None, 1, None), ("4", "S", 1, 1, "1,NaN")]
    df = spark.createDataFrame(data, schema)
    good, aside = by_contract(df, PRODUCT_EMBEDDINGS, "t", {"id": "cast", "image_vector": "cast"})
    assert good.schema == PRODUCT_EMBEDDINGS
    assert rows(good.select("id", "image_vector")) == [(1, [1.0, 2.5]), (3, None)]
    assert rows(aside.select("id", "unfit_columns")) == [("4", "image_vector"), ("x", "id,image_vector")]


def test_csv_rows_that_do_not_fit_are_set_aside(spark, tmp_path):
    (tmp_path / "v.csv").write_text("id,member_id,product_id,created_at\n1,5,6,2024-01-30 00:00:00\nx,5,6,2024-01-30\n2,5,6,noon\n")
    good, aside = read_parted(spark, f"{tmp_path}/v.csv", "product_view", "csv")
    assert rows(good.select("id")) == [(1,)]
    assert rows(aside.select("id", "unfit_columns")) == [("2", "created_at"), ("x", "id")]


def test_unknown_casts_and_missing_columns(spark):
    df = spark.createDataFrame([("1", "2", "x", AS_OF)], ACTION_LOG)
    with pytest.raises(ValueError, match="no columns to cast: when"):
        by_contract(df, ACTION_LOG, "t", {"when": "cast"})
    with pytest.raises(ValueError, match="lacks columns: event_name"):
        by_contract(df.drop("event_name"), ACTION_LOG, "t")


def test_filters_still_reach_the_files(spark, tmp_path):
    spark.createDataFrame([("1", "2", "x", AS_OF)], ACTION_LOG).write.parquet(f"{tmp_path}/a")
    asked = read_table(spark, f"{tmp_path}/a", "action_log").where("event_name = 'x'").select("member_id")
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_name,x)" in plan and "created_at" not in plan.split("ReadSchema")[1]


def test_fingerprint_tells_files_apart(spark, tmp_path):
    root = f"{tmp_path}/t"
    spark.range(10).write.parquet(root)
    first = files.fingerprint(spark, root)
    assert files.fingerprint(spark, root) == first
    spark.range(10).write.mode("append").parquet(root)
    second = files.fingerprint(spark, root)
    assert second != first
    spark.range(10).write.mode("overwrite").parquet(root)
    assert files.fingerprint(spark, root) not in (first, second)
    # Only names, sizes and times are looked at.
    assert "content" not in files.listing(spark, root)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_frames_of_other_origin_are_told_apart_by_content(spark):
    def logs(product):
        empty = spark.createDataFrame([], ACTION_LOG)
        return BehaviourLogs(empty, empty, spark.createDataFrame([("1", product, "x", AS_OF)], ACTION_LOG), empty)

    assert logs("2").identity() == logs("2").identity() != logs("3").identity()
    assert logs(None).identity() != logs("2").identity()


def test_a_file_added_on_the_same_day_makes_a_new_snapshot(spark, tmp_path):
    from shelfwise.config import RunConfig
    from shelfwise.plans.recommend import prepare
    from shelfwise.schemas import TABLES
    from shelfwise.sources.tables import LOG_TABLES

    root, snapshots = f"{tmp_path}/logs", f"{tmp_path}/snapshots"

    def add(member):
        for name in LOG_TABLES:
            data = [(member, "9", AS_OF)] if name == "purchased_product" else []
            spark.createDataFrame(data, TABLES[name]).write.mode("append").parquet(f"{root}/{name}")

    def members():
        found = prepare(BehaviourLogs.from_files(spark, root), RunConfig(), AS_OF, snapshots).interactions
        return [r[0] for r in rows(found)], len(list((tmp_path / "snapshots").rglob("_SUCCESS")))

    add("1")
    assert members() == ([1], 1) and members() == ([1], 1)
    add("2")
    assert members() == ([1, 2], 2) and members() == ([1, 2], 2)
