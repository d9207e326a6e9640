from datetime import datetime

import pytest

from shelfwise.operators import sinks
from shelfwise.sources.tables import jdbc_read_options, read_table

from support import AS_OF, rows

RECS = "member_id bigint, product_id bigint, rank int"


@pytest.fixture(scope="module")
def recs(spark):
    return spark.createDataFrame([(1, 2, 3), (1, 3, 1), (1, 1, 2), (9, 40, 1)], RECS).cache()


def test_items_keep_rank_order(recs):
    assert rows(sinks.wide_results(recs)) == [(1, "3,1,2"), (9, "40")]


def test_csv(spark, recs, tmp_path):
    for _ in range(2):
        sinks.write_csv(recs, f"{tmp_path}/out")
    back = spark.read.option("header", True).csv(f"{tmp_path}/out")
    assert back.columns == ["user_id", "recommended_items"]
    assert rows(back) == [("1", "3,1,2"), ("9", "40")]


def test_append_and_report(spark, recs, tmp_path):
    path = f"{tmp_path}/recommendations"
    report = sinks.save_recommendations(recs, "parquet", AS_OF, path=path)
    assert report == {"table_name": "recommendations", "record_count": 2, "status": "success"}
    sinks.save_recommendations(recs, "parquet", path=path)
    stored = spark.read.parquet(path)
    assert stored.columns == ["member_id", "product_ids", "created_at"] and stored.count() == 4
    assert stored.where(stored.created_at == "2024-01-31").count() == 2
    assert stored.agg({"created_at": "max"}).first()[0] > datetime(2024, 2, 1)


def test_failing_write_is_reported(recs, tmp_path):
    (tmp_path / "file").write_text("in the way")
    report = sinks.save_recommendations(recs, "parquet", path=f"{tmp_path}/file/below")
    assert report["status"] == "error" and report["error"]


def test_unknown_target_is_an_error(recs):
    with pytest.raises(ValueError, match="unsupported database type: oracle"):
        sinks.save_recommendations(recs, "oracle", url="jdbc:oracle:x")


def test_jdbc_options():
    options = sinks.jdbc_write_options("postgres", "jdbc:postgresql://host/db", user="u", password="p")
    assert options["batchsize"] == "1000" and options["dbtable"] == "recommendations" and options["user"] == "u"
    with pytest.raises(ValueError, match="mysql URL"):
        sinks.jdbc_write_options("mysql", "jdbc:postgresql://host/db")
    read = jdbc_read_options("jdbc:mysql://h/d", "product", "id", 0, 1000, 16, user="u")
    assert (read["partitionColumn"], read["numPartitions"], read["user"]) == ("id", "16", "u")
    assert "partitionColumn" not in jdbc_read_options("jdbc:mysql://h/d", "product")
    with pytest.raises(ValueError, match="needs lower"):
        jdbc_read_options("jdbc:mysql://h/d", "product", "id")


def test_read_tables_with_their_schema(spark, tmp_path):
    spark.sql("SELECT '1' member_id, '2' product_id, 'x' event_name, timestamp'2024-01-01' created_at, 5 extra") \
        .write.parquet(f"{tmp_path}/p")
    assert read_table(spark, f"{tmp_path}/p", "action_log").columns == [
        "member_id", "product_id", "event_name", "created_at"]
    (tmp_path / "c.csv").write_text("id,member_id,product_id,created_at\n7,1,2,2024-01-05 00:00:00\n")
    row = read_table(spark, f"{tmp_path}/c.csv", "product_view", "csv").first()
    assert row["id"] == 7 and row["created_at"] == datetime(2024, 1, 5)
    with pytest.raises(ValueError, match="lacks columns: id"):
        read_table(spark, f"{tmp_path}/p", "product_view")
    with pytest.raises(ValueError, match="unsupported file format"):
        read_table(spark, f"{tmp_path}/p", "action_log", "orc")
