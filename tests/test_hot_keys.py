"""Joins that stay level when one key holds most rows."""

import pytest
from pyspark.sql import functions as F

from shelfwise import session
from shelfwise.operators.similarity import among, excluding


@pytest.mark.parametrize("share", [0.34, 0.9, 0.01])
def test_no_partition_holds_more_than_its_part_of_a_hot_key(spark, monkeypatch, share):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 1000)
    monkeypatch.setattr(session, "BROADCAST_BYTES", 1 << 12)
    n = 20_000
    hot = int(n * share)
    facts = spark.range(n).select("id", F.when(F.col("id") < hot, 0).otherwise(F.col("id") % 500 + 1).alias("k"))
    dim = facts.groupBy("k").agg(F.count(F.lit(1)).alias("load")).withColumn("name", F.col("k") * 2)
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, v in zip(before, ("false", "64", "-1"), strict=True):
            spark.conf.set(c, v)
        joined = session.lookup_join(facts, dim, ["k"], "load", 501, n)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert joined.where("name = k * 2").count() == n == sum(sizes)
        assert max(sizes) <= 4 * 1000
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_lists_of_any_length_treat_null_alike(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id bigint")
    for listed in ([1], [1, *range(10, 2000)]):
        assert [r["id"] for r in excluding(df, listed).collect()] == [2]
        assert [r["id"] for r in among(df, listed).collect()] == [1]
