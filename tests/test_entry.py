"""Every registered query beside its SQL, on all rows of the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


# The corpus queries have tests of their own; their package may be absent.
OWN = {name[2:] for name in vars(entry) if name.startswith("q_")}


def canonical(data, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in data)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(OWN & set(entry.oracle_sql())))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SMALL)
    cursor = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), names)


@pytest.mark.parametrize("name", sorted(OWN - set(entry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["member_id", "product_id", "rank", "score"]
    assert df.count() > 0


def test_known_counts_at_the_check_scale(spark):
    """Values worked out independently for these tables."""
    sf = "/root/testdata/sf0.01"
    stats = entry.queries()["interaction_stats"](spark, sf).first().asDict()
    assert stats == {"n_interactions": 3243, "n_users": 150, "n_items": 100}
    metrics = entry.queries()["eval_metrics"](spark, sf).first()
    assert metrics["n"] == 325
    assert math.isclose(metrics["mae"], 3.323549) and math.isclose(metrics["rmse"], 3.925207)
