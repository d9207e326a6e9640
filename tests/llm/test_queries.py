"""The registered queries: their columns, and their SQL where they have it."""

import duckdb
import pytest

import __spark_entry__ as entry
from shelfwise.llm import queries

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id piece start length ids_crc32 sequence_id offset",
    2: "doc_id held_out n_tokens n_known train_tokens base_score score",
    3: "doc_id license score n_matches",
    4: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    5: "doc_id size source_size target taken",
    6: "doc_id held_out score predicted",
    7: "doc_id fingerprint component_id",
    8: "doc_id n_bytes n_removed n_spans kept_sha256",
    9: "doc_id held_out lang_pred score",
    10: "query_id rank vec_id score",
    11: "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    12: "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    13: "vec_id component n deviation whitened explained identity_error",
}


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == sorted(COLUMNS)
    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_columns_and_sql(spark, name):
    df = queries.queries()[name](spark, SMALL)
    assert set(COLUMNS[int(name[2:].split("_")[0])].split()) <= set(df.columns)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if sql := queries.oracle_sql().get(name):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert canonical(rows, df.columns) == canonical(cursor.fetchall(), names)
