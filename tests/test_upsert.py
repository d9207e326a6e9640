import pytest

from shelfwise.operators import upsert
from shelfwise.operators.upsert import (
    compact_stored, current_version, drop_versions, last_updates, read_embeddings, upsert_embeddings, upsert_stored,
    write_embeddings,
)

from support import plan_of, rows

SCHEMA = (
    "id bigint, status string, primary_category_id int, secondary_category_id int, image_vector array<float>"
)


def target(spark):
    return spark.createDataFrame([(1, "SALE", 1, 1, [1.0]), (2, "SALE", 2, 2, [2.0])], SCHEMA)


def updates(spark, data):
    return spark.createDataFrame(data, f"{SCHEMA}, seq int")


def test_insert_overwrite_and_last_wins(spark):
    got = upsert_embeddings(target(spark), updates(spark, [
        (2, "SOLD_OUT", None, 3, [9.0], 1), (3, "SALE", 1, 1, [3.0], 2), (3, "SALE", 1, 1, [4.0], 3)]))
    assert rows(got) == [(1, "SALE", 1, 1, [1.0]), (2, "SOLD_OUT", None, 3, [9.0]), (3, "SALE", 1, 1, [4.0])]


@pytest.mark.parametrize("bad", [[1.0, None], [float("nan")], [float("inf")]])
def test_one_bad_vector_refuses_the_batch(spark, bad):
    with pytest.raises(ValueError, match="product 5"):
        upsert_embeddings(target(spark), updates(spark, [(1, "SALE", 1, 1, [7.0], 1), (5, "SALE", 1, 1, bad, 2)]))


def test_a_hot_id_is_cut_down_before_the_shuffle(spark):
    many = updates(spark, [(1, "SALE", 1, 1, [float(i)], i) for i in range(3000)])
    assert rows(last_updates(many))[0][4] == [2999.0]
    plan = plan_of(last_updates(many))
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


@pytest.mark.parametrize("row, why", [
    ((None, "SALE", 1, 1, [1.0], 1), "no id"),
    ((5, "SALE", 1, 1, None, 1), "product 5 has no vector"),
    ((5, "SALE", 1, 1, [1.0, 2.0], 1), "elements"),
    ((1, "SALE", 1, 1, [8.0], 1), "more than once"),
])
def test_a_bad_row_refuses_the_batch(spark, row, why):
    with pytest.raises(ValueError, match=why):
        upsert_embeddings(target(spark), updates(spark, [(1, "SALE", 1, 1, [7.0], 1), row]))


def test_only_touched_folders_are_rewritten(spark, tmp_path):
    path = f"{tmp_path}/embeddings"
    rows_ = [(i, "SALE", 1, 1, [float(i)]) for i in range(300)]
    write_embeddings(spark.createDataFrame(rows_, SCHEMA), path)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    touched = upsert_stored(spark, path, updates(spark, [(7, "HIDDEN", 2, 2, [-7.0], 1), (900, "SALE", 1, 1, [9.0], 1)]))
    after = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    kept = {p for p in before if after.get(p) == before[p]}
    assert len(touched) <= 2 and {p.parent.name for p in before} - {p.parent.name for p in kept} <= {f"bucket={b}" for b in touched}
    want = [r for r in rows_ if r[0] != 7] + [(7, "HIDDEN", 2, 2, [-7.0]), (900, "SALE", 1, 1, [9.0])]
    assert rows(read_embeddings(spark, path)) == sorted(want, key=repr)


@pytest.fixture
def small_folders(monkeypatch):
    """A folder holds some twenty rows, a file some five, so that all is cut."""
    monkeypatch.setattr(upsert, "FOLDER_BYTES", 1400)
    monkeypatch.setattr(upsert, "FILE_BYTES", 350)


def numbered(spark, ids, sign=1.0):
    return spark.createDataFrame([(i, "SALE", 1, 1, [float(sign * i)]) for i in ids], SCHEMA)


def as_updates(df):
    return df.selectExpr("*", "CAST(id AS INT) AS seq")


def ids_and_signs(df):
    return {r["id"]: r["image_vector"][0] for r in df.collect()}


def test_folders_follow_the_bytes_and_are_written_by_many_tasks(spark, tmp_path, small_folders):
    version = write_embeddings(numbered(spark, range(300)), f"{tmp_path}/t")
    assert version.buckets == -(-300 * 68 // 1400) and len(version.layers) == 1
    files_of = {}
    for p in tmp_path.rglob("*.parquet"):
        files_of.setdefault(p.parent.name, []).append(p)
    assert max(len(found) for found in files_of.values()) > 1
    twice = write_embeddings(numbered(spark, range(600)), f"{tmp_path}/t")
    assert twice.number == 2 and twice.buckets >= 2 * version.buckets - 1
    assert read_embeddings(spark, f"{tmp_path}/t").count() == 600 and read_embeddings(spark, f"{tmp_path}/t", 1).count() == 300


def test_versions_are_read_back_and_no_file_of_an_old_one_changes(spark, tmp_path, small_folders):
    path = f"{tmp_path}/t"
    write_embeddings(numbered(spark, range(100)), path)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*") if p.is_file()}
    upsert_stored(spark, path, as_updates(numbered(spark, range(90, 110), -1.0)))
    upsert_stored(spark, path, as_updates(numbered(spark, [95, 105, 200], 7.0)))
    assert {p: p.stat().st_mtime_ns for p in before} == before
    assert ids_and_signs(read_embeddings(spark, path, 1)) == {i: float(i) for i in range(100)}
    second = {i: float(i) for i in range(90)} | {i: -float(i) for i in range(90, 110)}
    assert ids_and_signs(read_embeddings(spark, path, 2)) == second
    third = second | {95: 665.0, 105: 735.0, 200: 1400.0}
    assert ids_and_signs(read_embeddings(spark, path)) == third
    merged = compact_stored(spark, path)
    assert merged.number == 4 and not any(x.delta for x in merged.layers)
    assert ids_and_signs(read_embeddings(spark, path)) == third and ids_and_signs(read_embeddings(spark, path, 2)) == second
    assert compact_stored(spark, path).number == 4
    assert drop_versions(spark, path, keep=1) == 3
    assert ids_and_signs(read_embeddings(spark, path)) == third


def test_many_batches_are_merged_on_the_way(spark, tmp_path, small_folders, monkeypatch):
    monkeypatch.setattr(upsert, "MOST_DELTAS", 2)
    path, want = f"{tmp_path}/t", {i: float(i) for i in range(50)}
    write_embeddings(numbered(spark, range(50)), path)
    for step in range(1, 5):
        ids = range(10 * step, 10 * step + 15)
        upsert_stored(spark, path, as_updates(numbered(spark, ids, -step)))
        want |= {i: -float(step * i) for i in ids}
    assert ids_and_signs(read_embeddings(spark, path)) == want
    assert sum(x.delta for x in current_version(spark, path).layers) <= 2


def test_a_table_that_outgrows_its_folders_gets_more(spark, tmp_path, small_folders):
    path = f"{tmp_path}/t"
    write_embeddings(numbered(spark, range(20)), path)
    upsert_stored(spark, path, as_updates(numbered(spark, range(10, 200))))
    merged = compact_stored(spark, path)
    assert merged.buckets == -(-200 * 68 // 1400) and len(merged.layers) == 1
    assert read_embeddings(spark, path).count() == 200


def test_a_failed_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    write_embeddings(numbered(spark, range(10)), path)
    with pytest.raises(ValueError, match="elements"):
        upsert_stored(spark, path, updates(spark, [(3, "SALE", 1, 1, [1.0, 2.0], 1)]))
    with monkeypatch.context() as m:
        m.setattr(upsert, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            upsert_stored(spark, path, as_updates(numbered(spark, range(5), -1.0)))
    # A writer that died over the manifest leaves half of it.
    (tmp_path / "t" / "versions" / "v0000000002.json").write_text('{"buckets": 1, "lay')
    assert current_version(spark, path).number == 1
    assert ids_and_signs(read_embeddings(spark, path)) == {i: float(i) for i in range(10)}
    upsert_stored(spark, path, as_updates(numbered(spark, [3], -1.0)))
    assert current_version(spark, path).number == 3 and ids_and_signs(read_embeddings(spark, path))[3] == -3.0


def test_of_two_writers_one_is_refused(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    write_embeddings(numbered(spark, range(10)), path)
    checked = upsert._checked

    def late(target, batch):
        with monkeypatch.context() as m:
            m.setattr(upsert, "_checked", checked)
            upsert_stored(spark, path, as_updates(numbered(spark, [1], -1.0)))
        return checked(target, batch)

    with monkeypatch.context() as m:
        m.setattr(upsert, "_checked", late)
        with pytest.raises(RuntimeError, match="another writer"):
            upsert_stored(spark, path, as_updates(numbered(spark, [2], -1.0)))
    got = ids_and_signs(read_embeddings(spark, path))
    assert got[1] == -1.0 and got[2] == 2.0


def test_no_table_and_empty_tables(spark, tmp_path):
    with pytest.raises(ValueError, match="no table"):
        read_embeddings(spark, f"{tmp_path}/none")
    write_embeddings(numbered(spark, []), f"{tmp_path}/t")
    assert read_embeddings(spark, f"{tmp_path}/t").count() == 0
    assert upsert_stored(spark, f"{tmp_path}/t", as_updates(numbered(spark, [4]))) == [0]
    assert upsert_stored(spark, f"{tmp_path}/t", as_updates(numbered(spark, []))) == []
    assert ids_and_signs(read_embeddings(spark, f"{tmp_path}/t")) == {4: 4.0}
