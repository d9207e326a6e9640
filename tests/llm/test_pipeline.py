from collections import Counter, defaultdict
from itertools import combinations

import pyarrow.parquet as pq
import pytest
from helpers import SCHEMA

import corpus_pipeline
from shelfwise.llm import common, mixing, packing, simhash, suffix, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("pipeline"), []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{root}/{i}-{name}")
        docs = spark.read.parquet(f"{root}/{i}-{name}")
        out.append(docs)
    return out


def test_each_stage_acts_on_what_the_one_before_kept(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tox, near, passages, mixed, packed = stages
    assert all(s.columns == docs.columns for s in stages[:-1])
    scores = toxicity.assess(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in tox.collect()} == {r.doc_id for r in scores.collect() if not r.predicted}

    texts = {r.doc_id: r.text for r in tox.collect()}
    sets = {i: frozenset(simhash.shingles((t or "").encode(), 5)) for i, t in texts.items()}
    root = {i: i for i in sets}
    close = [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        for a, b in close:
            root[a] = root[b] = min(root[a], root[b])
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(root.values()))

    digests = {r.doc_id: r for r in suffix.removal_digests(near).collect()}
    before = {r.doc_id: r.text for r in near.collect()}
    for r in passages.collect():
        left = digests[r.doc_id].n_bytes - digests[r.doc_id].n_removed
        assert left <= len(r.text.encode()) <= left + 8 * digests[r.doc_id].n_spans
        assert digests[r.doc_id].n_spans or r.text == before[r.doc_id]
    assert len(before) == passages.count()

    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    assert words == {r.doc_id: r.taken for r in mixing.mix_report(passages).collect() if r.taken}
    assert Counter(r.doc_id for r in packed.collect() if r.piece == 0) == Counter(r.doc_id for r in mixed.collect())


def test_packed_sequences_are_gapless(stages):
    by_seq = defaultdict(list)
    for r in stages[-1].collect():
        by_seq[r.sequence_id].append((r.offset, r.length))
    for parts in by_seq.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, stages[-1].select(key).collect()))


def test_awkward_documents_pass_all_stages(spark):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a b", None, "s", 3), (3, "x " * 20_000, "en", "s", 1)]
    for docs in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)):
        docs = docs.selectExpr("*", "'x' AS row", "1 AS copy", "2 AS score", "3 AS fp", "4 AS at")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_documents_are_read_whole():
    assert pq.read_table(f"{SF}/documents.parquet").num_rows == 200


def test_executors_collect_between_stages(spark, monkeypatch):
    """What a step leaves in the heap of an executor is given up before the next stage, not on the driver alone."""

    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    def jobs(group):
        spark.sparkContext.setJobGroup(group, "")
        common.release(spark)
        tracker = spark.sparkContext.statusTracker()
        return [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]

    assert jobs("the driver is the executor") == []
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    before = collections()
    assert jobs("a cluster") == [spark.sparkContext.defaultParallelism]
    assert collections() >= before + 3  # two of the driver's and at least one from the tasks
    monkeypatch.undo()
    spark.sparkContext._jsc.clearJobGroup()

    class Released(Exception):
        pass

    def released(session):
        raise Released

    monkeypatch.setattr(corpus_pipeline, "release", released)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Released):
            stage(spark, None, SF)
