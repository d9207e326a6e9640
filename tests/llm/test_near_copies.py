import random
import re
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from helpers import SCHEMA, clashing, documents

import corpus_pipeline
from shelfwise.llm import near_copies, simhash
from shelfwise.llm.common import Scratch, components


def planted(rng, base, edits):
    w = base.split()
    for i in range(edits):
        w[(i * 2 + 1) * len(w) // (2 * edits)] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def jaccard(a, b):
    x, y = (set(simhash.shingles((t or "").encode(), 5)) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(texts):
    """The smallest number of each component by all pairs."""
    root = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            if root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                changed = True
    return [r + 1 for r in root]


def corpus():
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(30)]
    texts += [planted(rng, texts[i % 20], 2 + i % 8) for i in range(40)]
    texts += [texts[0].upper(), texts[1] + " end", "", None, " \t", "one", "One", "two three"]
    return texts + [planted(rng, texts[29], 1 + i % 5) for i in range(60)]


def test_components_equal_those_of_all_pairs(spark):
    texts = corpus()
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(documents(spark, texts)).collect()}
    assert [got[i + 1] for i in range(len(texts))] == brute(texts)
    assert near_copies.near_copies(documents(spark, ["a"]).limit(0)).count() == 0


def test_the_stage_keeps_one_of_planted_near_copies(spark):
    texts = corpus()
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, t, "en", "s", 1) for i, t in enumerate(texts)]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert kept.count() == len(set(brute(texts)))
    far = [(a, b) for i, a in enumerate(texts[:70]) for b in texts[:i] if jaccard(a, b) >= 0.8 and
           (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() > 2]
    assert far


def template_family(count=600, planted_pairs=100):
    """Pages of one template: 88 % of the shingles are everyone's, so pairs have 0.78; planted pairs share more."""
    rng = random.Random(8)
    common = [f"t{i}" for i in range(404)]
    pages = []
    for i in range(count):
        own = [f"p{i}x{j}" for j in range(54)]
        if i % 2 and i < 2 * planted_pairs:
            own = pages[i - 1][-54:-43] + own[11:]
        pages.append(common + own)
    return [" ".join(p) for p in pages]


def test_links_within_a_large_family_of_pages_are_found(spark):
    texts = template_family()
    assert jaccard(texts[0], texts[1]) >= 0.8 > jaccard(texts[0], texts[2]) > 0.76
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(documents(spark, texts)).collect()}
    linked = sum(got[2 * i + 1] == got[2 * i + 2] for i in range(100))
    assert linked >= 98
    assert len(set(got.values())) == len(texts) - linked


def test_pairs_of_crowded_buckets_hold_all_that_reach_the_similarity(spark):
    rng = random.Random(4)
    base = [f"t{i}" for i in range(120)]
    texts = []
    for i in range(70):
        w = list(base[: rng.randint(70, 120)])
        for j in rng.sample(range(len(w)), rng.randint(0, 9)):
            w[j] = f"x{rng.randrange(40)}"
        texts.append(" ".join(w))
    docs = documents(spark, texts)
    classes = spark.createDataFrame([(i + 1, [7]) for i in range(len(texts))], "node long, bands array<long>")
    scratch = near_copies.Scratch(spark, "test")
    got = {(r.a, r.b) for r in near_copies.crowded(classes, None, docs, scratch, 5, 0.8).collect()}
    want = {(j + 1, i + 1) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8}
    assert want and want <= got and len(got) < len(texts) * (len(texts) - 1) / 4


def test_clashing_columns_very_long_texts_and_a_hot_head(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "MEMBERS", 7)
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    base = " ".join(f"v{i}" for i in range(200))
    texts = [long, long + " tail", base, *[planted(rng, base, 1 + i % 3) for i in range(80)], None, ""]
    docs = clashing(documents(spark, texts), "node", "class", "bands", "root", "head")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert [got[i + 1] for i in range(len(texts))] == brute(texts)


def test_the_stage_follows_the_links_of_operator_7_and_of_near_copies(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    refrain = "alpha beta gamma " * 200
    base, tail, other = words(300), words(40), words(300)
    # 1 and 2 by fingerprints alone, 2 and 3 by shingles alone, 4 and 5 by shingles, 6 by nothing.
    texts = [refrain + words(40), refrain + tail, "alpha beta gamma " * 3 + tail, base, planted(rng, base, 3), other]
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 2 and jaccard(texts[0], texts[1]) < 0.5
    assert (prints[1] ^ prints[2]).bit_count() > 2 and jaccard(texts[1], texts[2]) >= 0.8
    got = {r.doc_id: r.component_id for r in near_copies.near_groups(documents(spark, texts)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, texts * 2), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6]
    assert near_copies.near_groups(documents(spark, ["a"]).limit(0)).count() == 0


def test_compared_texts_are_not_broadcast_through_the_driver(spark):
    texts = corpus()[:60]
    pairs = spark.createDataFrame([(i + 1, 31 + i) for i in range(20)], "a long, b long")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = near_copies.similar(pairs, documents(spark, texts), Scratch(spark, "test"), 5, 0.8)
        plan = near._jdf.queryExecution().executedPlan().toString().split("\n")
        got = {frozenset(r) for r in near.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    want = {frozenset((i + 1, 31 + i)) for i in range(20) if jaccard(texts[i], texts[30 + i]) >= 0.8}
    assert want and got == want
    depth = [m.start() if (m := re.search("[A-Za-z]", line)) else 0 for line in plan]
    for i, line in enumerate(plan):
        if line[depth[i] :].startswith("BroadcastExchange"):
            below = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
            assert not any("packed" in x for x in plan[i:below])


def test_figures_of_tables_are_taken_as_they_are_written(spark, monkeypatch):
    texts = corpus()
    docs = documents(spark, texts)

    def refuse(*_, **__):
        pytest.fail("a query of its own for figures of a written table")

    with monkeypatch.context() as patch:
        for name in ("first", "count", "isEmpty"):
            patch.setattr(type(docs), name, refuse)
        grouped = near_copies.near_groups(docs)
    got = {r.doc_id: r.component_id for r in grouped.collect()}
    assert [got[i + 1] for i in range(len(texts))] == brute(texts)


def test_stars_around_their_smallest_nodes_settle_in_one_round(spark, monkeypatch):
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: saved.append(name) or save(self, df, name))
    stars = spark.createDataFrame([(1, 2), (3, 1), (1, 4), (9, 8)], "a long, b long")
    assert {tuple(r) for r in components(stars, Scratch(spark, "t")).collect()} == {
        (1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)
    }
    assert saved == ["links", "edges-0"]
    assert components(stars.limit(0), Scratch(spark, "t")).count() == 0


def test_rounds_of_components_take_tasks_by_links_and_cores(spark, monkeypatch):
    """However many shuffle partitions are set, and with no coalescing by Spark, few links take few tasks."""
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: saved.append(name) or save(self, df, name))
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 8], "a long, b long")
    conf = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    sc = spark.sparkContext
    sc.setJobGroup("rounds of components", "")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {tuple(r) for r in components(links, Scratch(spark, "t")).collect()}
    finally:
        sc._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {(i, 8 * ((i - 1) // 8) + 1) for i in range(1, 41)}
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("rounds of components") for s in tracker.getJobInfo(j).stageIds}
    ran = [i.numCompletedTasks for s in sorted(stages) if (i := tracker.getStageInfo(s)) and i.numCompletedTasks]
    # The links themselves, the result as it is read, and of a round the two small tables that Spark may broadcast.
    assert sum(n >= 211 for n in ran) <= 2 + 2 * (len(saved) - 1), ran


def test_tables_of_finished_steps_go_and_the_others_are_small(spark):
    texts = corpus()
    root = Path(Scratch(spark, "t").root.removeprefix("file:")).parent
    before = set(root.iterdir()) if root.exists() else set()
    grouped = near_copies.near_groups(documents(spark, texts))
    left = {p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - before}
    assert left == {"near-groups"}
    got = {r.doc_id: r.component_id for r in grouped.collect()}
    assert [got[i + 1] for i in range(len(texts))] == brute(texts)

    scratch = Scratch(spark, "t")
    scratch.save(documents(spark, texts), "texts")
    files = list(Path(scratch.root.removeprefix("file:")).rglob("*.parquet"))
    assert {pq.ParquetFile(f).metadata.row_group(0).column(1).compression for f in files} == {"ZSTD"}
    scratch.clear()
    assert not scratch.paths and not Path(scratch.root.removeprefix("file:")).exists()
