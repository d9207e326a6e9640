import random
from collections import Counter

import numpy as np
from helpers import SCHEMA, clashing, documents, records

from shelfwise.llm import mixing


def test_targets_stop_at_three_times_the_size():
    got = mixing.targets([10, 600, 1000], [1, 2, 3])
    assert [float(t) for t in got] == [30, 632, 948] and sum(got) == 1610
    assert mixing.targets([0, 0], [1, 2]) == [0, 0]
    assert mixing.targets([5, 0], [1, 2]) == [5, 0]
    assert mixing.targets([], []) == []


def test_quota_tree_deals_every_block():
    blocks = [1000, 0, 37, 5000]
    got = mixing.shard_quotas(blocks, 13)
    assert (got >= 0).all() and got.sum(axis=0).tolist() == blocks
    assert got.sum(axis=1).max() - got.sum(axis=1).min() <= 2
    assert np.array_equal(got, mixing.shard_quotas(blocks, 13))
    big = mixing.shard_quotas([3 * 10**9, 10**9], 4)
    assert big.sum(axis=0).tolist() == [3 * 10**9, 10**9]
    assert (big >= 0).all() and big.sum(axis=1).max() - big.sum(axis=1).min() <= 4 * 6


def test_bundles_follow_the_same_law():
    """Means and spreads of a first shard's quota, from single blocks and from bundles, against the hypergeometric law."""
    for urn, bundle in ((10**9, 1), (1010, 4)):
        got = np.array([mixing.shard_quotas([1200, 2800], 2, seed, urn)[0, 0] for seed in range(1500)]) / bundle
        good, bad, n = 1200 // bundle, 2800 // bundle, 2000 // bundle
        total = good + bad
        mean, var = n * good / total, n * good / total * bad / total * (total - n) / (total - 1)
        assert abs(got.mean() - mean) < 5 * (var / got.size) ** 0.5 and abs(got.var() / var - 1) < 0.2


def corpus():
    rng = random.Random(6)
    texts = [(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 1500))), rng.choice("aab"), "en") for _ in range(50)]
    texts += [("x y\tz\n" * 9, "c", "en"), ("only", None, "en"), (None, "b", "en"), ("", "d", "en"), ("p " * 9000, "a", "en")]
    return texts


def test_sources_meet_their_targets_and_runs_agree(spark):
    texts = corpus()
    docs = clashing(documents(spark, texts), "size", "copy", "digest", "_d")
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(texts)
    taken, goal = Counter(), {}
    for r in got:
        assert r.size == len((texts[r.doc_id - 1][0] or "").split()) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        goal[r.source] = (r.target, r.source_size)
    for s, (target, size) in goal.items():
        assert abs(taken[s] - target) <= 0.5 and target <= 3 * size
    again = mixing.mix_report(documents(spark, texts).repartition(5))
    cols = ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert records(again, *cols) == sorted((tuple(r) for r in got), key=repr)


def test_blocks_are_disjoint_and_shards_level(spark):
    docs = documents(spark, corpus())
    blocks = mixing.mix_blocks(docs, shards=8, block_words=64).collect()
    assert max(Counter((r.doc_id, r["pass"], r.block) for r in blocks).values()) == 1
    shards = Counter(r.shard for r in blocks)
    assert set(shards) == set(range(8)) and max(shards.values()) - min(shards.values()) <= 2
    assert sum(r.drawn for r in blocks) == sum(r.taken for r in mixing.mix_report(docs, 64).collect())


def test_mixed_documents_hold_the_taken_words(spark):
    texts = corpus()
    docs = clashing(documents(spark, texts), "row", "pass", "_parts", "drawn")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
        if len(r.text.split()) == len(texts[r.doc_id - 1][0].split()):
            assert r.text == texts[r.doc_id - 1][0]
    assert words == {r.doc_id: r.taken for r in mixing.mix_report(documents(spark, texts)).collect() if r.taken}


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c", "en", "s", 1)] * 3 + [(1, "a b", "en", "t", 1)], SCHEMA)
    got = records(mixing.mix_report(docs), "doc_id", "size", "taken")
    assert sum(r[2] for r in got) == 11 and len(got) == 4
    assert mixing.mix_report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mixed_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_what_is_taken_comes_out_of_the_tree(spark, monkeypatch):
    """Blocks that the tree gives to no shard are not taken: by the report, by the documents, by the blocks."""
    docs = documents(spark, corpus())
    whole = {r.source: 0 for r in mixing.mix_report(docs).collect()}
    tree = mixing.shard_quotas

    def without_first(blocks, *more):
        quotas = tree(blocks, *more).copy()
        quotas[:, 0] = 0
        return quotas

    monkeypatch.setattr(mixing, "shard_quotas", without_first)
    report = mixing.mix_report(docs).collect()
    first = min(s for s in whole if s is not None)
    assert sum(r.taken for r in report if r.source == first) == 0 < sum(r.taken for r in report)
    assert first not in {r.source for r in mixing.mixed_documents(docs).collect()}


def test_documents_come_in_the_order_of_their_shards(spark):
    docs = documents(spark, corpus())
    place = {}
    for r in mixing.mix_blocks(docs, shards=8).collect():
        key = (r.doc_id, r["pass"])
        if key not in place or r.block < place[key][0]:
            place[key] = (r.block, r.shard, r.order)
    got = [r.doc_id for r in mixing.mixed_documents(docs, shards=8).collect()]
    assert got == [d for d, _ in sorted(place, key=lambda k: place[k][1:])]
    assert got != sorted(got)
