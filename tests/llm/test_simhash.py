import random

import xxhash
from helpers import SCHEMA, clashing, documents, records

from shelfwise.llm import simhash

COLS = ["doc_id", "fingerprint", "component_id"]


def brute(texts):
    """Fingerprints bit by bit, components by all pairs."""
    fps = []
    for t in texts:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and root[j] < root[i]:
                    root[i], changed = root[j], True
    return [(i + 1, f"{f:016x}", root[i] + 1) for i, f in enumerate(fps)]


def test_equals_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 300))) for _ in range(40)]
    for _ in range(60):
        w = rng.choice(texts[:40]).split()
        w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w).upper() if rng.random() < 0.2 else "\n".join(w))
    texts += [texts[0]] * 30 + ["", None, "  \t ", "one", "one two", "Ünë two three", "x " * 50_000]
    got = simhash.near_duplicates(documents(spark, texts))
    assert records(got, *COLS) == sorted(brute(texts), key=repr)
    kept = simhash.keep_one(clashing(documents(spark, texts), "fp", "component_id", "n", "_x"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(texts)})
    assert "component_id" in kept.columns


def test_links_find_every_pair_within_two_bits(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        fps |= {f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(6)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = records(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")), "a", "b")
    mask = (1 << 64) - 1
    want = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & mask).bit_count() <= 2]
    assert got == sorted(want, key=repr) and len(want) > 100


def test_a_chain_is_one_component(spark):
    from shelfwise.llm.common import Scratch, components

    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    assert records(got, "node", "root") == sorted([(i, 0) for i in range(201)] + [(500, 500), (501, 500)], key=repr)


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert simhash.near_duplicates(documents(spark, ["a"]).limit(0)).count() == 0
    rows = [(None, "a b c d", "en", "s", 1), (5, "a b c d", "en", None, 1), (5, "a b c d", "en", None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.component_id for r in simhash.near_duplicates(docs).collect()) == [5, 5, 5]
    assert simhash.keep_one(docs).count() == 1


def test_rows_that_share_an_id_or_have_none_stay(spark):
    texts = [f"{i} first words {i} then other words {i * i}" for i in range(12)]
    rows = [(None if i < 4 else 7 if i < 8 else i, t, "en", "s", 1) for i, t in enumerate(texts)]
    rows += [(3, texts[0], "en", "s", 1), (None, texts[9], "en", "s", 1), (7, texts[5], "en", "s", 1)]
    kept = records(simhash.keep_one(spark.createDataFrame(rows, SCHEMA)), "doc_id", "text")
    assert kept == sorted([(3, texts[0]), *((r[0], r[1]) for r in rows[1:12])], key=repr)


def test_postings_do_not_pass_through_the_driver(spark, tmp_path):
    """A small table of fingerprints has many times its rows in postings, and Spark's estimate does not show it."""
    rng = random.Random(6)
    prints = [rng.getrandbits(64) - (1 << 63) for _ in range(300)]
    prints += [p ^ 5 for p in prints[:40]]
    spark.createDataFrame([(p,) for p in prints], "fp long").write.parquet(f"{tmp_path}/prints")
    links = simhash.links(spark.read.parquet(f"{tmp_path}/prints"))
    got = {frozenset(r) for r in links.collect()}
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    assert got == {frozenset((p, p ^ 5)) for p in prints[:40]}
