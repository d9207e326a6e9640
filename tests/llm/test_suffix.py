import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import SCHEMA, clashing, documents, records

from shelfwise.llm import suffix

COLS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute(texts, length):
    seen, out = set(), []
    for i, t in enumerate(texts, 1):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(raw[p : p + length])
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeéß", k=rng.randint(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randint(15, 80))) for _ in range(8)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(3)]
        texts.append("\n".join([parts[0], rng.choice(passages), parts[1], rng.choice(passages)[rng.randint(0, 40) :], parts[2]]))
    texts += [texts[3]] * 12 + [texts[5][: rng.randint(90, 300)] for _ in range(10)]
    for _ in range(20):
        t = list(rng.choice(texts[:60]))
        t[rng.randrange(len(t))] = "#"
        texts.append("".join(t))
    return texts + ["", None, "x", "a" * 1500, "ab" * 400, "a" * 100, "a" * 99, "c" * 101, passages[0] * 3]


@pytest.mark.parametrize("length", [100, 37])
def test_equals_brute_force(spark, length):
    texts = corpus()
    got = records(suffix.removal_digests(documents(spark, texts), length), *COLS)
    assert got == sorted(brute(texts, length), key=repr)


def test_cleaned_texts_stay_valid_and_rows_stay(spark):
    texts = corpus(2)
    docs = clashing(documents(spark, texts).repartition(3), "doc", "at", "row", "kept", "places", "copy")
    got = suffix.without_repeats(docs)
    assert got.columns == docs.columns
    by_id = {r.doc_id: r.text for r in got.collect()}
    assert len(by_id) == len(texts)
    for (i, n, removed, _, sha), t in zip(brute(texts, 100), texts, strict=True):
        if t is None:
            assert by_id[i] is None
        elif t.isascii():
            assert hashlib.sha256(by_id[i].encode()).hexdigest() == sha
        else:
            assert n - removed <= len(by_id[i].encode()) <= n


def test_repeated_rows_null_ids_and_empty_tables(spark):
    long = "the quick brown fox " * 8 + "z" * 120
    rows = [(None, long, "en", "s", 1), (4, long, "en", "s", 1), (4, long, "en", "s", 1), (4, "other", "en", "s", 1)]
    got = records(suffix.removal_digests(spark.createDataFrame(rows, SCHEMA)), "doc_id", "n_bytes", "n_removed")
    own = brute([long], 100)[0][2]
    assert sorted(got, key=repr) == sorted([(None, 280, own), (4, 280, 280), (4, 280, 280), (4, 5, 0)], key=repr)
    assert suffix.removal_digests(spark.createDataFrame([], SCHEMA)).count() == 0
    assert suffix.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_of_one_id_are_told_apart_by_their_whole_digest(spark):
    rng, seen = random.Random(4), {}
    while True:
        text = "".join(rng.choices("abcdefgh é", k=150))
        bits = zlib.crc32(text.encode()) & (1 << 23) - 1
        if seen.setdefault(bits, text) != text:
            break
    rows = [(i, t, "en", "s", 1) for i in (None, 3) for t in (seen[bits], text)]
    docs = spark.createDataFrame([rows[0], rows[1]], SCHEMA)
    assert [r.n_removed for r in suffix.removal_digests(docs).collect()] == [0, 0]
    assert records(suffix.without_repeats(docs), "text") == records(docs, "text")
    both = suffix.removal_digests(spark.createDataFrame(rows + rows[1:2], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_removed == r.n_bytes) for r in both) == [(0, False), (0, False), (0, True), (3, True), (3, True)]
    spark_side = docs.selectExpr("text", "xxhash64(text) AS h").collect()
    assert all(r.h == suffix._sub(r.text.encode()) for r in spark_side)
