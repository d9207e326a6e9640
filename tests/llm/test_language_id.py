import random
import zlib

import numpy as np
import pyarrow.parquet as pq
from helpers import SCHEMA, clashing, documents

from shelfwise.llm import language_id as lid


def test_bundle_is_the_sum_of_bound_permuted_letters():
    v = lid.letter_vectors()
    p = lid.Profiles()
    grams, owner = lid.trigrams(["ab c", "Zé"])
    assert owner.tolist() == [0] * 4 + [1] * 2
    sym = lid._symbols()
    s = [0, 1, 2, 0, 3, 0]
    want = sum(np.roll(v[a], 2).astype(int) * np.roll(v[b], 1) * v[c] for a, b, c in zip(s, s[1:], s[2:], strict=False))
    assert np.array_equal(p.bundle(grams[:4], np.ones(4)), want)
    assert sym[ord("Z")] == 26 and sym[ord("É")] == sym[ord("é")] >= 27 and sym[ord("1")] == 0


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    got = {r.doc_id: r for r in lid.identify(spark.read.parquet(path)).collect()}
    truth = pq.read_table(path).to_pylist()
    held = [(got[d["doc_id"]], d) for d in truth if zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(r.lang_pred == d["lang"] for r, d in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_awkward_rows(spark):
    texts = [("hello world the and", "s", "en"), ("der die und das", "s", "de")] * 20
    texts += [("", "s", "en"), (None, "s", "en"), ("12 .. 3", "s", "de"), ("und der", "s", None), ("the " * 90_000, "s", "fr")]
    docs = clashing(documents(spark, texts), "held_out", "score", "gram")
    got = {r.doc_id: r for r in lid.identify(docs).collect()}
    assert len(got) == len(texts)
    assert [got[i].lang_pred for i in (41, 42, 43)] == ["und"] * 3 and got[42].score == 0
    assert got[44].lang_pred == "de" and got[45].lang_pred in ("en", "fr")
    assert lid.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = lid.identify(spark.createDataFrame([(None, "abc", None, None, 1)] * 2, SCHEMA)).collect()
    assert [(r.doc_id, r.held_out, r.lang_pred, r.score) for r in alone] == [(None, False, "und", 0.0)] * 2


def test_letters_of_all_planes_count(spark):
    deseret = "\U00010428\U0001042f\U00010445 \U00010430\U0001042d"
    rows = [(i, f"{deseret} " * 20, "dsr", "s", 1) for i in range(20)] + [(100 + i, "plain words of letters " * 9, "en", "s", 1) for i in range(20)]
    rows += [(500, deseret, None, "s", 1), (501, "\U0001f600 12 !", None, "s", 1)]
    got = {r.doc_id: r for r in lid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[500].lang_pred == "dsr" and got[500].score > 0.3
    assert got[501].lang_pred == "und" and got[501].score == 0.0


def plain_bundle(text, vectors):
    """A text's vector, trigram by trigram: each letter rolled by its place, the three multiplied, all added up."""
    out, symbols = np.zeros(lid.DIMENSIONS), [0]
    for c in text:
        low = ord(c.lower()[0])
        s = 0 if not c.isalpha() else low - 96 if 97 <= low <= 122 else 27 + low % 37
        if s or symbols[-1]:
            symbols.append(s)
    if symbols[-1]:
        symbols.append(0)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
        out += np.roll(vectors[a], 2) * np.roll(vectors[b], 1) * vectors[c]
    return out


def test_predictions_equal_bundles_made_one_trigram_at_a_time(spark):
    rng = random.Random(3)
    letters = {"aa": "abcdeé", "bb": "cdefgß", "cc": "абвг"}
    make = lambda k, n: " ".join("".join(rng.choices(letters[k], k=rng.randint(1, 7))) for _ in range(n))
    rows = [(i, make(k, 30), k, "s", 1) for i, k in enumerate(["aa", "bb", "cc"] * 8)]
    rows += [(900 + i, make(k, 2 + i) + " 7!", None, "s", 1) for i, k in enumerate(["aa", "bb", "cc"] * 4)]
    vectors, sums = lid.letter_vectors().astype(float), {}
    for i, text, lang, *_ in rows:
        if lang and zlib.crc32(str(i).encode()) % 5:
            sums[lang] = sums.get(lang, 0) + plain_bundle(text, vectors)
    names = sorted(sums)
    for r in lid.identify(spark.createDataFrame(rows, SCHEMA)).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        v = plain_bundle(text, vectors)
        cosines = [v @ sums[n] / np.linalg.norm(v) / np.linalg.norm(sums[n]) for n in names]
        assert r.lang_pred == names[int(np.argmax(cosines))]
        assert abs(r.score - max(max(cosines), 0)) < 1e-5
