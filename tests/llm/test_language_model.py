import math
import random
import zlib
from collections import Counter

import numpy as np
from helpers import SCHEMA, clashing, documents

from shelfwise.llm import language_model as lm
from shelfwise.llm.common import Scratch


def corpus():
    rng = random.Random(9)
    order = {}
    words = ["The", "of", "été,", "x|y", *[f"v{i}" for i in range(400)]]
    texts = []
    for _ in range(300):
        w = ["the"]
        for _ in range(rng.randint(1, 80)):
            after = order.setdefault(w[-1].lower(), rng.sample(words, 8))
            w.append(rng.choice(after if rng.random() < 0.8 else words))
        texts.append(rng.choice([" ", "\n", "\x0b "]).join(w))
    return texts + ["", None, "unheard-of words here", "the " * 20_000, texts[0], texts[0]]


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def test_base_equals_plain_counting_and_the_model_beats_it(spark):
    texts = corpus()
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(1, len(texts) + 1)]
    counts = Counter(t for x, h in zip(texts, held, strict=True) if not h for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    docs = clashing(documents(spark, texts), "held_out", "h", "c", "row", "rare")
    got = {r.doc_id: r for r in lm.score_texts(docs).collect()}
    assert len(got) == len(texts)
    for i, (x, h) in enumerate(zip(texts, held, strict=True), 1):
        r, t = got[i], tokens(x)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (h, len(t), n)
        assert r.n_known == sum(counts[w] > 0 for w in t)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    gain = sum(r.score - r.base_score for i, r in got.items() if r.held_out and i <= 300)
    assert gain / sum(r.n_tokens for i, r in got.items() if r.held_out and i <= 300) > 0.1


def test_probabilities_of_all_tokens_sum_to_one(spark):
    docs = documents(spark, corpus())
    vocab = Scratch(spark, "t").save(lm.vocabulary(docs), "vocabulary")
    known = lm.unigrams(vocab)
    table = vocab.toPandas()
    t = lm.Tokens(table["h"].to_numpy().view(np.uint64), table["ending"].to_numpy(), np.zeros(len(table), int))
    classes = known.classes(t)
    inside = 10 ** known.within(table["c"].to_numpy(), classes)
    unknown = 10 ** known.within(np.zeros(lm.CLASSES, int), np.arange(lm.CLASSES))
    for k in range(lm.CLASSES):
        seen = inside[classes == k].sum()
        if k >= lm.SINGLES:
            assert math.isclose(seen + unknown[k], 1, rel_tol=1e-9)
        else:
            assert seen in (0, 1)
    weights = lm.train(docs, known)
    rows = lm.Tokens.of([b"the v1 v2 of"]).features()
    logs = [lm.class_logs(weights, known.prior, rows, np.full(len(rows), k)) for k in range(lm.CLASSES)]
    assert np.allclose(np.exp(logs).sum(axis=0), 1, atol=1e-5)
    assert np.abs(weights).max() > 0.1


def test_scores_do_not_depend_on_how_the_rows_are_split(spark):
    docs = documents(spark, corpus()[:120] + ["the same again"] * 40)
    seen = []
    for n in (1, 8, 61):
        seen.append({r.doc_id: r.score for r in lm.score_texts(docs.repartition(n)).collect()})
    for other in seen[1:]:
        assert all(math.isclose(other[i], s, rel_tol=1e-6) for i, s in seen[0].items())


def test_a_gradient_equals_one_made_token_by_token():
    rng = np.random.default_rng(5)
    t = lm.Tokens.of([" ".join(f"v{i}" for i in rng.integers(0, 30, 400)).encode() for _ in range(3)])
    rows, classes = t.features(), t.endings
    weights = rng.normal(size=(3 * lm.TABLE, lm.CLASSES)).astype(np.float32)
    prior = np.zeros(lm.CLASSES, np.float32)
    got = lm.Gradient(prior, weights)
    got.add(rows, classes)
    observed, expected = np.zeros((2, 3 * lm.TABLE, lm.CLASSES))
    for places, c in zip(rows, classes, strict=True):
        z = np.exp(weights[places].astype(float).sum(axis=0))
        for p in places:
            observed[p, c] += 1
            expected[p] += z / z.sum()
    assert np.array_equal(got.observed, observed) and np.allclose(got.expected, expected, atol=1e-3)
    moved = lm.step(weights, observed, expected)
    up = (observed > expected + 0.1) & (moved <= weights)
    assert not up.any() and np.array_equal(moved[~observed.any(axis=1)], weights[~observed.any(axis=1)])


def test_sums_of_tasks_are_put_together_block_by_block():
    rng = np.random.default_rng(6)
    weights, prior = np.zeros((3 * lm.TABLE, lm.CLASSES), np.float32), np.zeros(lm.CLASSES, np.float32)
    whole, batches = lm.Gradient(prior, weights), []
    for _ in range(3):
        t = lm.Tokens.of([" ".join(f"v{i}" for i in rng.integers(0, 30, 200)).encode()])
        part = lm.Gradient(prior, weights)
        for total in (part, whole):
            total.add(t.features(), t.endings)
        batches += [lm._sums_batch(*x) for x in part.packed()]
    got = np.zeros((6 * lm.TABLE, lm.CLASSES))
    for batch in lm._merged(iter(batches)):
        for block, at, sums in lm._unpacked(batch):
            got[block * lm.BLOCK + at] += sums
    assert np.allclose(got, np.concatenate([whole.observed, whole.expected]), atol=1e-4)
    assert list(lm._merged(iter([]))) == []


def test_class_logs_equal_a_plain_softmax():
    rng = np.random.default_rng(7)
    t = lm.Tokens.of([" ".join(f"v{i}" for i in rng.integers(0, 9, 300)).encode(), b""])
    weights = rng.normal(size=(3 * lm.TABLE, lm.CLASSES)).astype(np.float32)
    prior = rng.normal(size=lm.CLASSES).astype(np.float32)
    got = lm.class_logs(weights, prior, t.features(), t.endings)
    for places, c, log in zip(t.features(), t.endings, got, strict=True):
        z = prior.astype(float) + weights[places].astype(float).sum(axis=0)
        assert abs(z[c] - np.log(np.exp(z).sum()) - log) < 1e-4


def plain_weights(known, shares):
    """The rounds of training, token by token and class by class."""
    weights = {}

    def chances(places):
        z = [float(known.prior[c]) + sum(weights.get((p, c), 0.0) for p in places) for c in range(lm.CLASSES)]
        total = sum(map(math.exp, z))
        return [math.exp(x) / total for x in z]

    for share in shares:
        observed, expected = Counter(), Counter()
        for text in share:
            t = lm.Tokens.of([text.encode()])
            for places, c in zip(t.features().tolist(), known.classes(t).tolist(), strict=True):
                p = chances(places)
                for place in places:
                    observed[place, c] += 1
                    for k in range(lm.CLASSES):
                        expected[place, k] += p[k]
        for key, e in expected.items():
            o, e = observed[key] + lm.EASE, e + lm.EASE
            mean = e if abs(o - e) < 1e-6 * e else (o - e) / math.log(o / e)
            weights[key] = weights.get(key, 0.0) + lm.RATE * (o - e) / mean
    return chances


def test_scores_equal_a_model_trained_token_by_token(spark):
    texts = [x[:200] for x in corpus()[:60]] + ["never heard", ""]
    docs = documents(spark, texts)
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(1, len(texts) + 1)]
    learnt = [x for x, h in zip(texts, held, strict=True) if not h]
    round_of = {r.text: r.r for r in docs.selectExpr("text", f"pmod(xxhash64(text), {lm.ROUNDS}) AS r").collect()}
    known = lm.unigrams(Scratch(spark, "t").save(lm.vocabulary(docs), "vocabulary"))
    chances = plain_weights(known, [[x for x in learnt if round_of[x] == r] for r in range(lm.ROUNDS)])
    counts = Counter(w for x in learnt for w in tokens(x))
    kind = {w: int(known.classes(lm.Tokens.of([b"" if w is None else w]))[0]) for x in texts for w in tokens(x)}
    size, types = Counter(), Counter()
    for w, c in counts.items():
        size[kind[w]] += c
        types[kind[w]] += 1
    got = {r.doc_id: r.score for r in lm.score_texts(docs).collect()}
    for i, x in enumerate(texts, 1):
        want = 0.0
        for places, w in zip(lm.Tokens.of([x.encode()]).features().tolist(), tokens(x), strict=True):
            k = kind[w]
            want += math.log10(chances(places)[k])
            if k >= lm.SINGLES:
                own = max(counts[w] - lm.DISCOUNT, 0.5) if counts[w] else lm.DISCOUNT * types[k] + lm.UNSEEN
                want += math.log10(own / (size[k] + lm.UNSEEN))
        assert math.isclose(got[i], want, rel_tol=1e-4)


def test_nothing_learnt_null_ids_and_empty_tables(spark):
    i = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = lm.score_texts(spark.createDataFrame([(i, "a b", None, None, 1)] * 2, SCHEMA)).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(True, 3, 0, 0, 0.0)] * 2
    got = lm.score_texts(spark.createDataFrame([(None, "a a", None, None, 1)], SCHEMA)).first()
    assert (got.held_out, got.n_known, got.train_tokens) == (False, 3, 3)
    assert lm.score_texts(spark.createDataFrame([], SCHEMA)).count() == 0
