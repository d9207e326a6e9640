import random

import pytest
from helpers import SCHEMA, clashing, documents, records

from shelfwise.llm import licenses


def brute(texts, templates, threshold):
    sets = {k: licenses.bigrams(v) for k, v in templates.items()}
    lengths = {k: len(licenses.plain_words(v)) for k, v in templates.items()}

    def dice(g, s):
        return 2 * len(g & s) / (len(g) + len(s)) if g else 0

    out = []
    for i, t in enumerate(texts, 1):
        lines = (t or "").split("\n")
        best, matched, passages = [], 0, 0
        for k, part in enumerate([t or "", *lines] if len(lines) > 1 else lines):
            hits = [(-dice(licenses.bigrams(part), s), name) for name, s in sets.items()]
            hits = [h for h in hits if -h[0] >= threshold]
            best += hits
            matched += bool(hits) and (len(lines) == 1 or k > 0)
        w = licenses.plain_words(t or "")
        for name, s in sets.items():
            for at in range(len(w) - 1):
                if lengths[name] > 1 and f"{w[at]} {w[at + 1]}" in s:
                    score = dice(licenses.bigrams(" ".join(w[at : at + lengths[name]])), s)
                    if score >= threshold:
                        best.append((-score, name))
                        passages += 1
        score, name = min(best, default=(0, None))
        out.append((i, name, round(-score, 6), matched, passages))
    return sorted(out, key=repr)


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_equals_brute_force(spark, threshold):
    rng = random.Random(7)
    texts = ["", None, "MIT", "the mit license", " released UNDER the  mit license!", "x " * 40_000, "All\nrights\nreserved"]
    for t in licenses.TEMPLATES.values():
        w = t.split()
        for _ in range(12):
            v = list(w)
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = rng.choice(["foo", "License", "", "under the"])
            filler = " ".join(rng.choices(["alpha", "under", "the", "License,"], k=rng.randint(0, 30)))
            texts.append(rng.choice(["{0}", "{1}\n{0}\n{1}", "{0} {1}", "{0}\n{0}"]).format(" ".join(v), filler))
    texts += ["Released under the MIT License. " * 50]
    docs = clashing(documents(spark, texts), "row", "license", "part", "n", "bigram")
    got = records(licenses.scan(docs, threshold=threshold), "doc_id", "license", "score", "n_matches", "n_passages")
    assert got == brute(texts, licenses.TEMPLATES, threshold)


def test_full_texts_wrapped_headers_and_notices_inside_lines(spark):
    """Each template is found word for word in the middle of other text: wrapped at any width, or within one line."""
    texts, names = [], []
    for name, t in licenses.TEMPLATES.items():
        w = t.split()
        for width in (5, 9, 10_000):
            wrapped = "\n # ".join(" ".join(w[i : i + width]) for i in range(0, len(w), width)).replace(" # ", " ")
            texts.append(f"import os and more {wrapped} def main of it all\n" + "code " * 300)
            names.append(name)
    got = {r.doc_id: r for r in licenses.scan(documents(spark, texts)).collect()}
    for i, name in enumerate(names, 1):
        assert (got[i].license, got[i].score) == (name, 1.0) or got[i].score == 1.0 and got[i].license < name, name
        assert got[i].n_passages >= 1
    other = "Permission is hereby granted to nobody, and the software is provided by persons who like it. " * 20
    assert records(licenses.scan(documents(spark, [other])), "license", "n_passages") == [(None, 0)]


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "All rights reserved", None, None, 1)] * 3, SCHEMA)
    assert records(licenses.scan(docs), "doc_id", "license", "n_matches") == [(None, "proprietary", 1)] * 3
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, {"none": "..."})
