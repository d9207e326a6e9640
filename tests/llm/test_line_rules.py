import random
from collections import Counter, defaultdict

from helpers import SCHEMA, clashing, documents, records

from shelfwise.llm import line_rules

COLS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_cut_lines", "n_left_words"]


def brute(rows, line_docs, share, most=200):
    def normal(line):
        return b" ".join(line.encode().lower().split())

    hosts, seen = Counter(r[2] for r in rows), defaultdict(set)
    for i, (_, text, host) in enumerate(rows):
        for line in (text or "").split("\n"):
            if normal(line):
                seen[host, normal(line)].add(i)
    out = []
    for doc_id, text, host in rows:
        text = text or ""
        w = text.encode().split()
        lines = [x for x in text.split("\n") if x.encode().split()]
        tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        cut = [x for x in lines if (n := len(seen[host, normal(x)])) > line_docs and n > min(share * hosts[host], most)]
        left = len(w) - sum(len(x.encode().split()) for x in cut)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out.append((doc_id, len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"),
                    len(lines) - len(set(lines)), len(covered), failed, not failed and left >= 50 and left >= len(w) / 2,
                    len(cut), left))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["É|", "a#b", "the", "of"] * 20
    shared = [" ".join(rng.choices(words, k=30)) for _ in range(5)]
    texts = []
    for _ in range(120):
        lines = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(rng.randint(1, 5))]
        lines += rng.choices(shared, k=rng.randint(0, 3)) + rng.choices(["", "\t", lines[0]], k=2)
        text = rng.choice(["\n", "\n \n"]).join(lines)
        texts.append((text.upper() if rng.random() < 0.2 else text, rng.choice(["a", "a", "b", None]), "en"))
    texts += [("", "a", None), (None, None, None), ("x y z " * 3000, "a", "en"), ("a b a b a b", "b", "en"), ("\x0b one\r\n", "b", "en")]
    docs = clashing(documents(spark, texts), "row", "host", "lines", "h")
    got = records(line_rules.line_verdicts(docs, 8, 0.2), *COLS)
    assert got == brute([(i, t, s) for i, (t, s, _) in enumerate(texts, 1)], 8, 0.2)
    assert any(r[8] for r in got) and any(r[7] for r in got)
    few = records(line_rules.line_verdicts(docs, 3, 0.9, 6), *COLS)
    assert few == brute([(i, t, s) for i, (t, s, _) in enumerate(texts, 1)], 3, 0.9, 6)
    assert sum(r[8] for r in few) > sum(r[8] for r in records(line_rules.line_verdicts(docs, 3, 0.9), *COLS))


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = " ".join(f"v{i}" for i in range(80))
    docs = spark.createDataFrame([(None, text, "en", "h", 1)] * 3 + [(2, text, "en", None, 1)], SCHEMA)
    got = records(line_rules.line_verdicts(docs, 2, 0.0), "doc_id", "n_words", "kept", "n_left_words")
    assert got == sorted([(None, 80, False, 0)] * 3 + [(2, 80, True, 80)], key=repr)
    assert line_rules.line_verdicts(spark.createDataFrame([], SCHEMA)).count() == 0
