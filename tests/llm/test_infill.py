import hashlib
import random
import re

import duckdb
from helpers import SCHEMA, clashing, documents, records

from shelfwise.llm import infill

RULE = infill.Rule()


def plain(text, doc_id, cut=100, spm=50):
    """The rule written out on strings, without a buffer or a rotation."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= cut:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def awkward():
    rng = random.Random(3)
    letters = ["a", "é", "日", "🙂", "\n", "\n", "<", ">", "P", "S", "M", "<P", "S>", " ", "\r", " ", "\x00"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(400)]
    texts += [None, "", "\n", "\n\n", "one line", "<P>", "a<S>b", "x\n" * 50_000, "ü" * 200_000, "<", "<P\n>", "same", "same"]
    return texts


def test_equals_the_plain_rule_and_comes_back_exactly(spark):
    texts = awkward()
    docs = clashing(documents(spark, texts), "output", "form", "n", "restored")
    got = {r.doc_id: r for r in infill.restored(infill.infill(docs)).collect()}
    assert len(got) == len(texts)
    forms = set()
    for i, t in enumerate(texts, 1):
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(t, i)
        assert r.restored == (t or "")
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}


def test_shares_and_marks_are_parameters(spark):
    texts = [f"{i}\nb{i}\nc\n" for i in range(300)]
    rule = infill.Rule(cut_percent=40, suffix_first_percent=25)
    got = infill.restored(infill.infill(documents(spark, texts), rule), rule).collect()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(texts[r.doc_id - 1], r.doc_id, 40, 25)
        assert r.restored == texts[r.doc_id - 1]
    other = infill.Rule(prefix="⟨pre⟩", suffix="⟨suffix⟩", middle="⟨m⟩")
    got = infill.restored(infill.infill(documents(spark, texts), other), other).collect()
    assert all(r.restored == texts[r.doc_id - 1] and "⟨suffix⟩" in r.output for r in got)


def test_rotation_is_its_own_inverse():
    for start, cut, end in [(0, 0, 5), (0, 5, 5), (1, 3, 6), (2, 4, 9), (0, 1, 2)]:
        b = bytearray(b"abcdefghij")
        infill.rotate(b, start, cut, end)
        assert b == b"abcdefghij"[:start] + b"abcdefghij"[cut:end] + b"abcdefghij"[start:cut] + b"abcdefghij"[end:]
        infill.rotate(b, start, start + end - cut, end)
        assert b == b"abcdefghij"


def test_null_and_repeated_ids_and_empty_tables(spark):
    rows = [(None, "a\nb\nc", None, None, None), (None, "a\nb\nc", "x", "y", 1), (None, None, None, None, None), (4, "q", None, None, None), (4, "r\ns", None, None, None), (-4, "r\ns", None, None, None)]
    got = infill.infill(spark.createDataFrame(rows, SCHEMA))
    want = sorted([(i, *plain(t, i)) for i, t, *_ in rows], key=repr)
    assert records(got, *infill.NAMES) == want
    assert infill.infill_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql_agrees_on_awkward_rows(spark):
    docs = documents(spark, [t for t in awkward() if "\x00" not in (t or "")])
    con = duckdb.connect()
    con.register("frame", docs.toPandas())
    con.execute("CREATE VIEW documents AS SELECT doc_id, text FROM frame")
    cursor = con.execute(infill.ORACLE)
    names = [d[0] for d in cursor.description]
    got = sorted(cursor.fetchall(), key=repr)
    assert records(infill.infill_digests(docs), *names) == got
