import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from helpers import SCHEMA, clashing, documents
from tokenizers import Tokenizer

from shelfwise.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_alone_have_the_ids_that_they_have_in_a_text():
    tok, ids = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    rng = random.Random(4)
    words = letters + ["".join(rng.choices(letters, k=rng.randint(2, 12))) for _ in range(3000)]
    words += ["".join(rng.choices("theandéßÄñ.,&$|'1", k=rng.randint(1, 14))) for _ in range(3000)]
    for w in words:
        want = tok.encode(w, add_special_tokens=False).ids
        assert np.frombuffer(ids.of(w.encode()), "<u4").tolist() == want, w


def test_a_chunk_asks_for_each_word_once(monkeypatch):
    """Copies of a word, capitals and marks at its end cost no further look-up, and ids that were forgotten come again."""
    asked = Counter()

    class Counted(packing.WordIds):
        def get(self, word, *other):
            asked[word] += 1
            return super().get(word, *other)

    tok, ids = Tokenizer.from_file(PATH), Counted(PATH)
    texts = ["The cat, the CAT; naïve. Naïve x1 THE\x0bcat", "", " \t\n", "a\xa0b  the. ... İ K Σ", "the" * 900] * 200
    for words in (packing.CACHE_WORDS, 3, 3):
        monkeypatch.setattr(packing, "CACHE_WORDS", words)
        asked.clear()
        flat, starts = ids.of_texts(pa.array(texts))
        assert max(n for w, n in asked.items() if w) == 1
        assert asked["cat"] and not asked["CAT;"] and not asked["CAT"]
        for t, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
            assert flat[a:b].tolist() == tok.encode(t, add_special_tokens=False).ids


def check(spark, texts, capacity, **kw):
    """Every id of every text is placed once, sequences are gapless; returns the number of sequences."""
    docs = clashing(documents(spark, texts), "piece", "group", "length", "offset")
    rows = packing.pack(docs, PATH, capacity, **kw).collect()
    tok = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert len(by_doc) == len(texts)
    for i, t in enumerate(texts, 1):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in got] == [(k, k * capacity) for k in range(-(-len(ids) // capacity))]
        for r in got:
            part = ids[r.start : r.start + r.length]
            assert r.length == len(part) and r.ids_crc32 == zlib.crc32(part.tobytes())
    for parts in by_seq.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_seq)


def test_round_trip_with_awkward_texts(spark):
    rng = random.Random(1)
    words = ["The", "STÄRKE,", "naïve.", "x1", "don't", "<|endoftext|>", "<|EndOfText|>", "é", "ﬁ", "Σ.", "ΑΣ,",
             "12,345.", "a\xa0b", "日本語", "...", "w'll", " ", "\x1c", "🙂"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(50)]
    texts += ["", None, "\n\t ", "word " * 3000, "x" * 5000, texts[0], texts[0]]
    check(spark, texts, 2048)
    check(spark, texts, 64, group_tokens=2000)


def plain_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


def test_as_good_as_a_search_of_all_bins():
    rng = np.random.default_rng(2)
    for capacity in (1, 7, 64, 100, 2048):
        sizes = rng.integers(1, capacity + 1, 400)
        bins, offsets = packing.best_fit_decreasing(sizes, capacity)
        used = np.bincount(bins, weights=sizes)
        assert sorted(capacity - used.astype(int)) == plain_best_fit(sizes.tolist(), capacity)
        assert (offsets + sizes <= capacity).all()


def test_empty_table_null_and_repeated_ids(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    rows = [(None, "a b", "en", "s", 1), (None, "a b", "en", "s", 1), (3, None, None, None, None)] * 2
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    assert len(got) == 6 and len({r.sequence_id for r in got}) == 1
    assert sorted(r.offset for r in got) == [0, 3, 6, 9, 12, 13]


def test_rows_that_are_the_same_spread_over_the_groups(spark):
    """A third of all rows without id and with one text: no group holds much more than its share."""
    rows = [(None, "same words here", "en", "s", 1)] * 3000 + [(i, f"text {i}", "en", "s", 1) for i in range(6000)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH, 64, group_tokens=2500).collect()
    assert len(got) == len(rows)
    groups = defaultdict(int)
    for r in got:
        groups[r.sequence_id >> 32] += 1
    assert len(groups) > 8 and max(groups.values()) < 1.3 * len(rows) / len(groups)
