"""Language identification with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import text_chunks

DIMENSIONS = 1024
LETTERS = 64
GRAM = 3
SEED = 11
UNKNOWN = "und"
BETWEEN = 0  # the symbol of anything that is no letter


def letter_vectors(dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """A random vector of +1 and -1 for each symbol."""
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (LETTERS, dimensions))


class Profiles:
    """Vectors of trigrams and their bundles.

    A letter is permuted (rolled) by its distance from the trigram's end and the three are bound by multiplication; the
    vectors of a text's trigrams are bundled by addition. The first two letters are bound once for all pairs.
    """

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        v = letter_vectors(dimensions, seed)
        self.last = v
        self.pairs = (np.roll(v, 2, axis=1)[:, None, :] * np.roll(v, 1, axis=1)[None, :, :]).reshape(LETTERS**2, -1)

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.last.shape[1])
        for at in range(0, grams.size, 2048):  # bounded memory for texts with very many trigrams
            g = grams[at : at + 2048]
            bound = self.pairs[g // LETTERS] * self.last[g % LETTERS]
            out += counts[at : at + 2048].astype(np.float32) @ bound.astype(np.float32)
        return out


def _symbols(size: int = 0x110000) -> np.ndarray:
    """Symbol of every code point of all planes: a-z have their own, other letters share 37 by their code, all else is a gap."""
    chars = [chr(c) for c in range(size)]
    out = np.zeros(size, np.uint8)
    for c, ch in enumerate(chars):
        if 0xD800 <= c < 0xE000 or not ch.isalpha():
            continue
        low = ord(ch.lower()[0])
        out[c] = low - 96 if 97 <= low <= 122 else 27 + low % (LETTERS - 27)
    return out


_tables: dict[str, object] = {}


def _table(name: str, make):
    if name not in _tables:
        _tables[name] = make()
    return _tables[name]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of all texts in turn and, for each, the index of its text; runs of gaps count as one."""
    table = _table("symbols", _symbols)
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = np.array([c.size for c in codes], np.int64)
    flat = np.concatenate([np.zeros(0, "<u4"), *codes])
    symbol = table[flat].astype(np.int32)
    text = np.repeat(np.arange(sizes.size), sizes)
    # A gap stands before and after every text, and a run of gaps is one.
    ends = np.cumsum(sizes + 2)
    place = np.arange(flat.size) + 2 * text + 1
    s = np.zeros(int(ends[-1]) if ends.size else 0, np.int32)
    s[place] = symbol
    owner = np.repeat(np.arange(sizes.size), sizes + 2)
    same = np.zeros(s.size, bool)
    same[1:] = (s[1:] == BETWEEN) & (s[:-1] == BETWEEN) & (owner[1:] == owner[:-1])
    s, owner = s[~same], owner[~same]
    if s.size < GRAM:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    g = (s[:-2] * LETTERS + s[1:-1]) * LETTERS + s[2:]
    whole = owner[:-2] == owner[2:]
    return g[whole], owner[:-2][whole]


def _rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text, lang, held_out``: rows whose id's checksum is divisible by 5 are never learnt from."""
    held = F.crc32(F.col("doc_id").cast("long").cast("string")) % 5 == 0
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"),
        F.coalesce(held, F.lit(False)).alias("held_out"),
    )


def learn(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """A prototype per language: the bundle of all its texts, of unit length.

    Trigrams are counted per language over all learnt texts; the counts are at most ``LETTERS ** 3`` rows per
    language whatever the size of the corpus, and the sum over texts of bundles is the bundle of the sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in text_chunks(batch, "text"):
                langs = np.array(part.column("lang").to_pylist(), object)
                grams, owner = trigrams(part.column("text").to_pylist())
                for lang in set(langs):
                    found = np.bincount(grams[(langs == lang)[owner]], minlength=LETTERS**3)
                    counts[lang] = counts.get(lang, 0) + found
        for lang, found in counts.items():
            gram = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * gram.size, pa.string()), pa.array(gram), pa.array(found[gram].astype(np.int64))],
                ["lang", "gram", "n"],
            )

    known = _rows(docs).where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    rows = known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    profiles, out = Profiles(dimensions), {}
    table = rows.toArrow()
    langs = np.array(table["lang"].to_pylist(), object)
    for lang in sorted(set(langs)):
        pick = langs == lang
        order = np.argsort(table["gram"].to_numpy()[pick])  # sums in one order, so runs agree
        v = profiles.bundle(table["gram"].to_numpy()[pick][order], table["n"].to_numpy()[pick][order])
        out[lang] = v / max(np.linalg.norm(v), 1e-12)
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, lang_pred, score``.

    ``lang_pred`` is the language whose prototype has the largest cosine with the text's bundle, ties to the first by
    name; ``score`` is that cosine, 0 to 1. A text that is null or has no letter is ``und`` with score 0, and so is
    every text when nothing was learnt. Letters of all planes count. Texts of any length are bundled whole, some thousand
    different trigrams at a time. Repeated rows come out as often as they went in. An empty table gives no rows.
    """
    names = sorted(prototypes)
    spark = docs.sparkSession
    matrix = spark.sparkContext.broadcast(np.array([prototypes[n] for n in names]).reshape(len(names), dimensions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = _table(f"profiles-{dimensions}", lambda: Profiles(dimensions))
        for batch in batches:
            for part in text_chunks(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                grams, owner = trigrams(texts)
                ends = np.searchsorted(owner, np.arange(len(texts) + 1))
                pred, score = [], []
                for i in range(len(texts)):
                    kinds, counts = np.unique(grams[ends[i] : ends[i + 1]], return_counts=True)
                    lettered = kinds.size and not (kinds.size == 1 and kinds[0] == 0)
                    if not names or not lettered:
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    v = profiles.bundle(kinds, counts)
                    cosines = matrix.value @ v / max(np.linalg.norm(v), 1e-12)
                    best = int(np.argmax(cosines))
                    pred.append(names[best])
                    score.append(float(min(max(cosines[best], 0.0), 1.0)))
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    rows = _rows(docs).select("doc_id", "text", "held_out")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out and predicts every row; see ``predict`` for the awkward cases."""
    return predict(docs, learn(docs))
