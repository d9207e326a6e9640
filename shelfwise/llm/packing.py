"""Packing documents into sequences of bounded length by best-fit decreasing."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import Scratch, lean, text_chunks, texts

CAPACITY = 2048
END_ID = 0
# Pieces are dealt to groups of about so many tokens, each packed by one task: its memory and time are bounded, and
# a group leaves at most a few sequences in some 8,000 less than full.
GROUP_TOKENS = 1 << 24
# Words whose ids a task remembers; the older half is forgotten when it is full.
CACHE_WORDS = 200_000
# Words are looked up once for so many bytes of text.
CHUNK_BYTES = 4 << 20


class WordIds(dict):
    """Ids of words, as bytes of 32-bit integers, worked out when a word is first asked for.

    The tokenizer never joins symbols over white space, so the ids of a text are those of its words in turn. It also
    parts letters from the marks after them and puts letters in lower case, so a word of plain letters is looked up in
    lower case and without the marks at its end. Of the texts of a chunk each such word is looked up a single time.
    """

    MARKS = ".,;:!?&$|"
    PLAIN = "\u0130"  # below it, lower case is a letter for a letter and nothing is composed

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # What the model sees of each plain letter; letters never part, so a word is the letters in a row.
        self.symbols = {
            c: "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c)))
            for c in range(ord(self.PLAIN)) if chr(c).isalpha()
        }
        self.letters = "".join(map(chr, self.symbols))
        self.plain = f"^[{self.letters}]+[{re.escape(self.MARKS)}]*$"
        self.old: dict[str, bytes] = {}

    def _lists(self, *words: pa.StringArray) -> pa.ListArray:
        """The ids of each of ``words``."""
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        keys = [w for part in words for w in part.to_numpy(zero_copy_only=False)]
        ids = list(map(self.get, keys))
        old, tokenize = self.old.get, self.model.tokenize
        for i, known in enumerate(ids):
            if known is None:
                word = keys[i]
                known = old(word)
                if known is None:
                    if word.isascii() and word.isalpha():
                        new = [t.id for t in tokenize(word)]
                    elif word.isalpha() and max(word) < self.PLAIN:
                        new = [t.id for t in tokenize(word.translate(self.symbols))]
                    else:
                        new = self.tokenizer.encode(word, add_special_tokens=False).ids
                    known = array("I", new).tobytes()
                ids[i] = self[word] = known
        ends = np.zeros(len(ids) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, ids), np.int32, len(ids)) // 4, out=ends[1:])
        return pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(ids), np.uint32))

    def of_texts(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` in a row, and the place at which each text's begin, and the last one's end."""
        split = pa.compute.ascii_split_whitespace(texts)
        said = split.values.dictionary_encode()
        words = said.dictionary
        plain = pa.compute.match_substring_regex(words, self.plain)
        lower = pa.compute.utf8_lower(pa.compute.utf8_rtrim(words, self.MARKS))
        stems = pa.compute.if_else(plain, lower, words).dictionary_encode()
        marks = pa.compute.if_else(plain, pa.compute.utf8_ltrim(words, self.letters), "").dictionary_encode()
        # A word is its stem and the marks after it.
        parts = np.empty(2 * len(words), np.int32)
        parts[::2] = stems.indices
        parts[1::2] = marks.indices.to_numpy() + len(stems.dictionary)
        found = self._lists(stems.dictionary, marks.dictionary).take(pa.array(parts))
        words = pa.ListArray.from_arrays(pa.array(found.offsets.to_numpy()[::2]), found.values)
        found = words.take(said.indices)
        return found.values.to_numpy(), found.offsets.to_numpy()[split.offsets.to_numpy()]

    def of(self, raw: bytes) -> bytes:
        return self.of_texts(pa.array([raw.decode()]))[0].astype("<u4").tobytes()


_loaded: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every document's ids and a closing id, cut only where too long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _loaded.get(tokenizer) or _loaded.setdefault(tokenizer, WordIds(tokenizer))
        end, wide = np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for part in text_chunks(batch, "text", CHUNK_BYTES):
                rows = []
                flat, starts = ids_of.of_texts(part.column("text"))
                for doc, a, b in zip(part.column("doc_id").to_pylist(), starts[:-1], starts[1:], strict=True):
                    ids = flat[a:b].astype("<u4").tobytes() + end
                    for i, at in enumerate(range(0, len(ids), wide)):
                        cut = ids[at : at + wide]
                        rows.append((doc, i, at // 4, len(cut) // 4, zlib.crc32(cut)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


class OpenBins:
    """Open bins by room left, under a segment tree over all possible rooms: the tightest fit in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)  # number of open bins below each node
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        self._count(room, 1)

    def _count(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.tree[node] += change
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes the bin with the least room of at least ``size``; its room and number, or None."""
        node = size + self.leaves
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._count(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every size, longest first, each into the open bin that it leaves the least room in."""
    bins, offsets = np.empty(sizes.size, np.int64), np.empty(sizes.size, np.int64)
    open_bins, made = OpenBins(capacity), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        room, bin_id = open_bins.take(size) or (capacity, made)
        made += bin_id == made
        bins[i], offsets[i] = bin_id, capacity - room
        if room > size:
            open_bins.add(room - size, bin_id)
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Places of all pieces: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is one piece with the closing id alone. Repeated rows, and rows without ``doc_id``, are packed
    each on their own. Equal lengths keep any order. A sequence is gapless from offset 0 and has at most ``capacity``
    ids. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    # The number is written, so a piece stays in its group; by its values, rows that are the same would share one.
    cut = scratch.save(pieces(docs, tokenizer, capacity).withColumn("nth", F.monotonically_increasing_id()), "pieces")
    total = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("nth"), F.lit(groups)))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit_decreasing(group["length"].to_numpy(), capacity)
        first = group["group"][0].as_py() << 32
        group = group.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))
        return group.drop_columns(["group", "nth"])

    return dealt.groupBy("group").applyInArrow(run, f"{PIECE_SCHEMA}, sequence_id long, offset long")


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
