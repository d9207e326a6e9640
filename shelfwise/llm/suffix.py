"""Removal of passages that occurred before, by distributed prefix doubling over suffix positions.

A position of a text is ``(doc, sub, at)``: id, sub-number and byte offset. The sub-number is a 64-bit digest of the text
where a ``doc_id`` comes with several rows, so these have positions of their own, and 0 for ids of a single row, where it
takes next to no room in shuffles.

1. *Anchors.* Every window of ``length`` bytes marks the positions of its least ``GRAM``-byte hash. Equal windows mark
   equal places, so a window can only occur twice if its anchor's gram does. About one position in 35 is an anchor,
   and stands for the run of window starts that may have it.
2. *Doubling.* Positions are sorted by pairs: the rank so far, and the hash of the bytes that all windows of their run
   share. Positions with a pair of their own go, the others get their place in the sorting as new rank. Where the
   bytes that the run's windows touch altogether occurred before, the whole run is covered and goes too. What is left,
   the edges of repeated passages, has its runs cut in ``FAN``, so the shared bytes grow towards ``length``: 32, 83,
   96, 99 and at last 100 of 100, where a run is one window and all but the first of a rank are covered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import Scratch, lean, release, text_chunks, texts
from shelfwise.llm.hashing import BASE, Grams
from shelfwise.session import fits_broadcast

GRAM = 32
FAN = 4
SUB_SEED = 42  # that of Spark's xxhash64
RUN_BITS = 10
RUN_MASK = (1 << RUN_BITS) - 1
NO_ID = -(1 << 63)
ANCHOR_ROWS = 1 << 18
CHUNK = 1 << 20

def _sliding(pick, values: np.ndarray, width: int) -> np.ndarray:
    """``pick`` (minimum or maximum) over every run of ``width`` values."""
    out, size = values, 1
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    n = values.size - width + 1
    return pick(out[:n], out[width - size : width - size + n])


def _gram(length: int) -> int:
    return max(1, min(GRAM, length // 3))


def anchors(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """Anchor places in ``buffer``, the index of each one's text, its gram hash and its context hash."""
    gram = _gram(length)
    width = length - gram + 1
    none = np.zeros(0, np.int64)
    if buffer.size < length:
        return none, none, none, none
    grams = Grams(buffer)
    places = np.arange(buffer.size - gram + 1)
    h = grams.of(slice(0, places.size), slice(gram, None)) | np.uint64(1)
    least = _sliding(np.minimum, h, width)
    room = np.repeat(ends, ends - starts)[: least.size] - places[: least.size]
    least[room < length] = 0
    pad = np.zeros(width - 1, np.uint64)
    best = _sliding(np.maximum, np.concatenate([pad, least, pad]), width)
    at = np.flatnonzero(best == h)
    text = np.searchsorted(starts, at, "right") - 1
    left = np.minimum(length - gram, at - starts[text])
    right = np.minimum(length, ends[text] - at)
    context = grams.of(at - left, at + right) + (left * (2 * length + 1) + right).astype(np.uint64)
    return at, text, h[at].view(np.int64), context.view(np.int64)


def _joined(part: pa.RecordBatch, column: str = "text"):
    """All texts of a batch as one byte array, with their starts and ends."""
    raw = [x.as_py() for x in part.column(column).cast(pa.binary())]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    starts = ends - np.array([len(x) for x in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), starts, ends, raw


def _sub(raw: bytes) -> int:
    """The text's digest as Spark's xxhash64 gives it, signed."""
    return (xxhash.xxh64_intdigest(raw, SUB_SEED) + (1 << 63)) % (1 << 64) - (1 << 63)


ANCHOR_SCHEMA = "key long, ctx long, doc long, sub long, at long, known boolean"


def _subs(raw: list[bytes], several) -> np.ndarray:
    """Sub-numbers of texts: digests where the id has several rows, else 0."""
    return np.array([_sub(x) if d else 0 for x, d in zip(raw, several.to_pylist(), strict=True)], np.int64)


def _anchor_rows(length: int):
    names = [c.split()[0] for c in ANCHOR_SCHEMA.split(", ")]

    def emit(held):
        key, ctx, doc, sub, at = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((at, sub, doc, ctx, key))
        key, ctx, doc, sub, at = key[order], ctx[order], doc[order], sub[order], at[order]
        known = np.zeros(key.size, bool)  # a later place of a context met before in these rows needs no partner
        other = (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (at[1:] != at[:-1])
        known[1:] = (key[1:] == key[:-1]) & (ctx[1:] == ctx[:-1]) & other
        key = np.where(known, at * 31 + doc * 1_000_003 + sub, key)  # dealt out anywhere, so no context gathers them
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (key, ctx, doc, sub, at, known)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in text_chunks(batch, "text", CHUNK):
                buffer, starts, ends, raw = _joined(part)
                place, text, key, ctx = anchors(buffer, starts, ends, length)
                ids = part.column("doc").to_numpy(zero_copy_only=False)
                subs = _subs(raw, part.column("several"))
                held.append((key, ctx, ids[text], subs[text], place - starts[text]))
                n += place.size
                if n >= ANCHOR_ROWS:
                    yield emit(held)
                    held, n = [], 0
        if n:
            yield emit(held)

    return run


def _widths(length: int) -> list[int]:
    """Window starts that a position stands for, round by round, down to one."""
    out = [length - _gram(length) + 1]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


RUN_SCHEMA = "r long, r2 long, ctx long, doc long, sub long, at long, low int, high int, left int, bytes binary"


def _cut_runs(r, doc, sub, at, low, high, left, raw: list[bytes], width: int, narrower: int, length: int) -> pa.RecordBatch:
    """The runs of at most ``width`` starts, cut into runs of ``narrower``: their shared bytes and all bytes hashed.

    ``raw`` holds the bytes around each anchor, ``left`` of them before it; ``low`` and ``high`` are the distances of
    the run's starts before the anchor. Starts whose window would leave the text, and runs without a start, drop out.
    A run keeps the bytes that its windows touch. Runs at other distances get other hashes, so the order of anchors is that of the starts among equal pairs.
    """
    sizes = np.array([len(x) for x in raw], np.int64)
    base = np.cumsum(sizes) - sizes
    grams = Grams(np.frombuffer(b"".join(raw), np.uint8))
    out, kept = [], []
    for shift in range(0, width, narrower):
        lo = low + shift
        hi = np.minimum(lo + narrower - 1, high)
        first = np.maximum(lo, length - (sizes - left))
        last = np.minimum(hi, left)
        ok = np.flatnonzero(first <= last)
        here, lo, hi, first, last = (base + left)[ok], lo[ok], hi[ok], first[ok], last[ok]
        core = grams.of(here - lo, here - hi + length) + lo.astype(np.uint64) * np.uint64(BASE)
        clip = ((first - lo) * (length + 1) + (hi - last)).astype(np.uint64)
        hull = grams.of(here - last, here - first + length) + clip
        out.append((r[ok], core.view(np.int64), hull.view(np.int64), doc[ok], sub[ok], at[ok], lo, hi, last, ok))
        spans = zip(ok.tolist(), (left[ok] - last).tolist(), (left[ok] - first + length).tolist(), strict=True)
        kept += [raw[i][a:b] for i, a, b in spans]
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    bytes_ = pa.array(kept, pa.binary())
    arrays = [pa.array(c, t) for c, t in zip(columns[:-1], [pa.int64()] * 6 + [pa.int32()] * 3, strict=True)]
    names = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([*arrays, bytes_], names)


def _first_runs(length: int):
    """Cuts the anchors of each text for the first time; the bytes around them come from the text."""
    widths, gram = _widths(length), _gram(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, sub, packed, zones in zip(*(batch.column(c) for c in ("doc", "sub", "packed", "zones")), strict=True):
                text = unpack.decompress(packed.as_py())
                at = zones.values.field("at").to_numpy()
                left = np.minimum(length - gram, at)
                raw = [text[p - k : p + length] for p, k in zip(at.tolist(), left.tolist(), strict=True)]
                r = zones.values.field("r").to_numpy()
                ids, subs = (np.full(at.size, x.as_py(), np.int64) for x in (doc, sub))
                low, high = np.zeros(at.size, np.int64), np.full(at.size, widths[0] - 1)
                yield _cut_runs(r, ids, subs, at, low, high, left, raw, widths[0], widths[1], length)

    return run


def _next_runs(width: int, narrower: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r, doc, sub, at = (batch.column(c).to_numpy() for c in ("r", "doc", "sub", "at"))
                low, high, left = (batch.column(c).to_numpy().astype(np.int64) for c in ("low", "high", "left"))
                raw = batch.column("bytes").to_pylist()
                yield _cut_runs(r, doc, sub, at, low, high, left, raw, width, narrower, length)

    return run


def _reranked(runs: DataFrame, *more: str) -> DataFrame:
    """Sorts positions by their pair ``r, r2`` and gives equal pairs the place of the first in the sorting as rank.

    ``done`` are those whose ``ctx``, all that their windows touch, came before; ``open`` the first of a ``ctx`` that
    share their pair with another. The rest is unique and goes. A position that comes twice is taken once.
    """
    pair = Window.partitionBy("r", "r2")
    run = pair.orderBy("ctx", "doc", "sub", "at")
    placed = runs.repartition("r", "r2").sortWithinPartitions("r", "r2", "ctx", "doc", "sub", "at")
    placed = placed.withColumn("place", F.monotonically_increasing_id())

    def as_before(c):
        return F.lag(c).over(run).eqNullSafe(F.col(c))

    judged = placed.select(
        "doc", "sub", "at", *more, F.first("place").over(run).alias("rank"), as_before("ctx").alias("again"),
        (as_before("ctx") & as_before("doc") & as_before("sub") & as_before("at")).alias("itself"),
        (F.min("ctx").over(pair) != F.max("ctx").over(pair)).alias("several"),
    )
    known = F.col("known") if "known" in more else F.lit(False)
    done = (F.col("again") | known).alias("done")
    left = judged.where(~F.col("itself") & (F.col("again") | known | F.col("several")))
    return left.select("doc", "sub", "at", F.col("rank").alias("r"), done, *[c for c in more if c != "known"])


def _doc(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def ids_of_several(docs: DataFrame, scratch: Scratch) -> DataFrame | None:
    """``doc, several`` of the ids that more than one row has, if few enough to be sent to every task; else None, and
    all rows are taken for such: their digests are longer but tell the same texts apart."""
    ids = docs.select(_doc().alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = scratch.save(ids.select("doc", F.lit(True).alias("several")), "several")
    return found if fits_broadcast(found.count()) else None


def _with_several(rows: DataFrame, several: DataFrame | None) -> DataFrame:
    if several is None:
        return rows.withColumn("several", F.lit(True))
    joined = rows.join(F.broadcast(several), "doc", "left")
    return joined.withColumn("several", F.coalesce("several", F.lit(False)))


def _keyed(docs: DataFrame, several: DataFrame | None) -> DataFrame:
    return _with_several(texts(docs).select(_doc().alias("doc"), "text"), several)


def _packed(docs: DataFrame, several: DataFrame | None) -> DataFrame:
    """``doc, sub, packed`` with compressed texts, for the shuffles that bring texts and positions together."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in text_chunks(batch, "text"):
                raw = [x.as_py() for x in part.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(_subs(raw, part.column("several")), pa.int64()),
                     pa.array([pack.compress(x) for x in raw], pa.binary())], ["doc", "sub", "packed"]
                )

    return _keyed(docs, several).mapInArrow(lean(run), "doc long, sub long, packed binary")


def repeated_places(docs: DataFrame, length: int, scratch: Scratch, several: DataFrame | None) -> DataFrame:
    """``doc, sub, places`` for the texts with bytes to remove: each place is a run of window starts, as one number."""
    if not 3 <= length < 1 << RUN_BITS:
        raise ValueError(f"length must be from 3 to {(1 << RUN_BITS) - 1}")
    spark, widths = docs.sparkSession, _widths(length)
    found = _keyed(docs, several).mapInArrow(lean(_anchor_rows(length)), ANCHOR_SCHEMA)
    level = scratch.save(_reranked(found.withColumnRenamed("key", "r").withColumn("r2", F.lit(0)), "known"), "anchors")
    del found
    release(spark)

    def places(rows: DataFrame, low, high) -> DataFrame:
        place = F.shiftleft("at", 2 * RUN_BITS) + low * (1 << RUN_BITS) + high
        return rows.where("done").select("doc", "sub", place.alias("place"))

    covered = places(level, F.lit(0), F.lit(widths[0] - 1))
    zones = level.where("NOT done").groupBy("doc", "sub").agg(F.collect_list(F.struct("at", "r")).alias("zones"))
    runs = _packed(docs, several).join(zones, ["doc", "sub"]).mapInArrow(lean(_first_runs(length)), RUN_SCHEMA)
    for i, width in enumerate(widths[1:], 1):
        level = scratch.save(_reranked(runs, "low", "high", "left", "bytes"), f"round-{i}")
        del runs
        release(spark)
        covered = covered.union(places(level, F.col("low"), F.col("high")))
        if width > 1:
            runs = level.where("NOT done").mapInArrow(lean(_next_runs(width, widths[i + 1], length)), RUN_SCHEMA)
    return covered.groupBy("doc", "sub").agg(F.collect_list("place").alias("places"))


def _covered(n: int, places: np.ndarray | None, copy: int, length: int) -> np.ndarray:
    """Which of a text's ``n`` bytes go; of rows that are the same in id and text all but one are copies throughout."""
    if copy > 1 and n >= length:
        return np.ones(n, bool)
    marks = np.zeros(n + 1, np.int64)
    if places is not None and len(places):
        at, low, high = places >> 2 * RUN_BITS, places >> RUN_BITS & RUN_MASK, places & RUN_MASK
        np.add.at(marks, at - np.minimum(high, at), 1)
        np.add.at(marks, np.minimum(at - low + length, n), -1)
    return np.cumsum(marks[:-1]) > 0


def _copies() -> Window:
    return F.row_number().over(Window.partitionBy("doc", "sub").orderBy(F.lit(0)))


def removal_digests(docs: DataFrame, length: int = 100) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Texts are UTF-8 bytes, a null text is empty. A byte goes if a string of ``length`` bytes over it also starts
    earlier: in a smaller ``doc_id``, or before in the same text. Strings are judged on the input. A null ``doc_id``
    comes before all others. Rows that share a ``doc_id`` are separate texts, in the order of their digests; rows the
    same in both are copies of one of them. Texts shorter than ``length`` lose nothing. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    several = ids_of_several(docs, scratch)
    places = scratch.save(repeated_places(docs, length, scratch, several), "places")
    scratch.drop(*[name for name in scratch.paths if name not in ("places", "several")])
    release(docs.sparkSession)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = [[] for _ in names]
            for doc, packed, copy, found in zip(*(batch.column(c) for c in ("doc", "packed", "copy", "places")), strict=True):
                raw = np.frombuffer(unpack.decompress(packed.as_py()), np.uint8)
                gone = _covered(raw.size, found.values.to_numpy() if found.is_valid else None, copy.as_py(), length)
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                sha = hashlib.sha256(raw[~gone].tobytes()).hexdigest()
                for c, v in zip(out, (doc.as_py(), raw.size, int(gone.sum()), runs, sha), strict=True):
                    c.append(None if c is out[0] and v == NO_ID else v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, [pa.int64()] * 4 + [pa.string()], strict=True)], names
            )

    rows = _packed(docs, several).withColumn("copy", _copies()).join(places, ["doc", "sub"], "left")
    return rows.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with the repeated passages taken out of ``text``; every row and all columns stay.

    As in ``removal_digests``, but a character goes only if all its bytes do, so texts stay valid. A null text stays null.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    several = ids_of_several(docs, scratch)
    places = scratch.save(repeated_places(docs, length, scratch, several), "places")
    scratch.drop(*[name for name in scratch.paths if name not in ("places", "several")])
    release(docs.sparkSession)

    @F.arrow_udf("string")
    def kept(text: pa.Array, places: pa.Array, copy: pa.Array) -> pa.Array:
        def one(t, p, c):
            if t is None:
                return None
            raw = np.frombuffer(t.encode(), np.uint8)
            gone = _covered(raw.size, p, c, length)
            if not gone.any():
                return t
            heads = np.flatnonzero((raw & 0xC0) != 0x80)
            whole = np.logical_and.reduceat(gone, heads)
            sizes = np.diff(np.append(heads, raw.size))
            return raw[~np.repeat(whole, sizes)].tobytes().decode()

        rows = zip(text, places, copy, strict=True)
        made = (one(t.as_py(), p.values.to_numpy() if p.is_valid else None, c.as_py()) for t, p, c in rows)
        return pa.array(made, pa.string())

    sub = F.when(F.col("several"), F.xxhash64(F.coalesce(F.col("row.text"), F.lit("")))).otherwise(F.lit(0))
    rows = _with_several(docs.select(F.struct("*").alias("row"), _doc().alias("doc")), several)
    rows = rows.select("row", "doc", sub.alias("sub")).withColumn("copy", _copies())
    joined = rows.join(places, ["doc", "sub"], "left")
    return joined.select("row", kept("row.text", "places", "copy").alias("kept")).select(
        *[F.col("kept").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    )
