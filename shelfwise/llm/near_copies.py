"""Near copies by the Jaccard similarity of word shingles: MinHash bands give candidates, whole shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import Scratch, components, lean, release, text_chunks, texts
from shelfwise.llm.simhash import SEED, near_duplicates, shingles
from shelfwise.session import lookup_join, spread_join

WORDS = 5
SIMILARITY = 0.8
# A pair at 0.8 shares one of 16 bands of five least hashes with a probability of 0.998.
BANDS = 16
BAND_HASHES = 5
# Buckets of so many classes have all their pairs compared, larger ones those that their shingles allow.
SMALL = 16
AT_ONCE = 2048
# Pairs that a head's text is sent along with.
MEMBERS = 1000
_drawn = np.random.default_rng(SEED)
_FLIP = _drawn.integers(0, 1 << 64, (BANDS * BAND_HASHES, 1), np.uint64)
_TIMES = _drawn.integers(0, 1 << 64, (BANDS * BAND_HASHES, 1), np.uint64) | np.uint64(1)


def shingle_set(raw: bytes, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's shingles, sorted, each once."""
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles(raw, words), repeat(SEED)), "<u8"))


def bands(hashes: np.ndarray) -> list[int]:
    """One signed key for each band; a text without words has none."""
    if not hashes.size:
        return []
    least = np.full(BANDS * BAND_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, hashes.size, AT_ONCE):
        np.minimum(least, ((hashes[i : i + AT_ONCE] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    rows = least.reshape(BANDS, BAND_HASHES)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(rows)]


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, class, bands``; texts with the same shingles are one class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                sets = [shingle_set(x.as_py(), words) for x in part.column("text").cast(pa.binary())]
                same = pa.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets], pa.int64())
                keys = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), same, keys], ["doc_id", "class", "bands"])

    return texts(docs).mapInArrow(lean(run), "doc_id long, class long, bands array<long>")


def _packed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in text_chunks(batch, "text"):
                packed = pa.array([pack.compress(x.as_py()) for x in part.column("text").cast(pa.binary())], pa.binary())
                columns = [part.column("node"), packed, part.column("load")]
                yield pa.RecordBatch.from_arrays(columns, ["node", "packed", "load"])

    return docs.select("node", "text", "load").mapInArrow(lean(run), "node long, packed binary, load long")


def similar(pairs: DataFrame, docs: DataFrame, scratch: Scratch, words: int, least: float) -> DataFrame:
    """Those of the written ``pairs (a, b)`` whose shingle sets have a Jaccard similarity of ``least`` or more.

    Of a pair the text with more pairs is the head. Heads are sent once to each group of ``MEMBERS`` of their pairs, and a
    pair's row holds its other text alone; a task keeps one head's shingles at a time. Texts go from task to task: were
    they broadcast, all of them would pass through the driver.
    """
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    load, seen = scratch.counted(
        ends.groupBy("node").agg(F.count(F.lit(1)).alias("load")), "load",
        n=F.count(F.lit(1)), total=F.coalesce(F.sum("load"), F.lit(0)),
    )
    total, nodes = seen["total"], seen["n"]
    held = texts(docs).withColumnRenamed("doc_id", "node")
    one_each = load.withColumn("one", F.lit(1))
    wanted = scratch.save(_packed(lookup_join(held, one_each, ["node"], "one", nodes, nodes)), "wanted")

    def loads(c: str) -> DataFrame:
        return load.select(F.col("node").alias(c), F.col("load").alias(f"{c}_load"), "load")

    both = lookup_join(pairs, loads("a"), ["a"], "load", nodes, total)
    both = lookup_join(both, loads("b"), ["b"], "load", nodes, total)
    swap = F.struct("b_load", "b") > F.struct("a_load", "a")
    salts = F.ceil(F.greatest("a_load", "b_load") / MEMBERS)
    both = scratch.save(both.select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("head"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("node"),
        F.pmod(F.xxhash64("a", "b"), salts).alias("salt"),
    ), "both")
    text_of = lambda rows: spread_join(rows, wanted, ["node"], "load", total)
    heads = both.select(F.col("head").alias("node"), "salt").distinct()
    rows = text_of(heads).select(F.col("node").alias("head"), "salt", F.lit(None).cast("long").alias("node"), "packed").unionByName(
        text_of(both).select("head", "salt", "node", "packed")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        head, mine = None, np.zeros(0, "<u8")
        for batch in batches:
            close = []
            for h, node, packed in zip(*(batch.column(c) for c in ("head", "node", "packed")), strict=True):
                hashes = shingle_set(unpack.decompress(packed.as_py()), words)
                if not node.is_valid:
                    head, mine = h.as_py(), hashes
                    close.append(False)
                    continue
                assert head == h.as_py()
                shared = np.intersect1d(mine, hashes, assume_unique=True).size
                close.append(shared >= least * (mine.size + hashes.size - shared))
            yield batch.select(["head", "node"]).filter(pa.array(close, pa.bool_())).rename_columns(["a", "b"])

    dealt = rows.repartition("head", "salt").sortWithinPartitions("head", "salt", F.col("node").asc_nulls_first())
    return dealt.select("head", "node", "packed").mapInArrow(lean(run), "a long, b long")


def _rooted(classes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``classes`` with ``root``, the class that the links of ``node`` lead to, or itself."""
    if roots is None:
        return classes.withColumn("root", F.col("node"))
    return classes.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _members(rooted: DataFrame) -> DataFrame:
    """``node, root, key``: every class in each of its buckets."""
    return rooted.select("node", "root", F.explode("bands").alias("key"))


def _candidates(rooted: DataFrame, step: int, scratch: Scratch) -> DataFrame:
    """Pairs of one bucket that no link joins yet: all in small buckets (after the first step), else with one class."""
    members = _members(rooted)
    order = F.col("node") if step == 0 else F.xxhash64("node", "key", F.lit(step))
    buckets = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"),
        F.min(F.struct(order.alias("at"), F.col("node"), F.col("root"))).alias("first"),
    ).where("low < high").select("key", "n", F.col("first.node").alias("a"), F.col("first.root").alias("a_root"))
    buckets, size = scratch.counted(
        buckets.withColumn("load", F.col("n")), f"buckets-{step}",
        n=F.count(F.lit(1)), total=F.coalesce(F.sum("n"), F.lit(0)),
    )
    met = lookup_join(members, buckets, ["key"], "load", size["n"], size["total"])
    pairs = met.select("a", F.col("node").alias("b"), "a_root", F.col("root").alias("b_root"))
    if step:
        small = met.where(F.col("n") <= SMALL)
        other = small.select("key", F.col("node").alias("a"), F.col("root").alias("a_root"))
        all_of = small.select("key", F.col("node").alias("b"), F.col("root").alias("b_root")).join(other, "key")
        pairs = pairs.union(all_of.select("a", "b", "a_root", "b_root"))
    pairs = pairs.where("a_root <> b_root")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _shingles(rows: DataFrame, words: int) -> DataFrame:
    """``node, root, size, h``: every shingle of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                sets = [shingle_set(x.as_py(), words) for x in part.column("text").cast(pa.binary())]
                sizes = np.array([s.size for s in sets], np.int64)
                whole = [np.repeat(part.column(c).to_numpy(), sizes) for c in ("node", "root")]
                h = np.concatenate([np.zeros(0, "<u8"), *sets]).view(np.int64)
                arrays = [*whole, np.repeat(sizes, sizes), h]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in arrays], ["node", "root", "size", "h"])

    return rows.select("node", "root", "text").mapInArrow(lean(run), "node long, root long, size long, h long")


def crowded(classes: DataFrame, roots: DataFrame | None, docs: DataFrame, scratch: Scratch, words: int, least: float) -> DataFrame:
    """Pairs that may reach ``least`` among the classes of large buckets that links do not join yet, none left out.

    ``classes`` has ``node, bands`` and either ``root`` or, beside it, ``roots (node, root)`` of the links so far.
    The shingles of a class are put in order of their number among these classes, the rare ones first. Two sets that
    reach ``least`` share a shingle among the first ``size - ceil(least * size) + 1`` of the larger and the first
    ``size - ceil(2 * least / (1 + least) * size) + 1`` of the smaller one, with enough shingles from there on in both.
    What a template gives all of its pages stands at the end and so pairs nothing.
    """
    members = _members(classes if "root" in classes.columns else _rooted(classes, roots))
    keys = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    keys, size = scratch.counted(
        keys.where(f"n > {SMALL} AND low < high").select("key", "n"), "crowded",
        n=F.count(F.lit(1)), total=F.coalesce(F.sum("n"), F.lit(0)),
    )
    nodes = lookup_join(members, keys, ["key"], "n", size["n"], size["total"]).select("node", "root").distinct()
    nodes, crowd = scratch.counted(nodes.withColumn("one", F.lit(1)), "crowd", n=F.count(F.lit(1)))
    count = crowd["n"]
    held = lookup_join(texts(docs).withColumnRenamed("doc_id", "node"), nodes, ["node"], "one", count, count)
    rows = scratch.save(_shingles(held, words), "shingles")
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("often"), F.min("root").alias("low"), F.max("root").alias("high"))
    often, size = scratch.counted(
        often.withColumn("load", F.col("often")), "often",
        n=F.count(F.lit(1)), total=F.coalesce(F.sum("load"), F.lit(0)),
    )
    counted = lookup_join(rows, often, ["h"], "load", size["n"], size["total"])
    at = (F.row_number().over(Window.partitionBy("node").orderBy("often", "h")) - 1).alias("at")
    placed = counted.select("node", "root", "size", "h", "low", "high", at).where("low < high")

    def first(share: float) -> Column:
        return F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 1

    probes = scratch.save(placed.where(F.col("at") < first(least)).select("node", "root", "size", "h", "at"), "probes")
    small = probes.where(F.col("at") < first(2 * least / (1 + least)))
    x = small.select("h", *[F.col(c).alias(f"x_{c}") for c in ("node", "root", "size", "at")])
    y = probes.select("h", *[F.col(c).alias(f"y_{c}") for c in ("node", "root", "size", "at")])
    need = least / (1 + least) * (F.col("x_size") + F.col("y_size")) - 1e-9
    rest = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at"))
    pairs = x.join(y, "h").where(
        (F.struct("x_size", "x_node") < F.struct("y_size", "y_node")) & (F.col("x_root") != F.col("y_root"))
        & (F.col("x_size") >= least * F.col("y_size") - 1e-9) & (rest >= need)
    )
    return pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def near_copies(
    docs: DataFrame, words: int = WORDS, least: float = SIMILARITY, scratch: Scratch | None = None
) -> DataFrame:
    """``doc_id, component_id`` for every row of ``docs``, whose ``doc_id`` must be there and unique.

    Rows link if the sets of their shingles of ``words`` words have a Jaccard similarity of ``least`` or more, or are
    equal: repeated texts, and all texts without a word (null, empty), are one class each and cost no comparison.
    Texts of any length count whole. Candidates share a band of least hashes. Of each bucket the classes are compared
    with one of its classes first, so a family of copies costs a comparison a member; those that are not linked by then
    are all compared with each other in small buckets, and in large ones where their shingles allow it, see
    ``crowded``. An empty table gives no rows. The result reads tables of ``scratch``.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near-copies")
    rows = scratch.save(_signed(docs, words), "rows")
    first = F.min(F.struct("doc_id", "bands")).alias("first")
    classes = rows.groupBy("class").agg(first, F.count(F.lit(1)).alias("n"))
    classes = _rooted(classes.select("class", F.col("first.doc_id").alias("node"), "first.bands", "n"), None)
    classes, size = scratch.counted(classes, "classes", n=F.count(F.lit(1)), total=F.coalesce(F.sum("n"), F.lit(0)))
    tried, found = [], []
    for step in range(3):
        # What a step leaves on the driver (plans, broadcast tables) goes before the next.
        release(docs.sparkSession)
        if step < 2:
            pairs = _candidates(classes, step, scratch)
        else:
            pairs = crowded(classes, None, docs, scratch, words, least)
        if tried:
            pairs = pairs.join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti")
        pairs, seen = scratch.counted(pairs, f"pairs-{step}", n=F.count(F.lit(1)))
        if not seen["n"]:
            continue
        tried.append(pairs)
        linked, seen = scratch.counted(similar(pairs, docs, scratch, words, least), f"linked-{step}", n=F.count(F.lit(1)))
        scratch.drop("load", "wanted", "both")
        if seen["n"]:
            found.append(linked)
            roots = components(reduce(DataFrame.union, found), scratch)
            classes = scratch.save(_rooted(classes, roots), f"classes-{step}")
    scratch.drop(*[n for n in ("shingles", "often", "probes") if n in scratch.paths])
    named = classes.select("class", F.col("root").alias("component_id"), "n")
    return lookup_join(rows.select("doc_id", "class"), named, ["class"], "n", size["n"], size["total"]).select(
        "doc_id", "component_id"
    )


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, component_id`` for every row of ``docs``, whose ``doc_id`` must be there and unique.

    Rows link as in operator 7 (``simhash.near_duplicates``: fingerprints within two bits) or as ``near_copies``;
    ``component_id`` is the smallest ``doc_id`` that links of either kind lead to. Both name a component by a row of
    it, so a row ties its two components together, and only components are linked, however many rows they have.
    """
    scratch, *parts = (Scratch(docs.sparkSession, name) for name in ("near-groups", "simhash", "near-copies"))
    prints = near_duplicates(docs, scratch=parts[0]).select("doc_id", F.col("component_id").alias("print_id"))
    release(docs.sparkSession)
    tied = scratch.save(near_copies(docs, scratch=parts[1]).join(prints, "doc_id"), "tied")
    for part in parts:
        part.clear()
    ties = tied.select(F.col("component_id").alias("a"), F.col("print_id").alias("b")).where("a <> b").distinct()
    roots = components(ties, scratch)
    named = tied.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).join(
        roots.withColumnRenamed("node", "component_id"), "component_id", "left"
    )
    named, size = scratch.counted(
        named.select("component_id", F.coalesce("root", "component_id").alias("root"), "n"), "named",
        n=F.count(F.lit(1)), total=F.coalesce(F.sum("n"), F.lit(0)),
    )
    out = lookup_join(tied.select("doc_id", "component_id"), named, ["component_id"], "n", size["n"], size["total"])
    return out.select("doc_id", F.col("root").alias("component_id"))
