"""Near-duplicate documents by SimHash, candidates from an inverted index over byte positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import Scratch, components, text_chunks, texts
from shelfwise.session import fits_broadcast, lookup_join

SEED = 42
BYTES = 8


def shingles(raw: bytes, words: int) -> Iterator[bytes]:
    w = raw.lower().split()
    if len(w) < words:
        return iter([b" ".join(w)] if w else [])
    return map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))


def fingerprint(raw: bytes, words: int = 3) -> int:
    """Signed 64-bit SimHash of UTF-8 bytes: a bit is set if over half the shingle hashes have it; no word: 0."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles(raw, words), repeat(SEED)), "<u8")
    if not h.size:
        return 0
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
    most = np.add.reduce(bits, axis=0, dtype=np.uint32) * 2 > h.size
    return int(np.packbits(most, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fp`` of every row: text in lower case (A-Z only), shingles of ``words`` words, repeats included.

    A null text is empty and has the fingerprint 0; a text of fewer words is one shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                raw = part.column("text").cast(pa.binary())
                fp = pa.array((fingerprint(x.as_py(), words) for x in raw), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), fp], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def _shared_bytes(a: Column, b: Column) -> Column:
    """Number of byte positions at which two fingerprints agree."""
    xor = a.bitwiseXOR(b)
    same = [(F.shiftrightunsigned(xor, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for i in range(BYTES)]
    return sum(same[1:], same[0])


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs ``a < b`` of the fingerprints ``fp`` that differ in at most ``max_bits`` bits, each pair once.

    So few bits touch at most ``max_bits`` bytes, hence two such fingerprints agree at ``8 - max_bits`` byte
    positions at least. The index has a posting for each choice of so many positions and the bytes there; the lists
    are short however alike the fingerprints are, because only ``max_bits`` bytes are free in one. Pairs from the lists
    have their agreeing positions tallied, those short of the guaranteed number go, and the bits are counted.
    """
    need = BYTES - max_bits
    if not 0 < need <= BYTES:
        raise ValueError("max_bits must leave a byte to match")
    masks = [sum(255 << 8 * i for i in c) for c in combinations(range(BYTES), need)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                             for i, m in enumerate(signed)]))
    postings = distinct.select("fp", at.alias("p")).select("fp", "p.at", "p.key")
    a, b = postings.withColumnRenamed("fp", "a"), postings.withColumnRenamed("fp", "b")
    # Spark takes the postings for as small as the table they are made from; unless told, it sends them all to the driver.
    pairs = a.join(b.hint("merge"), ["at", "key"]).where("a < b").where(_shared_bytes(F.col("a"), F.col("b")) >= need)
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Documents link when their fingerprints differ in at most ``max_bits`` bits; ``component_id`` is the smallest
    ``doc_id`` that links lead to. Rows with equal fingerprints are one class and are never paired with each other,
    so a class with a third of all rows costs as much as a single document. Texts that are null, empty or have no word
    have the fingerprint 0 and link like any other. Repeated rows come out as often as they went in. A null
    ``doc_id`` keeps its row; its class takes the smallest of the other ids, or null. An empty table gives no rows. The result
    reads tables of ``scratch``.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, words), "fingerprints")
    classes = scratch.save(
        rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "classes"
    )
    roots = components(links(classes.select("fp"), max_bits), scratch).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named, size = scratch.counted(
        rooted.join(least, "root").select("fp", "component_id", "n"), "named",
        n=F.count(F.lit(1)), total=F.coalesce(F.sum("n"), F.lit(0)),
    )
    out = lookup_join(rows, named, ["fp"], "n", size["n"], size["total"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` with one row of each group: that with the smallest ``doc_id``, null after all others.

    ``grouped`` turns ``doc_id, text`` into ``doc_id, component_id``. It is given a number of each row in place of its
    id, so rows that share an id, or have none, are told apart and only go if another row of their group stays.
    """
    scratch = Scratch(docs.sparkSession, "groups")
    row = F.struct("*").alias("row")
    rows = scratch.save(docs.select(F.monotonically_increasing_id().alias("_row"), row), "rows")
    groups = grouped(rows.select(F.col("_row").alias("doc_id"), F.col("row.text").alias("text")))
    groups = groups.select(F.col("doc_id").alias("_row"), "component_id")
    ids = rows.select("_row", F.col("row.doc_id").cast("long").alias("id"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_row")).alias("least")
    first = ids.join(groups, "_row").groupBy("component_id").agg(least).select("least._row")
    gone, size = scratch.counted(rows.select("_row").join(first, "_row", "left_anti"), "gone", n=F.count(F.lit(1)))
    if fits_broadcast(size["n"]):
        gone = F.broadcast(gone)
    return rows.join(gone, "_row", "left_anti").select("row.*")


def keep_one(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` with one row of each near-duplicate group: that with the smallest ``doc_id``."""
    return first_of_groups(docs, lambda rows: near_duplicates(rows, words, max_bits))
