"""Mixing sources to target weights: exact quotas of blocks, dealt to shards down a tree of hypergeometric draws."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.columns import once, words
from shelfwise.llm.common import Scratch

BLOCK_WORDS = 256
MOST_REPEATS = 3
SEED = 17
SHARDS = 64
# numpy draws from urns of fewer items; of a larger one, bundles of neighbouring blocks are the items.
URN = 10**9


def targets(sizes: list[int], weights: list[int], most: int = MOST_REPEATS) -> list[Fraction]:
    """Shares of ``sum(sizes)`` by weight; none above ``most`` times its size, the excess shared again by weight."""
    out: list[Fraction | None] = [None if s else Fraction(0) for s in sizes]
    left = Fraction(sum(sizes))
    while free := [i for i, t in enumerate(out) if t is None]:
        by_weight = left / sum(weights[i] for i in free)
        full = [i for i in free if by_weight * weights[i] > most * sizes[i]]
        for i in full or free:
            out[i] = Fraction(most * sizes[i]) if full else by_weight * weights[i]
            left -= out[i]
    return out


def shard_quotas(blocks: list[int], shards: int, seed: int = SEED, urn: int = URN) -> np.ndarray:
    """Blocks of every source (columns) in every shard (rows), shards level to a block, all blocks dealt.

    The shards are halved again and again; a half gets its share of the node's blocks, and how many of them are of
    which source is one multivariate hypergeometric draw, source after source. Sources of ``urn`` blocks or more
    together are dealt in bundles of equal size, the last of a source in part, and shards are level to a bundle.
    """
    bundle = -(-sum(blocks) // (urn - len(blocks) - 1)) or 1
    out = np.zeros((shards, len(blocks)), np.int64)
    todo = [(0, shards, [-(-q // bundle) for q in blocks])]
    while todo:
        lo, hi, held = todo.pop()
        if hi - lo == 1:
            out[lo] = held
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        rest, n = sum(held), sum(held) * (mid - lo) // (hi - lo)
        left = []
        for q in held:
            rest -= q
            left.append(int(rng.hypergeometric(q, rest, n)) if n and q else 0)
            n -= left[-1]
        todo += [(lo, mid, left), (mid, hi, [q - a for q, a in zip(held, left, strict=True)])]
    ends = np.minimum(np.cumsum(out, axis=0) * bundle, np.array(blocks, np.int64))
    return np.diff(ends, axis=0, prepend=0)


def _rows(docs: DataFrame) -> DataFrame:
    """Documents without their texts: ``doc_id, source, size, digest, copy``; copies number rows that are the same."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), "source", F.size(words(text)).cast("long").alias("size"),
        F.md5(text).alias("digest"),
    )
    same = Window.partitionBy("doc_id", "source", "digest").orderBy(F.lit(0))
    return rows.withColumn("copy", F.row_number().over(same))


def _row_key(doc_id: Column, source: Column, digest: Column) -> Column:
    """A text that tells documents with another id, source or text apart, and is never null."""
    known = F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("-")), digest, known))


def _plan(rows: DataFrame) -> DataFrame:
    """Per source: ``source, weight, source_size, target, take`` (whole words); one driver row per source.

    A mixture names its sources and their weights, so this table is as long as that list, whatever the corpus holds.
    """
    found = [(r.source, int(r.n or 0)) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    weights = [i % 3 + 1 for i in range(len(found))]
    goal = targets([n for _, n in found], weights)
    plan = [
        (s, w, n, float(t), math.floor(t + Fraction(1, 2))) for (s, n), w, t in zip(found, weights, goal, strict=True)
    ]
    schema = "source string, weight int, source_size long, target double, take long"
    return rows.sparkSession.createDataFrame(plan, schema)


def draws(rows: DataFrame, plan: DataFrame, scratch: Scratch, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Drawn blocks: ``doc_id, source, digest, copy, pass, block, drawn, rank``; drawn is the words taken of a block.

    A source is passed over as often as its target needs, each time in another permutation of its blocks. Blocks are
    taken until the words reach the target, the last one in part, so every source meets its target to the word.
    The running totals come from sums per permutation prefix; only blocks with one prefix are ever sorted together.
    """
    at = plan.select("source", "take", "source_size")
    passes = F.sequence(F.lit(0), F.ceil(F.col("take") / F.col("source_size")).cast("int") - 1)
    cut = (
        rows.where("size > 0")
        .join(at.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .where("take > 0")
        .select("doc_id", "source", "digest", "copy", "size", "take", F.explode(passes).alias("pass"))
        .select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / block_words).cast("int"))).alias("block"))
    )
    name = F.concat_ws("|", F.lit(SEED), "pass", "doc_id", "copy", "block", "digest")
    blocks = cut.select(
        "doc_id", "source", "digest", "copy", "pass", "block", "take", F.md5(name).alias("key"),
        F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words).alias("words"),
    ).withColumn("prefix", F.substring("key", 1, 4))
    blocks = scratch.save(blocks, "blocks")
    sums = blocks.groupBy("source", "pass", "prefix").agg(
        F.sum("words").alias("words"), F.count(F.lit(1)).alias("n")
    )
    before = Window.partitionBy("source").orderBy("pass", "prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("_s"), F.col("pass").alias("_pass"), F.col("prefix").alias("_prefix"),
        F.coalesce(F.sum("words").over(before), F.lit(0)).alias("words_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
    )
    within = Window.partitionBy("source", "pass", "prefix").orderBy("key")
    placed = blocks.withColumns({
        "cum": F.sum("words").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"),
        "nth": F.row_number().over(within) - 1,
    })
    same = (
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("pass") == F.col("_pass")) & (F.col("prefix") == F.col("_prefix"))
    )
    done = F.col("words_before") + F.col("cum")
    drawn = F.least(F.col("words"), F.col("take") - done)
    return (
        placed.join(starts, same)
        .where(drawn > 0)
        .select("doc_id", "source", "digest", "copy", "pass", "block", "key", drawn.cast("long").alias("drawn"),
                (F.col("n_before") + F.col("nth")).cast("long").alias("rank"))
    )


def with_shards(drawn: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """The blocks that the shards draw, with ``shard`` and ``order``: each shard takes the next of a source's permuted
    blocks, as many as its quota of the tree; within a shard ``order`` is the local shuffle. A block that no quota
    reaches is not drawn. ``drawn`` should be a written table."""
    found = [(r.source, r.n) for r in drawn.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()]
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    quotas = shard_quotas([n for _, n in found], shards, seed)
    ends = [(s, e) for (s, _), e in zip(found, np.cumsum(quotas, axis=0).T.tolist(), strict=True)]
    bounds = drawn.sparkSession.createDataFrame(ends, "_s string, ends array<long>")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard")
    order = F.md5(F.concat_ws("|", F.lit("order"), "key")).alias("order")
    joined = drawn.join(bounds, F.col("source").eqNullSafe(F.col("_s")))
    return joined.select(*drawn.columns, shard, order).where(F.col("shard") < shards)


def _mixture(rows: DataFrame, plan: DataFrame, scratch: Scratch, block_words: int, shards: int) -> DataFrame:
    """The mixture's blocks, drawn shard by shard."""
    drawn = scratch.save(draws(rows, plan, scratch, block_words), "drawn")
    scratch.drop("blocks")
    return with_shards(drawn, shards)


def mix_report(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, source, size, source_size, target, taken`` in words.

    Sources in order of their names, null last, weigh 1, 2, 3 and so on in turn, and share all words by weight; a
    target stops at three times its source's size. Rows without words are never taken. A null text has no word. Rows
    that repeat one another are taken each on their own; a null ``doc_id`` is an id like any other. Texts of any length
    are taken in blocks throughout. Draws depend on ids and texts alone, so runs agree. ``taken`` sums the blocks that
    the shards have drawn. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.save(_rows(docs), "rows")
    plan = _plan(rows)
    of_row = _mixture(rows, plan, scratch, block_words, shards).groupBy(
        F.col("doc_id").alias("_d"), F.col("source").alias("_so"), F.col("digest").alias("_g"), F.col("copy").alias("_c")
    ).agg(F.sum("drawn").alias("taken"))
    same = (
        F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_so"))
        & (F.col("digest") == F.col("_g")) & (F.col("copy") == F.col("_c"))
    )
    joined = rows.join(of_row, same, "left").join(
        plan.select(F.col("source").alias("_p"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_p"))
    )
    taken = F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    return joined.select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), taken)


def mix_blocks(docs: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The drawn blocks with their places: ``shard, order, doc_id, source, pass, block, drawn``."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.save(_rows(docs), "rows")
    mixture = _mixture(rows, _plan(rows), scratch, block_words, shards)
    return mixture.select("shard", "order", "doc_id", "source", "pass", "block", "drawn")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """The mixture as documents: a row for each document and pass, with the columns of ``docs``.

    A document whose blocks are all drawn keeps its text as it is; otherwise the drawn words follow one another with
    a space between. Documents of which nothing is drawn are left out. A row belongs to the shard that draws its first
    block; rows of a shard come together, in the order of its local shuffle. Awkward rows are as in ``mix_report``.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.save(_rows(docs), "rows")
    drawn = _mixture(rows, _plan(rows), scratch, block_words, shards)
    part = F.sort_array(F.collect_list(F.struct("block", "drawn"))).alias("_parts")
    parts = drawn.groupBy(
        F.col("doc_id").alias("_d"), F.col("source").alias("_so"), F.col("digest").alias("_g"), F.col("copy").alias("_c"),
        "pass",
    ).agg(part, F.sum("drawn").alias("_n"), F.min_by(F.struct("shard", "order"), "block").alias("_place"))
    parts = scratch.save(parts, "parts")
    scratch.drop("drawn")
    text = F.coalesce("row.text", F.lit(""))
    digest = F.md5(F.coalesce("text", F.lit("")))
    key = _row_key(F.col("doc_id").cast("long"), F.col("source"), digest)
    numbered = docs.select(F.struct("*").alias("row"), key.alias("_key")).withColumn(
        "_copy", F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(0)))
    )
    parts = parts.select("_c", "_parts", "_n", "_place", _row_key(F.col("_d"), F.col("_so"), F.col("_g")).alias("_same"))
    # The copy's number is no key of the join, so the texts stay where the numbering has dealt them.
    joined = numbered.join(parts, (F.col("_key") == F.col("_same")) & (F.col("_copy") - F.col("_c") == 0))
    pieces = once(words(text), lambda w: F.when(F.size(w) == F.col("_n"), text).otherwise(F.array_join(
        F.flatten(F.transform("_parts", lambda p: F.slice(w, p["block"] * block_words + 1, p["drawn"].cast("int")))), " "
    )))
    kept = F.struct(*[pieces.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    made = joined.select(kept.alias("kept"), F.col("_place.shard").alias("shard"), F.col("_place.order").alias("order"))
    # Ranges of the shards and, as the shards are of one size, of about as many rows.
    return made.repartitionByRange("shard", "order").sortWithinPartitions("shard", "order").select("kept.*")


ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
r AS (SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS size,
             md5(text) AS digest, row_number() OVER (PARTITION BY doc_id, source, md5(text)) AS copy FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM r GROUP BY source),
c AS (SELECT *, {MOST_REPEATS} * source_size / weight AS full_at, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, coalesce(sum({MOST_REPEATS} * source_size) OVER f, 0) AS full_before,
             sum(weight) OVER (ORDER BY full_at, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_on
      FROM c WINDOW f AS (ORDER BY full_at, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT arg_min((total - full_before) / weight_on, full_before)
             FILTER (WHERE (total - full_before) / weight_on <= full_at) AS level FROM o),
t AS (SELECT source, source_size, round(CAST(least({MOST_REPEATS} * source_size, level * weight) AS DOUBLE), 6) AS target
      FROM c, g),
b AS (SELECT r.*, p.pass, k.block, round(target) AS take,
             least({BLOCK_WORDS}, size - k.block * {BLOCK_WORDS}) AS words,
             md5(concat_ws('|', {SEED}, p.pass, doc_id, copy, k.block, digest)) AS key
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source,
           unnest(range(CAST(ceil(round(target) / greatest(source_size, 1)) AS BIGINT))) AS p(pass),
           unnest(range((size + {BLOCK_WORDS} - 1) // {BLOCK_WORDS})) AS k(block)),
x AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY pass, key ROWS UNBOUNDED PRECEDING) - words AS done FROM b),
y AS (SELECT doc_id, source, digest, copy, sum(least(words, take - done)) AS taken FROM x WHERE take > done
      GROUP BY ALL)
SELECT r.doc_id, r.source, r.size, t.source_size, t.target, CAST(coalesce(y.taken, 0) AS BIGINT) AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
LEFT JOIN y ON r.doc_id IS NOT DISTINCT FROM y.doc_id AND r.source IS NOT DISTINCT FROM y.source
           AND r.digest = y.digest AND r.copy = y.copy"""
