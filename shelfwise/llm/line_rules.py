"""Quality rules: word and repetition counts of a text, and lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.columns import ascii_lower, once, without, words
from shelfwise.llm.common import SPACES, Scratch
from shelfwise.session import lookup_join

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
# A line is removed where it stands in more documents of its host than this, and than this share of them; in more than
# LINE_MOST it goes however large the host is.
LINE_DOCS = 20
LINE_SHARE = 0.01
LINE_MOST = 200
# A document is rejected if the lines left have fewer words than MIN_WORDS or than this share of all its words.
KEPT_SHARE = 0.5
NO_HOST = "\x00"


def repeated_words(w: Column) -> Column:
    """Number of words that lie in a window of three words which the array ``w`` has twice or more."""
    n = F.size(w)
    hashes = F.transform(F.slice(w, F.lit(1), n - 2), lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2]))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            last = F.size(s) - 1
            twice = F.transform(s, lambda x, j: F.when(
                ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < last) & (F.get(s, j + 1)["h"] == x["h"])), x["i"]
            ))
            at = F.array_compact(twice)
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(once(placed, repeats))

    return F.when(n >= 4, once(hashes, covered)).otherwise(F.lit(0))


def _has_word(line: Column) -> Column:
    return F.length(without(line, SPACES)) > 0


def _profile(text: Column) -> Column:
    """All that the rules need of one text, as a struct; ``lines`` has a hash and the words of every line with a word."""
    marks = F.length(text) - F.length(without(text, SYMBOLS))

    def of(w: Column) -> Column:
        def of_lines(lines: Column) -> Column:
            normal = lambda line: F.array_join(words(ascii_lower(line)), " ")
            found = F.transform(lines, lambda line: F.struct(
                F.xxhash64(normal(line)).alias("h"), F.size(words(line)).alias("n")
            ))
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(without(text, SPACES)).cast("long").alias("word_chars"),
                marks.cast("long").alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                repeated_words(w).cast("long").alias("n_repeat_words"),
                found.alias("lines"),
            )

        return once(F.filter(F.split(text, "\n"), _has_word), of_lines)

    return once(words(text), of)


def line_verdicts(
    docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, line_most: int = LINE_MOST
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``,
    and ``n_cut_lines, n_left_words``.

    The host is ``source``; no source is a host of its own. Lines are compared in lower case (A-Z) with single spaces.
    A line in more than ``line_docs`` documents of its host and more than ``line_share`` of them is cut, one in more than
    both ``line_docs`` and ``line_most`` always; the document is rejected if too few words are left. A document counts a line once, however often it has it; rows
    that repeat one another count as documents of their own. Null and empty texts have no word and fail the base
    rule. Nothing depends on the order of rows. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = scratch.save(_rows(docs), "rows")
    bad, n_bad, load = frequent_lines(rows, scratch, line_docs, line_share, line_most)
    lines = rows.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.n")
    cut = lookup_join(lines, bad, ["host", "h"], "n_docs", n_bad, load)
    cut = cut.groupBy("row").agg(F.count(F.lit(1)).alias("n_cut_lines"), F.sum("n").alias("n_cut_words"))
    left = F.col("n_words") - F.coalesce("n_cut_words", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (left < MIN_WORDS) | (left < KEPT_SHARE * F.col("n_words"))
    return rows.drop("lines").join(cut, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"), F.coalesce("n_cut_lines", F.lit(0)).alias("n_cut_lines"),
        left.cast("long").alias("n_left_words"),
    )


def _rows(docs: DataFrame) -> DataFrame:
    profile = _profile(F.coalesce(F.col("text"), F.lit(""))).alias("p")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit(NO_HOST)).alias("host"), profile
    )
    return base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "host", "p.*")


def frequent_lines(
    rows: DataFrame, scratch: Scratch, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, line_most: int = LINE_MOST
) -> tuple[DataFrame, int, int]:
    """``host, h, n_docs`` of the lines above the limits, their number, and the documents they stand in."""
    hashes = F.array_distinct(F.transform("lines", lambda x: x["h"]))
    counts = rows.select("host", F.explode(hashes).alias("h")).groupBy("host", "h").agg(
        F.count(F.lit(1)).alias("n_docs")
    )
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    above = (F.col("n_docs") > line_docs) & (F.col("n_docs") > F.least(line_share * F.col("host_docs"), F.lit(float(line_most))))
    bad = scratch.save(
        counts.where(F.col("n_docs") > line_docs).join(hosts, "host").where(above).drop("host_docs"), "bad"
    )
    size = bad.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("load")).first()
    return bad, size["n"], size["load"]


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text
           FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM d),
t AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
u AS (SELECT r, i, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM t WINDOW p AS (PARTITION BY r ORDER BY i)),
v AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM u WHERE c IS NOT NULL),
q AS (SELECT r, count(DISTINCT i + k) AS n FROM v, unnest([0, 1, 2]) AS x(k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT r, host, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS lw FROM l),
z AS (SELECT r, host, line, array_to_string(lw, ' ') AS normal, len(lw) AS n FROM m WHERE len(lw) > 0),
e AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM z GROUP BY r),
h AS (SELECT host, count(*) AS host_docs FROM d GROUP BY host),
f AS (SELECT host, normal FROM z JOIN h USING (host) GROUP BY host, normal, host_docs
      HAVING count(DISTINCT r) > {LINE_DOCS} AND count(DISTINCT r) > least({LINE_SHARE} * host_docs, {LINE_MOST})),
c AS (SELECT r, count(*) AS n_lines, sum(n) AS n_words FROM z SEMI JOIN f USING (host, normal) GROUP BY r),
g AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             coalesce(e.n, 0) AS n_dup_lines, coalesce(q.n, 0) AS n_repeat_words,
             coalesce(c.n_lines, 0) AS n_cut_lines, CAST(len(w) - coalesce(c.n_words, 0) AS BIGINT) AS n_left_words
      FROM d JOIN w USING (r) LEFT JOIN e USING (r) LEFT JOIN q USING (r) LEFT JOIN c USING (r))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)
       AND n_left_words >= {MIN_WORDS} AND n_left_words >= {KEPT_SHARE} * n_words AS kept
FROM g"""
