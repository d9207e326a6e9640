"""Fill-in-middle: texts cut at line ends and rotated in place, so that a model learns to write the middle."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import text_chunks

PLAIN, PREFIX_FIRST, SUFFIX_FIRST = "plain", "psm", "spm"
LINE_END = 0x0A


@dataclass(frozen=True)
class Rule:
    """How texts are cut: marks before prefix, suffix and middle, the seed, and shares in percent."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: int = 7
    cut_percent: int = 100  # texts that are cut at all
    suffix_first_percent: int = 50  # of those, texts that begin with the suffix

    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers that follow from seed and id alone; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def units(text: bytes | bytearray) -> int:
    """Lines of a text; one without a line end at the close counts too."""
    return text.count(LINE_END) + (len(text) > 0 and text[-1] != LINE_END)


def characters(text: bytes | bytearray) -> int:
    return len(text.decode("utf-8", "surrogatepass"))


def _end_of(text: bytearray, at: int, more: int) -> int:
    """Byte after ``more`` further lines from ``at``."""
    for _ in range(more):
        at = text.find(LINE_END, at) + 1 or len(text)
    return at


def reverse(buffer: bytearray, start: int, end: int) -> None:
    buffer[start:end] = buffer[start:end][::-1]


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchanges the neighbouring blocks ``start:cut`` and ``cut:end`` within the buffer by three reversals."""
    reverse(buffer, start, cut)
    reverse(buffer, cut, end)
    reverse(buffer, start, end)


def transform(text: bytes, doc_id: int | None, rule: Rule) -> tuple[int, str, int | None, int | None, bytes]:
    """Lines, form, characters of prefix and middle, and the bytes that come out."""
    n = units(text)
    h1, h2, h3, h4 = draws(doc_id, rule.seed)
    prefix, suffix, middle = rule.marks()
    if not text or any(m in text for m in rule.marks()) or h3 % 100 >= rule.cut_percent:
        return n, PLAIN, None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    buffer = bytearray(text)
    a = _end_of(buffer, 0, first)
    b = _end_of(buffer, a, second - first)
    sizes = characters(buffer[:a]), characters(buffer[a:b])
    # Marks go in from the back, so the earlier cut stays where it is.
    buffer[b:b] = suffix
    buffer[a:a] = middle
    buffer[0:0] = prefix
    a += len(prefix)  # the middle's mark begins here
    b += len(prefix) + len(middle)  # the suffix's
    rotate(buffer, a, b, len(buffer))
    form = PREFIX_FIRST
    if h4 % 100 < rule.suffix_first_percent:
        rotate(buffer, 0, a, a + len(buffer) - b)
        form = SUFFIX_FIRST
    return n, form, *sizes, bytes(buffer)


def restore_text(output: bytes, form: str, rule: Rule) -> bytes:
    """The text that ``transform`` was given, from what came out and its form alone."""
    if form == PLAIN:
        return output
    prefix, suffix, middle = rule.marks()
    buffer = bytearray(output)
    # No text with a mark in it is cut, so the first place of a mark is its only one.
    if form == SUFFIX_FIRST:
        rotate(buffer, 0, buffer.find(prefix), buffer.find(middle))
    a, b = buffer.find(suffix), buffer.find(middle)
    rotate(buffer, a, b, len(buffer))
    b = a + len(buffer) - b
    del buffer[b : b + len(suffix)]
    del buffer[a : a + len(middle)]
    del buffer[: len(prefix)]
    return bytes(buffer)


def infill(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs``.

    A null text is empty; an empty text, and one that holds a mark, comes out as it is, with null sizes. A text of any
    length is worked on whole, in a single buffer. The cuts follow from seed and ``doc_id`` alone: repeated rows come
    out alike, each as often as it went in, and rows without an id share one draw. Equal cuts leave the middle empty.
    Other columns, whatever their names, are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                ids = part.column("doc_id")
                made = [transform(t.as_py(), d.as_py(), rule) for d, t in zip(ids, part.column("text").cast(pa.binary()), strict=True)]
                columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), KINDS, strict=True)]
                columns[-1] = columns[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids, *columns], NAMES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def restored(made: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``infill`` with a further column ``restored``: each text, rebuilt from ``output`` and ``form``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "output"):
                pairs = zip(part.column("output").cast(pa.binary()), part.column("form"), strict=True)
                texts = pa.array([restore_text(o.as_py(), f.as_py(), rule) for o, f in pairs], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, texts.cast(pa.string())], [*part.schema.names, "restored"])

    return made.mapInArrow(run, f"{SCHEMA}, restored string")


def infill_digests(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Sizes and form of every row beside digests of what came out and of what was restored from it."""
    return restored(infill(docs, rule), rule).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


ORACLE = """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS units,
    CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4
  FROM texts
), placed AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
    CAST(least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS BIGINT) AS a,
    CAST(greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS BIGINT) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid,
    array_to_string(units[b + 1:n], '') AS suf
  FROM placed
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(pre || mid || suf) AS restored_sha256
FROM parts
"""
