"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.columns import ascii_lower, once, words
from shelfwise.llm.common import Scratch

THRESHOLD = 0.8

# One-line notices, file headers and whole permission notices as their owners publish them, without the
# lines that name a holder.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
    "except in compliance with the License.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License.",
    "MIT licensed": "Licensed under the MIT License.",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause endorsement": """Neither the name of the copyright holder nor the names of its contributors may be used
to endorse or promote products derived from this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "proprietary": "All rights reserved.",
}
MARKS = ".,;:!?()\"'"


def plain_words(text: str) -> list[str]:
    """Words in lower case and without marks."""
    return text.lower().translate(str.maketrans("", "", MARKS)).split()


def bigrams(text: str) -> set[str]:
    """Distinct pairs of neighbouring words, in lower case and without marks; a single word is a pair with nothing."""
    w = plain_words(text)
    return {" ".join(p) for p in zip(w, w[1:], strict=False)} if len(w) > 1 else set(w)


def _pairs(w: Column) -> Column:
    pairs = F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), w[i + 1]))
    return F.array_distinct(F.when(F.size(w) > 1, pairs).otherwise(w))


def _hits(w: Column, vocabulary: set[str]) -> Column:
    """``at, pair`` of the places in ``w`` where a pair of the ``vocabulary`` begins. Pairs are only put together where
    their first word begins one."""
    first = sorted({b.split(" ")[0] for b in vocabulary})

    def pair(x: Column, i: Column) -> Column:
        whole = F.when(F.size(w) > 1, F.concat(x, F.lit(" "), F.get(w, i + 1))).otherwise(x)
        return F.when(x.isin(first), F.struct(i.alias("at"), whole.alias("pair")))

    return F.filter(F.transform(w, pair), lambda h: h["pair"].isin(sorted(vocabulary)))


def _passages(w: Column, hits: Column, name: str, template: str, threshold: float) -> Column:
    """``license, score, n`` of the windows of ``w`` as long as the template that begin with one of its pairs.

    A window can only reach the threshold if the place of the ``need``-th hit from its begin is still inside, so
    all others end after one comparison; those left get their exact coefficient.
    """
    length, pairs = len(plain_words(template)), bigrams(template)
    need = least_shared(len(pairs), threshold)

    def of(own: Column) -> Column:
        def coefficient(h: Column, j: Column) -> Column:
            last = h["at"] + length - 2
            inside = F.filter(F.slice(own, j + 1, length - 1), lambda x: x["at"] <= last)
            shared = F.size(F.array_distinct(F.transform(inside, lambda x: x["pair"])))
            n = F.size(once(F.slice(w, h["at"] + 1, length), _pairs))
            return F.when(F.get(own, j + (need - 1))["at"] <= last, 2 * shared / (n + len(pairs)))

        scores = F.filter(F.transform(own, coefficient), lambda c: c >= threshold)
        return once(scores, lambda c: F.struct(
            F.lit(name).alias("license"), F.array_max(c).alias("score"), F.size(c).alias("n")
        ))

    return once(F.filter(hits, lambda h: h["pair"].isin(sorted(pairs))), of)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: ``doc_id, license, score, n_matches, n_passages``.

    The whole text, each of its lines, and each passage is compared with each template: A-Z in lower case, marks left
    out, white space as one space, then the Dice coefficient of the distinct word bigrams. Passages are runs of as many
    words as the template has (fewer at the text's end) that begin with one of its bigrams, whatever line breaks are
    between them, so a header wrapped over lines and a notice inside a longer line are found; templates of one word
    have none. Those of at least ``threshold`` match; ``license`` has the highest score, ties go to the first name,
    ``n_matches`` counts the lines that match any template (a text of one line once), and ``n_passages`` the
    passages of all templates. Rows without a match have null, 0, 0 and 0; so have null and empty texts. Repeated
    rows come out as often as they went in, an empty table gives no rows, and very long texts are scanned whole, one
    at a time in a task.

    A coefficient of t needs ``t / (2 - t)`` of the longer side's bigrams on the shorter, so lines outside these bounds
    for all templates go, and a passage is only scored where that number of the template's bigrams begins in it.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    index = template_index(templates)
    least, most = size_bounds(templates, threshold)
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "licenses")
    vocabulary = {b for b, _, _ in index}

    def candidate(w: Column, hits: Column, i: Column) -> Column:
        n = F.when(F.size(hits) >= least, F.size(once(w, _pairs))).otherwise(0)
        shared = F.array_distinct(F.transform(hits, lambda h: h["pair"]))
        return once(n, lambda n: F.when(n.between(least, most), F.struct(i.alias("part"), n.alias("n"), shared.alias("shared"))))

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.split(F.translate(ascii_lower(text), MARKS, ""), "\n").alias("lines"))
    rows = rows.select("row", "doc_id", F.transform("lines", words).alias("lines"))
    rows = rows.select("row", "doc_id", "lines", F.flatten("lines").alias("whole"))
    rows = rows.select("row", "doc_id", "lines", "whole", _hits(F.col("whole"), vocabulary).alias("hits"))
    of_line = F.transform("lines", lambda w, i: once(_hits(w, vocabulary), lambda h: candidate(w, h, i + 1)))
    parts = F.concat(
        F.array(candidate(F.col("whole"), F.col("hits"), F.lit(0))),
        F.when((F.size("lines") > 1) & (F.size("hits") >= least), of_line).otherwise(F.array()),
    )
    passages = F.array(*[
        _passages(F.col("whole"), F.col("hits"), name, t, threshold)
        for name, t in sorted(templates.items()) if len(plain_words(t)) > 1
    ])
    found = F.when(F.size("hits") >= least, F.filter(passages, lambda p: p["n"] > 0))
    rows = rows.select("row", "doc_id", F.size("lines").alias("lines"), F.array_compact(parts).alias("found"),
                       found.alias("passages"))
    rows = scratch.save(rows, "rows")
    one = rows.select("row", "lines", F.explode("found").alias("c")).select(
        "row", "lines", "c.part", "c.n", F.explode("c.shared").alias("bigram")
    )
    # The templates' bigrams are few whatever the corpus, so their table goes to every task.
    table = F.broadcast(spark.createDataFrame(index, "bigram string, license string, n_template int"))
    counted = one.join(table, "bigram").groupBy("row", "lines", "part", "n", "license", "n_template").agg(
        F.count(F.lit(1)).alias("c")
    )
    score = (2 * F.col("c") / (F.col("n") + F.col("n_template"))).alias("score")
    matches = counted.select("row", "lines", "part", "license", score).where(F.col("score") >= threshold)
    is_line = (F.col("lines") == 1) | (F.col("part") > 0)
    best = matches.groupBy("row").agg(
        F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("best"),
        F.countDistinct(F.when(is_line, F.col("part"))).alias("n_matches"),
    )
    inside = F.array_min(F.transform("passages", lambda p: F.struct((-p["score"]).alias("less"), p["license"])))
    total = F.aggregate(F.coalesce("passages", F.array()), F.lit(0), lambda n, p: n + p["n"])
    return rows.join(best, "row", "left").select("doc_id", F.least("best", inside).alias("best"), "n_matches", total.alias("n")).select(
        "doc_id", "best.license", F.round(F.coalesce(-F.col("best.less"), F.lit(0.0)), 6).alias("score"),
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.col("n").cast("long").alias("n_passages"),
    )


def template_index(templates: dict[str, str]) -> list[tuple[str, str, int]]:
    """``bigram, license, number of the template's bigrams`` for every bigram of every template."""
    sets = {name: bigrams(t) for name, t in templates.items()}
    if not sets or not all(sets.values()):
        raise ValueError("templates must have words")
    return [(b, name, len(found)) for name, found in sets.items() for b in sorted(found)]


def least_shared(n: int, threshold: float) -> int:
    """Least number of shared bigrams with which anything can reach the threshold for a template of ``n``."""
    t = Fraction(str(threshold))
    return math.ceil(n * t / (2 - t))


def size_bounds(templates: dict[str, str], threshold: float) -> tuple[int, int]:
    """Least and most distinct bigrams with which a text can reach the threshold for any template."""
    sizes, t = [len(bigrams(x)) for x in templates.values()], Fraction(str(threshold))
    return least_shared(min(sizes), threshold), math.floor(max(sizes) * (2 - t) / t)


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in SQL: passages by a join of each hit with those that follow it."""
    lengths = {name: len(plain_words(t)) for name, t in templates.items()}
    values = ", ".join(
        "('" + b.replace("'", "''") + f"', '{name}', {n}, {lengths[name]})" for b, name, n in template_index(templates)
    )
    return f"""
WITH t(bigram, license, n_template, m) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT r, text AS part, 0 AS i, position(chr(10) IN text) = 0 AS is_line FROM d
      UNION ALL
      SELECT r, unnest(string_split(text, chr(10))), generate_subscripts(string_split(text, chr(10)), 1), true
      FROM d WHERE position(chr(10) IN text) > 0),
w AS (SELECT r, i, is_line, regexp_extract_all(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?()"'']', '', 'g'), '[^ \t\n\x0B\f\r]+') AS w FROM p),
g AS (SELECT r, i, is_line, list_distinct(CASE WHEN len(w) > 1
             THEN list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) ELSE w END) AS g FROM w),
u AS (SELECT r, i, is_line, len(g) AS n, unnest(g) AS bigram FROM g),
c AS (SELECT r, i, is_line, license, 2.0 * count(*) / (n + n_template) AS score FROM u JOIN t USING (bigram)
      GROUP BY r, i, is_line, license, n, n_template HAVING 2.0 * count(*) / (n + n_template) >= {threshold}),
o AS (SELECT r, k AS place, w[k] || ' ' || w[k + 1] AS bigram
      FROM (SELECT r, w, unnest(range(1, len(w))) AS k FROM w WHERE i = 0)),
h AS (SELECT r, place, bigram, license, n_template, m FROM o JOIN t USING (bigram) WHERE m > 1),
f AS (SELECT a.r, a.place, a.license, a.n_template, a.m, count(DISTINCT b.bigram) AS shared
      FROM h a JOIN h b ON a.r = b.r AND a.license = b.license AND b.place BETWEEN a.place AND a.place + a.m - 2
      GROUP BY ALL HAVING count(DISTINCT b.bigram) * (2 - {threshold}) >= {threshold} * a.n_template - 0.000001),
v AS (SELECT f.r, license, 2.0 * shared / (n_template + len(list_distinct(list_transform(
             range(place, least(place + m - 1, len(w))), lambda k: w[k] || ' ' || w[k + 1])))) AS score
      FROM f JOIN w ON f.r = w.r AND w.i = 0),
e AS (SELECT r, license, score, i, is_line, 0 AS passage FROM c
      UNION ALL SELECT r, license, score, NULL, false, 1 FROM v WHERE score >= {threshold}),
b AS (SELECT r, arg_min(license, (-score, license)) AS license, max(score) AS score,
             count(DISTINCT i) FILTER (WHERE is_line) AS n_matches, sum(passage) AS n_passages FROM e GROUP BY r)
SELECT doc_id, license, round(coalesce(score, 0), 6) AS score, coalesce(n_matches, 0) AS n_matches,
       coalesce(n_passages, 0)::BIGINT AS n_passages
FROM d LEFT JOIN b USING (r)"""
