"""License scans: Dice coefficient over word bigrams against licence templates (operator 10).

Units of a text are the whole text, its paragraphs and its lines. A unit is
normalised (lower case, runs of anything but letters and digits become one blank), and
its bigrams are compared with those of a template as multisets:
``2 * common / (bigrams of the unit + bigrams of the template)``. Common bigrams cannot
outnumber either side, so a template can reach the threshold only for units whose
number of bigrams lies within bounds that follow from its own; units meet templates by
an equality join on that number, and bigrams are built only for units that meet one.

Licences that begin or end within a line, or run over several paragraphs, are found as
windows of words of the whole text. A window that begins and ends with bigrams of a
template is never worse than one that goes beyond them, so for each such bigram the best
window that begins there is taken. A window of a notice must hold more than half of the
bigrams of the licence's name, as the frame alone is that of any licence. Of windows that
overlap, those below the best are dropped: they are part of its text.

Texts without any of the templates' key words, one of which every match must hold, are
passed over at once.

All DataFrame expressions, no Python on the executors.

Licences differ from their kin by a word or two, so of a unit only the best one is told.

Defined results: null and empty texts and units of fewer than two words match nothing;
whole texts are scanned, however long; of equal scores the licence whose name sorts first
is reported, then the earliest unit; rows sharing a ``doc_id`` are reported together as one
document, null ids as one too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.llm import tables as T

THRESHOLD = 0.8
EVERYDAY = frozenset("""a all an and any are as at be by can do for from has have if in is it its may no not of on one or other out see so
that the their there these this to under use was which will with without work you your 0 1 2 3 4""".split())

# Names under which licences are granted in one-line notices.
NOTICE_NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0 Universal",),
    "GPL-2.0": ("GNU General Public License, version 2",),
    "GPL-3.0": ("GNU General Public License, version 3",),
    "ISC": ("ISC License",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License, version 2.0",),
}
NOTICE_FORMS = ("licensed under {}", "licensed under the {}", "released under the {}", "distributed under the {}",
                "available under the {}", "this work is licensed under the {}", "this work is licensed under a {}")
# Whole licence texts and file headers.
_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": f"{_GRANT} {_DISCLAIMER}",
    "BSD-3-Clause": f"{_GRANT} {_THIRD} {_DISCLAIMER}",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA
02110-1301 USA.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This
library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the
GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth
Floor, Boston, MA 02110-1301 USA""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the
GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


def _words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def templates() -> list[tuple[str, list[str]]]:
    """(licence, words) of every template."""
    texts = [(name, form.format(full)) for name, fulls in NOTICE_NAMES.items() for full in fulls for form in NOTICE_FORMS]
    texts += list(TEXTS.items())
    return [(name, _words(text)) for name, text in texts]


def template_names() -> list[list[str]]:
    """Words of the licence's name in every template, none where the template is a text of its own."""
    return [_words(full) for fulls in NOTICE_NAMES.values() for full in fulls for _ in NOTICE_FORMS] + [[] for _ in TEXTS]


def size_bounds(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach the threshold with a template of n."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def key_words(threshold: float = THRESHOLD) -> list[str]:
    """Words of which every unit that reaches the threshold holds one.

    Without the bigrams that touch them, too few of a template are left: r common
    bigrams give at most 2r / (r + n), as the unit has r or more itself. Words are taken
    greedily, by the share of the bigrams that they cover in all templates, and words of
    everyday prose only where nothing else is left.
    """
    left = [(list(zip(words, words[1:])), len(words) - 1) for _, words in templates()]
    chosen: list[str] = []
    while True:
        gains: Counter = Counter()
        for grams, n in left:
            open_grams = [g for g in grams if not set(g) & set(chosen)]
            if len(open_grams) >= n * threshold / (2 - threshold):
                for word in sorted({w for g in open_grams for w in g}):
                    gains[word] += sum(word in g for g in open_grams) / n / (1e6 if word in EVERYDAY else 1)
        if not gains:
            return chosen
        chosen.append(max(sorted(gains), key=gains.__getitem__))


def _template_rows(threshold: float) -> list[tuple[int, str, int, int, int, list[tuple[str, int]]]]:
    """(template, licence, its number of bigrams, bounds of a unit's, its bigrams with their counts)."""
    rows = []
    for i, (name, words) in enumerate(templates()):
        grams = Counter(f"{a} {b}" for a, b in zip(words, words[1:]))
        low, high = size_bounds(len(words) - 1, threshold)
        rows.append((i, name, len(words) - 1, max(low, 1), high, sorted(grams.items())))
    return rows


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _bigrams(words: Column) -> Column:
    """One array of the bigrams of normalised words, in an array; bound as a lambda variable, the words are split once, not once a use."""
    return F.transform(F.array(F.split(words, " ")), lambda w: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))


def units(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, unit, words: the whole text, its paragraphs and lines, normalised, each distinct one once."""
    body = T.text_or_empty(text)
    parts = F.concat(F.array(body), F.split(body, r"\n\s*\n"), F.split(body, "\n"))
    return docs.select("doc_id", F.posexplode(F.array_distinct(F.transform(parts, _plain))).alias("unit", "words"))


def windows(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice of the word windows of ``docs`` (doc_id, text) that reach the threshold, the best where they overlap."""
    spark = docs.sparkSession
    # fixed tables: the bigrams of the templates
    grams, own = [], []
    for (i, name, n, low, high, counted), words in zip(_template_rows(threshold), template_names()):
        named = {f"{a} {b}" for a, b in zip(words, words[1:])}
        grams += [(gram, i, times, gram in named) for gram, times in counted]
        own.append((i, name, n, low, high, len(named)))
    grams = spark.createDataFrame(grams, "gram string, template int, times int, named boolean")
    own = spark.createDataFrame(own, "template int, license string, own int, low int, high int, names int")
    known = sorted({r["gram"] for r in grams.collect()})
    # rows with the same id and text have the same windows; the set of positions holds them once
    text = ("doc_id", "key")
    found = docs.select("doc_id", F.xxhash64("text").alias("key"), F.explode(_bigrams(_plain(T.text_or_empty()))).alias("made")) \
        .select(*text, F.posexplode("made").alias("pos", "gram")).where(F.col("gram").isin(known)) \
        .groupBy(*text, "gram").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # a bigram counts in a window if fewer than the template's number of the same stand before it there:
    # if the one so many before it stands before the window
    hits = F.transform("at", lambda p, k: F.struct(p.alias("pos"), F.when(
        k >= F.col("times"), F.get("at", k - F.col("times"))).otherwise(-1).alias("block"), F.col("named").alias("named")))
    hits = found.join(F.broadcast(grams), "gram").select(*text, "template", hits.alias("hits")) \
        .groupBy(*text, "template").agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits")) \
        .join(F.broadcast(own), "template").where(F.size("hits") >= F.col("low"))
    starts = F.filter(F.transform("hits", lambda h, i: F.struct(
        h["pos"].alias("start"), i.alias("i"), F.get("hits", i + F.col("low") - 1)["pos"].alias("reach"))),
        lambda s: s["reach"] < s["start"] + F.col("high"))

    def best(start: Column, counted: Column) -> Column:
        made = F.transform(counted, lambda h, c: F.struct(
            (2 * (c + 1) / (h["pos"] - start + 1 + F.col("own"))).alias("dice"), h["pos"].alias("end"), c.alias("c")))
        return F.array_max(F.filter(made, lambda w: (w["dice"] >= threshold) & ((F.col("names") == 0) | (
            2 * F.size(F.filter(F.slice(counted, 1, w["c"] + 1), lambda h: h["named"])) > F.col("names")))))

    made = F.transform(starts, lambda s: F.struct(s["start"].alias("start"), F.get(F.transform(F.array(F.filter(
        F.slice("hits", s["i"] + 1, F.col("high")), lambda h: (h["pos"] < s["start"] + F.col("high")) & (h["block"] < s["start"]))),
        lambda counted: best(s["start"], counted)), F.lit(0)).alias("best")))
    made = hits.select(*text, "license", F.explode(made).alias("w")).where(F.col("w.best").isNotNull()).select(
        *text, "license", (-F.col("w.best.dice")).alias("low"), F.col("w.start").alias("start"), F.col("w.best.end").alias("end"))
    # windows that overlap, one after the other, are a group
    before = Window.partitionBy(*text).orderBy("start", "end", "license", "low")
    new = (F.col("start") > F.coalesce(F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")
    made = made.withColumn("new", new).withColumn("group", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.aggregate(
        F.sort_array(F.collect_set(F.struct("low", "start", "end", "license"))),
        F.array().cast("array<struct<low:double,start:int,end:int,license:string>>"),
        lambda kept, w: F.when(F.exists(kept, lambda k: (k["start"] <= w["end"]) & (w["start"] <= k["end"]) & (
            (k["low"] < w["low"]) | (k["license"] == w["license"]))), kept).otherwise(F.concat(kept, F.array(w))))
    return made.groupBy(*text, "group").agg(kept.alias("kept")).select("doc_id", F.explode("kept").alias("w")) \
        .select("doc_id", F.col("w.license").alias("license"), (-F.col("w.low")).alias("dice"))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, unit, license, dice of every unit of ``docs`` (doc_id, text) that reaches the threshold, and of the windows (no unit)."""
    spark = docs.sparkSession
    # a fixed table: templates times the sizes within their bounds
    table = spark.createDataFrame(_template_rows(threshold), "template int, license string, own int, low int, high int, "
                                  "grams array<struct<gram:string,times:int>>")
    sizes = table.select("template", F.explode(F.sequence("low", "high")).alias("bigrams"))
    held = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(key_words(threshold))})(?![\p{{L}}\p{{N}}])"
    docs = docs.where(F.lower("text").rlike(held))
    sized = units(docs).withColumn("bigrams", F.octet_length("words") - F.octet_length(F.translate("words", " ", "")))
    sized = sized.join(F.broadcast(sizes.select("bigrams").distinct()), "bigrams", "left_semi")
    # the generator keeps Spark from making the bigrams anew for each template
    met = sized.select("doc_id", "unit", "words", "bigrams", F.explode(_bigrams(F.col("words"))).alias("made")) \
        .join(F.broadcast(sizes), "bigrams").join(F.broadcast(table), "template")
    # no more common bigrams than distinct ones on both sides and the template's repeats; most pairs end here
    most = F.size(F.array_intersect("made", F.transform("grams", lambda g: g["gram"]))) + F.col("own") - F.size("grams")
    both = F.col("bigrams") + F.col("own")
    met = met.where(2 * most >= threshold * both)
    common = F.aggregate("grams", F.lit(0), lambda a, g: a + F.least(
        g["times"], F.size(F.filter("made", lambda x: x == g["gram"]))))
    met = met.withColumn("dice", 2 * common / both).where(F.col("dice") >= threshold)
    # licences share most of their words: of a unit only the best is told
    best = met.groupBy("doc_id", "unit", "words").agg(F.min(F.struct((-F.col("dice")).alias("low"), "license", "dice")).alias("best"))
    return best.select("doc_id", "unit", "best.license", "best.dice") \
        .unionByName(windows(docs, threshold).withColumn("unit", F.lit(None).cast("int")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the best matching licence, its coefficient, and all licences found."""
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "text")
    best = scan(docs).groupBy("doc_id").agg(
        F.min(F.struct((-F.col("dice")).alias("low"), "license", "unit", "dice")).alias("best"),
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"))
    # null ids join too
    own = best.withColumnRenamed("doc_id", "_id")
    return docs.select("doc_id").distinct().join(own, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", F.col("best.license").alias("license"), F.coalesce("best.dice", F.lit(0.0)).alias("dice"),
        F.coalesce("licenses", F.lit("")).alias("licenses"))


def _sql() -> str:
    values = ", ".join("({}, '{}', [{}])".format(i, name, ", ".join(f"'{a} {b}'" for a, b in zip(words, words[1:])))
                       for i, (name, words) in enumerate(templates()))
    return rf"""
WITH t(template, license, grams) AS (VALUES {values}),
u AS (SELECT DISTINCT doc_id, unnest(list_distinct(list_transform(
        [coalesce(text, '')] || regexp_split_to_array(coalesce(text, ''), '\n\s*\n') || string_split(coalesce(text, ''), chr(10)),
        lambda p: trim(regexp_replace(lower(p), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))))) AS p FROM documents),
w AS (SELECT doc_id, p, string_split(p, ' ') AS w, len(string_split(p, ' ')) - 1 AS n FROM u),
g AS (SELECT w.doc_id, w.p, t.license, w.n, len(t.grams) AS own, t.grams,
        list_transform(range(1, w.n + 1), lambda i: w.w[i] || ' ' || w.w[i + 1]) AS made
      FROM w JOIN t ON w.n BETWEEN ceil(len(t.grams) * {THRESHOLD} / {2 - THRESHOLD:.1f} - 1e-9) AND floor(len(t.grams) * {2 - THRESHOLD:.1f} / {THRESHOLD} + 1e-9) AND w.n > 0),
s AS (SELECT doc_id, p, license, 2 * list_sum(list_transform(list_distinct(grams),
        lambda x: least(len(list_filter(grams, lambda y: y = x)), len(list_filter(made, lambda y: y = x)))))::DOUBLE / (n + own) AS dice FROM g),
x AS (SELECT doc_id, arg_min(license, (-dice, license)) AS license, max(dice) AS dice FROM s WHERE dice >= {THRESHOLD} GROUP BY doc_id, p),
b AS (SELECT doc_id, arg_min(license, (-dice, license)) AS license, max(dice) AS dice, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
      FROM x GROUP BY doc_id)
SELECT d.doc_id, b.license, coalesce(b.dice, 0.0)::DOUBLE AS dice, coalesce(b.licenses, '') AS licenses
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN b ON d.doc_id IS NOT DISTINCT FROM b.doc_id"""


OP10_SQL = _sql()
