"""Licence scans: Dice coefficient over word bigrams against licence templates.

A passage is one line of a text, the whole text where it has several lines, or a
run of as many words as a template has, wherever lines break: such windows begin
at every eighth part of their length. So notices are found in comments, wrapped
over lines, or within longer lines, and whole licence texts within files. A
passage is normalised (lower case, punctuation to spaces) and compared to
templates whose size allows the threshold at all: with a and b distinct bigrams, the
coefficient 2|A and B| / (a + b) can reach t only if a and b differ by at most
the factor (2 - t) / t. DataFrame functions only, and no shuffle of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Licence notices in common use: identifier, notice. Fixed values.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]


def normalised(text: str) -> list[str]:
    """The template side of the normalisation: ASCII letters and digits of other scripts stay."""
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()


def template_bigrams(notice: str) -> list[str]:
    w = normalised(notice)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def step_of(n: int) -> int:
    """Words from the start of one window of n words to the next."""
    return max(1, n // 8)


def _words(passage: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(passage), "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", " "), " "), lambda w: w != "")


def _bigrams(w: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row and licence found: doc_id, license, dice (the best), n_passages.

    ``dice`` is rounded to 6 places; ``n_passages`` counts lines, the whole text
    and windows that reach the threshold. Templates are a short list that is part
    of the plan. Null and empty texts, and passages of fewer than two words,
    match nothing. Repeated rows of a document give one row each; a null id is
    kept. Other columns are ignored.

    A passage that reaches the threshold holds a word of a few that ``anchors``
    finds, so texts, lines and windows without one are passed over.
    """
    wanted = [(name, len(normalised(notice)), template_bigrams(notice)) for name, notice in (templates if templates is not None else TEMPLATES)]
    wanted = [x for x in wanted if x[2]]
    result = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    if not wanted:
        return result.limit(0).selectExpr("doc_id", "'' AS license", "0D AS dice", "0L AS n_passages")
    factor = (2 - threshold) / threshold
    least, most = min(len(b) for *_, b in wanted) / factor, max(len(b) for *_, b in wanted) * factor

    lines = F.split("text", "\n")
    heads = anchors([b for *_, b in wanted], threshold)
    hinted = lambda w: F.arrays_overlap(w, F.array(*map(F.lit, heads))) if heads else F.lit(True)
    result = result.where(hinted(_words(F.col("text")))).withColumn("words", _words(F.col("text")))
    passages = F.when(F.size(lines) > 1, F.concat(lines, F.array("text"))).otherwise(lines)
    sets = F.filter(F.transform(F.filter(F.transform(passages, _words), hinted), _bigrams), lambda b: F.size(b).between(int(least), int(most) + 1))
    result = result.select("doc_id", "words", F.array_distinct("words").alias("distinct_words"), sets.alias("sets"))

    def dice(b: Column, t: list[str]) -> Column:
        fits = F.size(b).between(int(-(-len(t) // factor)), int(len(t) * factor + 1e-9))
        literal = F.array(*[F.lit(x) for x in t])
        return F.when(fits, 2.0 * F.size(F.array_intersect(b, literal)) / (F.size(b) + len(t))).otherwise(0.0)

    def windowed(n: int, t: list[str]) -> Column:
        """The coefficients of the windows of n words with an anchor of the template; a shorter text is no window."""
        step, last, own = step_of(n), F.size("words") - n, F.array(*map(F.lit, anchors([t], threshold)))
        # a window at the threshold has a part of the template's words, of which its share of distinct bigrams holds
        enough = 4 * F.size(F.array_intersect("distinct_words", F.array(*map(F.lit, sorted({w for g in t for w in g.split(" ")}))))) >= len({w for g in t for w in g.split(" ")})
        marks = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(own, w) if anchors([t], threshold) else F.lit(True), i)), lambda i: i.isNotNull())
        around = F.flatten(F.transform(marks, lambda m: F.sequence(F.greatest(F.ceil((m - n + 1) / step), F.lit(0)).cast("int"), F.greatest(F.floor(m / step), F.lit(0)).cast("int"))))
        starts = F.filter(F.array_distinct(F.transform(around, lambda k: k * step)), lambda k: k <= last)
        return F.when((last >= 0) & enough, F.transform(starts, lambda k: dice(_bigrams(F.slice("words", k + 1, F.lit(n))), t))).otherwise(F.array().cast("array<double>"))

    names = sorted({name for name, *_ in wanted})

    def scores(name: str) -> Column:
        own = [(n, t) for m, n, t in wanted if m == name]
        return F.concat(F.transform("sets", lambda b: F.greatest(F.lit(0.0), *[dice(b, t) for _, t in own])), *[windowed(n, t) for n, t in own])

    best = F.array(*[F.struct(F.lit(n).alias("license"), F.filter(scores(n), lambda d: d >= threshold).alias("hits")) for n in names])
    found = result.select("doc_id", F.explode(F.filter(best, lambda x: F.size(x["hits"]) > 0)).alias("x"))
    return found.select("doc_id", F.col("x.license").alias("license"), F.round(F.array_max("x.hits"), 6).alias("dice"), F.size("x.hits").cast("long").alias("n_passages"))


def anchors(bigrams: list[list[str]], threshold: float) -> list[str]:
    """Long words or numbers of which every passage that reaches the threshold holds at least one; none if there are no such words.

    A passage without them shares with a template only the bigrams without them,
    so its coefficient is at most 2k / (k + n) with k of the n bigrams.
    """
    chosen: list[str] = []
    while True:
        left = [b for b in bigrams if 2 * (k := sum(1 for g in b if not set(g.split(" ")) & set(chosen))) / (k + len(b)) >= threshold]
        if not left:
            return chosen
        words = {w for b in left for g in b for w in g.split(" ") if len(w) > 5} - set(chosen) or {w for b in left for g in b for w in g.split(" ") if w.isdigit()} - set(chosen)
        if not words:
            return []
        chosen.append(max(sorted(words), key=lambda w: sum(1 for b in left for g in b if w in g.split(" "))))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licences found in every whole document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def oracle() -> str:
    """The same scan in DuckDB: passages by row, distinct bigrams, overlap with every template, no pruning."""
    rows = ", ".join(f"('{name}', {len(normalised(notice))}, {step_of(len(normalised(notice)))}, {_sql_list(template_bigrams(notice))})" for name, notice in TEMPLATES)
    return f"""
WITH t(license, n, step, grams) AS (VALUES {rows}),
numbered AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL),
passages AS (
  SELECT r, doc_id, i, l[i] AS p FROM (SELECT r, doc_id, string_split(text, chr(10)) AS l FROM numbered), unnest(range(1, len(l) + 1)) AS x(i)
  UNION ALL SELECT r, doc_id, 0, text FROM numbered WHERE contains(text, chr(10))),
words AS (SELECT r, doc_id, i, list_filter(string_split(regexp_replace(lower(p), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g'), ' '), lambda w: w <> '') AS w
  FROM passages),
grams AS (SELECT r, doc_id, i, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS b FROM words WHERE len(w) > 1),
of_lines AS (SELECT r, doc_id, i, license, max(2.0 * len(list_intersect(b, grams)) / (len(b) + len(grams))) AS d FROM grams, t GROUP BY ALL),
whole AS (SELECT r, doc_id, w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) AS b FROM words WHERE i = 0 OR r NOT IN (SELECT r FROM passages WHERE i = 0)),
common AS (SELECT r, doc_id, w, b, license, n, step, grams FROM whole, t WHERE len(w) >= n AND 4 * len(list_intersect(b, grams)) >= len(grams)),
cut AS (SELECT r, doc_id, license, grams, list_distinct(b[s + 1 : s + n - 1]) AS b FROM common, unnest(range(0, len(w) - n + 1, step)) AS x(s)),
of_windows AS (SELECT r, doc_id, license, 2.0 * len(list_intersect(b, grams)) / (len(b) + len(grams)) AS d FROM cut),
scored AS (SELECT r, doc_id, license, d FROM of_lines UNION ALL SELECT r, doc_id, license, d FROM of_windows)
SELECT doc_id, license, round(max(d), 6) AS dice, count(*) AS n_passages FROM scored WHERE d >= {THRESHOLD} GROUP BY r, doc_id, license
"""
