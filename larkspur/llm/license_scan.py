"""Licence scan (operator 3, DataFrame functions only).

Every line of a text, and the text as a whole, is normalised to words of a-z and 0-9 and compared to
licence templates by the Dice coefficient of their sets of word bigrams. Two sets can reach a Dice of
t only if their sizes differ by a factor of at most (2 - t) / t, so most templates are passed over by
size before any bigram is compared. The templates are a fixed small list and travel as a literal; a
row is handled by itself, without any shuffle.

A template that neither a line nor the whole text matches is then compared to every run of
consecutive lines of at most twice as many words as the greatest set that can match has bigrams; the
best run counts as one match. Runs that cannot match are passed over exactly: the text must have
enough of the template's bigrams, and so must the run; and a run whose first or last line adds none
is never better than the run without that line. Comment marks are no words, so they do not matter.

Results in odd cases: a null or empty text, and text of less than two words, matches nothing; lines
with the same bigrams, and a text of one such line, count once; a wrapped licence counts once for each
template, however often it is there; several templates may match one line, and ties do not matter, as
all are counted; repeated rows give one result each; an empty table gives an empty result; other
columns, whatever their names, are ignored; whole texts of any length are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontamination import lower_ascii

#: Short notices and the text of short licences, by name.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "GPL-2.0": [
        "Licensed under the GNU General Public License v2.0.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions:",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "proprietary": ["All rights reserved.", "Confidential and proprietary. All rights reserved."],
}


def bigram_set(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def prepared(templates: dict[str, list[str]], percent: int) -> list[tuple[str, list[str], int, int]]:
    """(name, bigrams, least and greatest size of a set that can match)."""
    out = []
    for name, texts in templates.items():
        for text in texts:
            found = bigram_set(text)
            n = len(found)
            out.append((name, found, -(-n * percent // (200 - percent)), n * (200 - percent) // percent))
    return out


def bigrams_of(segment: Column, least: int, most: int) -> Column:
    """Distinct bigrams of a segment; none if it has too few or too many words for any template."""
    words = F.regexp_extract_all(segment, F.lit("([a-z0-9]+)"))
    bound = F.transform(F.array(words), lambda w: F.when(F.size(w) > least, F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))).otherwise(F.array().cast("array<string>")))
    return F.get(bound, F.lit(0))


def in_runs(template: Column, words: Column, grams: Column, percent: int) -> Column:
    """The best coefficient of a template with a run of lines, or null. `words` are structs of the
    words before (`back`) and from (`rest`) each word in its line; `grams` the bigrams by first word."""
    need, limit = template["need"], template["limit"]
    hit = lambda g, p: F.when(F.array_contains(template["bigrams"], g), F.struct(p.alias("p"), (p - F.get(words, p)["back"]).alias("first"), (p + 1 + F.get(words, p + 1)["rest"]).alias("end")))

    def best(hits: Column) -> Column:
        n = F.size(hits)
        starts = lambda q: ((q == 0) | (F.get(hits, q)["first"] != F.get(hits, q - 1)["first"])) & (F.get(hits, q + need - 1)["p"] - F.get(hits, q)["first"] < limit)

        def from_start(q: Column) -> Column:
            first = F.get(hits, q)["first"]
            ends = lambda r: ((r == n - 1) | (F.get(hits, r + 1)["end"] != F.get(hits, r)["end"])) & (F.get(hits, r)["end"] - first <= limit)
            runs = F.transform(F.filter(F.sequence(q + need - 1, F.least(n - 1, q + limit)), ends), lambda r: F.array_distinct(F.slice(grams, first + 1, F.get(hits, r)["end"] - first - 1)))
            sizes = F.transform(runs, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_intersect(template["bigrams"], x)).alias("common")))
            fits = F.filter(sizes, lambda x: 200 * x["common"] >= percent * (x["n"] + template["size"]))
            return F.array_max(F.transform(fits, lambda x: 2 * x["common"] / (x["n"] + template["size"])))

        return F.when(n >= need, F.array_max(F.transform(F.filter(F.sequence(F.lit(0), n - need), starts), from_start)))

    return F.get(F.transform(F.array(F.filter(F.transform(grams, hit), lambda h: h.isNotNull())), best), F.lit(0))


def scan_licences(docs: DataFrame, templates: dict[str, list[str]] | None = None, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of (id, n_matches, licences, best_dice): matches of distinct lines and of runs of lines
    with templates, the names, and the best coefficient (0 without a match)."""
    known = prepared(templates or TEMPLATES, percent)
    least, most = min(x[2] for x in known), max(x[3] for x in known)
    needs = [-(-percent * (lo + len(b)) // 200) for _, b, lo, _ in known]
    literal = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("name"), F.array(*map(F.lit, b)).alias("bigrams"), F.lit(len(b)).alias("size"), F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.lit(need).alias("need"), F.lit(2 * hi).alias("limit")) for k, ((n, b, lo, hi), need) in enumerate(zip(known, needs))])
    every = F.array(*map(F.lit, sorted({g for _, b, _, _ in known for g in b})))
    text = lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    sets = docs.select(F.col(id_col).alias("id"), text.alias("t")).select("id", "t", F.transform(F.array_union(F.split("t", "\n"), F.array("t")), lambda s: bigrams_of(s, least, most)).alias("sets"))

    def matches(found: Column) -> Column:
        n = F.size(found)
        fits = F.filter(literal, lambda t: (n >= t["low"]) & (n <= t["high"]))
        tried = F.transform(fits, lambda t: F.struct(t["k"].alias("k"), t["name"].alias("name"), (n + t["size"]).alias("sum"), F.size(F.array_intersect(t["bigrams"], found)).alias("common")))
        good = F.filter(tried, lambda t: 200 * t["common"] >= percent * t["sum"])
        return F.transform(good, lambda t: F.struct(t["k"].alias("k"), t["name"].alias("name"), (2 * t["common"] / t["sum"]).alias("dice"), F.array_sort(found).alias("set")))

    # the whole text is the last segment
    own = F.transform(F.array_distinct(F.flatten(F.transform("sets", matches))), lambda h: F.struct(h["k"].alias("k"), h["name"].alias("name"), h["dice"].alias("dice")))
    hits = sets.select("id", "t", own.alias("hits"), F.array_intersect(every, F.element_at("sets", -1)).alias("here"))
    open_ = lambda t: (t["need"] > 0) & (F.size("here") >= t["need"]) & (F.size(F.array_intersect(t["bigrams"], F.col("here"))) >= t["need"]) & ~F.exists("hits", lambda h: h["k"] == t["k"])
    hits = hits.select("id", "t", "hits", F.when(F.contains("t", F.lit("\n")), F.filter(literal, open_)).alias("tried"))
    lines = F.transform(F.split("t", "\n"), lambda x: F.regexp_extract_all(x, F.lit("([a-z0-9]+)")))
    words = F.flatten(F.transform(lines, lambda w: F.transform(w, lambda x, i: F.struct(x.alias("word"), i.alias("back"), (F.size(w) - i).alias("rest")))))
    hits = hits.select("id", "hits", "tried", F.when(F.size("tried") > 0, words).alias("words"))
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat_ws(" ", a["word"], b["word"]))
    hits = hits.select("id", "hits", "tried", "words", F.when(F.size("tried") > 0, pairs).alias("grams"))
    runs = F.filter(F.transform("tried", lambda t: F.struct(t["k"].alias("k"), t["name"].alias("name"), in_runs(t, F.col("words"), F.col("grams"), percent).alias("dice"))), lambda h: h["dice"].isNotNull())
    hits = hits.select("id", F.when(F.size("tried") > 0, F.concat("hits", runs)).otherwise(F.col("hits")).alias("hits"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["name"]))), ",")
    best = F.round(F.coalesce(F.array_max(F.transform("hits", lambda h: h["dice"])), F.lit(0.0)), 6)
    return hits.select(F.col("id").alias(id_col), F.size("hits").cast("long").alias("n_matches"), names.alias("licences"), best.alias("best_dice"))
