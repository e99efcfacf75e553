"""Licences: Dice coefficient of word bigrams between windows of a text and templates, DataFrame functions only."""

from __future__ import annotations

import json
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Published licence texts, their standard notices, and common one-line statements, by SPDX identifier.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, see <https://www.gnu.org/licenses/>."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This work is licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)
THRESHOLD = (80, 100)
SEPARATORS = r"[^\p{L}\p{N}]+"
Template = tuple[str, list[str]]


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), SEPARATORS, " "))


def listed(values: list[str]) -> Column:
    """A literal array; one string that the optimiser splits, where thousands of single literals are slow to plan."""
    return F.split(F.lit("|".join(values)), "\\|")


def template_grams(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[Template]:
    """Names and word bigrams in order; those of one word are left out."""
    out = []
    for name, text in templates:
        words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
        if len(words) > 1:
            out.append((name, [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]))
    return out


def telling_words(templates: list[Template], p: int, q: int) -> list[str]:
    """Words of which every unit alike to a template holds one, in a bigram of that template.

    A unit alike to a template of n bigrams has at least n * p / (2q - p) of them, so it has one of any set that is
    larger than the rest. Words are chosen until their bigrams are such a set for each template; long words first,
    for they are rare in other texts.
    """
    left = {k: set(grams) for k, (_, grams) in enumerate(templates)}
    wanted = {k: len(g) - -(-len(g) * p // (2 * q - p)) + 1 for k, g in left.items()}
    chosen: list[str] = []
    while wanted:
        value: Counter[str] = Counter()
        for k, need in wanted.items():
            of = Counter(w for g in left[k] for w in set(g.split(" ")))
            for w, n in of.items():
                value[w] += min(n, need) * (len(w) ** 2 if len(w) > 5 else len(w) / 10)
        best = max(value, key=lambda w: (value[w], w))
        chosen.append(best)
        for k in list(wanted):
            hit = {g for g in left[k] if best in g.split(" ")}
            left[k] -= hit
            wanted[k] -= len(hit)
            if wanted[k] <= 0:
                del wanted[k]
    return sorted(chosen)


def guides(grams: list[str], words: list[str]) -> dict[str, int]:
    """The bigrams of a template that hold a telling word, with the place where each stands first."""
    some = set(words)
    return {g: k for k, g in reversed(list(enumerate(grams))) if some & set(g.split(" "))}


def licences(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Licences in every document: a row (doc_id, licence, template, word, dice) for each template that it holds.

    Texts are lower-cased, everything but letters and digits is a space, so that line breaks and comment marks don't
    count. The units that are compared with a template are the stretches of the text as long as the template that
    are laid with one of its telling bigrams (see telling_words) upon the same bigram of the text, cut off at the
    text's ends. Unit and template are alike when the Dice coefficient of their distinct word bigrams is at least
    the threshold, so that near relatives of a licence are found beside it with a lower coefficient; of a template's
    units that with the largest is returned, the first of equals: word is the number of its first word,
    template the number of the template. Texts without any telling word, and templates of which a text holds no telling
    bigram, or too few bigrams by the bounds of their sizes, are passed over, which loses none.

    Null and empty texts and texts of one word give nothing; rows that repeat give repeated rows; ids may be null;
    other columns are never read; texts count whole. The templates are a literal, so nothing is joined, broadcast or
    shuffled.
    """
    p, q = threshold
    known = template_grams(templates)
    words = telling_words(known, p, q)
    low = F.col("low")
    some = docs.select("doc_id", F.explode(F.array(F.lower("text"))).alias("low")).where(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)))
    # exploding an array of one value computes it once, where later steps would otherwise repeat the expression
    split = some.select("doc_id", F.explode(F.array(F.split(normal(low), " "))).alias("w")).where(F.size("w") > 1)
    w = F.col("w")
    grams = split.select("doc_id", F.explode(F.array(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))).alias("grams"))
    # the telling bigrams of a text, by far the fewest of its bigrams, and their places
    own = listed(sorted({g for _, t in known for g in guides(t, words)}))
    some = grams.withColumn("has", F.explode(F.array(F.array_intersect("grams", own)))).where(F.size("has") > 0)
    placed = some.withColumn("at", F.explode(F.array(F.filter(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))), lambda x: F.array_contains("has", x["g"])))))

    kind = "array<struct<licence: string, template: int, m: int, n: int, grams: array<string>, guide: map<string, int>, keys: array<string>>>"
    rows = []
    for k, (name, t) in enumerate(known):
        guide = guides(t, words)
        rows.append({"licence": name, "template": k, "m": len(t), "n": len(set(t)), "grams": sorted(set(t)), "guide": guide, "keys": list(guide)})
    fits = F.filter(F.from_json(F.lit(json.dumps(rows)), kind), lambda t: (F.size("grams") * (2 * q - p) >= t["n"] * p) & F.arrays_overlap("has", t["keys"]))

    def alike(t: Column) -> Column:
        starts = F.array_distinct(F.transform(F.filter("at", lambda x: F.map_contains_key(t["guide"], x["g"])), lambda x: x["i"] - F.element_at(t["guide"], x["g"])))

        def unit(s: Column) -> Column:
            part = F.array_distinct(F.slice("grams", F.greatest(s, F.lit(0)) + 1, t["m"] + F.least(s, F.lit(0))))
            return F.struct(F.size(F.array_intersect(part, t["grams"])).alias("both"), (F.size(part) + t["n"]).alias("total"), F.greatest(s, F.lit(0)).alias("word"))

        def dice(u: Column) -> Column:
            return F.struct((2 * u["both"] / u["total"]).alias("dice"), (-u["word"]).alias("back"))

        enough = F.filter(F.transform(starts, unit), lambda u: 2 * q * u["both"] >= p * u["total"])
        return F.struct(t["licence"].alias("licence"), t["template"].alias("template"), F.array_max(F.transform(enough, dice)).alias("best"))

    found = placed.select("doc_id", F.explode(F.transform(fits, alike)).alias("m")).where("m.best IS NOT NULL")
    return found.select("doc_id", "m.licence", "m.template", (-F.col("m.best.back")).alias("word"), F.round("m.best.dice", 6).alias("dice"))


def licence_sql(threshold: tuple[int, int] = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> str:
    """DuckDB SQL of the same rows over `documents`."""
    p, q = threshold
    known = template_grams(templates)
    words = telling_words(known, p, q)
    rows = ", ".join(f"({k}, '{gram}')" for k, (_, grams) in enumerate(known) for gram in sorted(set(grams)))
    names = ", ".join(f"({k}, '{name}', {len(grams)}, {len(set(grams))})" for k, (name, grams) in enumerate(known))
    laid = ", ".join(f"({k}, '{gram}', {at})" for k, (_, grams) in enumerate(known) for gram, at in sorted(guides(grams, words).items()))
    return rf"""
WITH t(tid, gram) AS (VALUES {rows}),
tn(tid, licence, m, n) AS (VALUES {names}),
guide(tid, gram, o) AS (VALUES {laid}),
d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS words FROM documents WHERE text IS NOT NULL),
g AS (SELECT d.rid, d.doc_id, y.i - 1 AS i, d.words[y.i] || ' ' || d.words[y.i + 1] AS gram FROM d, unnest(range(1, len(d.words))) AS y(i)),
s AS (SELECT DISTINCT g.rid, g.doc_id, guide.tid, g.i - guide.o AS s FROM g JOIN guide ON g.gram = guide.gram),
u AS (SELECT s.rid, s.doc_id, s.tid, s.s, g.gram FROM s JOIN tn ON s.tid = tn.tid JOIN g ON g.rid = s.rid AND g.i >= s.s AND g.i < s.s + tn.m GROUP BY ALL),
c AS (SELECT u.rid, u.doc_id, u.tid, u.s, count(*) AS size, count(t.gram) AS both_n FROM u LEFT JOIN t ON u.tid = t.tid AND u.gram = t.gram GROUP BY ALL),
a AS (SELECT c.rid, c.doc_id, tn.licence, c.tid, greatest(c.s, 0) AS word, 2.0 * c.both_n / CAST(tn.n + c.size AS DOUBLE) AS dice FROM c JOIN tn ON c.tid = tn.tid WHERE 2 * {q} * c.both_n >= {p} * (tn.n + c.size))
SELECT doc_id, licence, CAST(tid AS INTEGER) AS template, CAST(word AS INTEGER) AS word, round(dice, 6) AS dice
FROM a QUALIFY row_number() OVER (PARTITION BY rid, tid ORDER BY dice DESC, word) = 1
"""
