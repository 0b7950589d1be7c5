"""Licence scans by Dice coefficient over word bigrams, in SQL functions alone.

A text's blocks (its lines, sentences, paragraphs and the whole of it) are normalised to lower-case words of a-z and 0-9
and compared with licence templates: twice the shared distinct bigrams over the sum of both counts. A template can only
reach the threshold t with a block that has between t / (2 - t) and (2 - t) / t times its bigrams; others are pruned by
size before anything is intersected. Before that, blocks are left out that hold none of the templates' anchor words. The
anchors are chosen so that the bigrams of a template which touch none of them are fewer than the threshold needs, so a
block without an anchor can't match and nothing is lost.

Comment lines without words part paragraphs like blank lines. Joins of 2 to `RUN` consecutive sentences are compared as
well; of windows that share sentences the best counts, and they add the licences that no block names, once each.

The sentence with which both BSD licences begin names `BSD` alone; which of them it is, the whole text or the third clause
tells.

Everything happens inside a document's row: no explode, join or shuffle, so neither long documents nor groups of copies
meet in one task.

Defined cases: null or empty text, and text without a block that reaches the threshold, has no licence, Dice 0 and no
matches; of equal scores the template listed first wins; a block that stands in a text several times counts once;
repeated rows give repeated results; an empty table gives no rows; other columns are ignored by `scan`.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Sentences of the longest window: one more than the longest template has.
RUN = 4

# Public licence notices and the paragraphs of short licences, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    (
        "Apache-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "MIT",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT '
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
        " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
        ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
        " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
        " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
        " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
        ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
        " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
        " Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
        " 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be"
        " appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."
        " 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
        "your option) any later version.",
    ),
)


def template_bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template, sorted."""
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """The fewest and most bigrams of a block that can reach the threshold with a template of n bigrams."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def anchors(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Words of which every block that reaches the threshold holds one, for any of the templates."""
    chosen: set[str] = set()
    for _, text in sorted(templates, key=lambda t: len(t[1])):
        grams = template_bigrams(text)
        low, _ = size_bounds(len(grams), threshold)
        need = max(1, math.ceil(threshold * (low + len(grams)) / 2 - 1e-9))
        left = [g for g in grams if not chosen & set(g.split())]
        while len(left) >= need:
            counts = Counter(w for g in left for w in set(g.split()))
            # the longer word of two that cover as much: it is the rarer one in prose
            word = max(counts, key=lambda w: (len(w) > 4, counts[w] * len(w), w))
            chosen.add(word)
            left = [g for g in left if word not in g.split()]
    return sorted(chosen)


def _let(value: Column, then) -> Column:
    """`then` over a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def bigrams(block: Column) -> Column:
    """The distinct word bigrams of a block."""
    words = F.split(F.trim(F.regexp_replace(F.lower(block), "[^a-z0-9]+", " ")), " ")
    return _let(words, lambda w: F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))))


def sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "([.!?;:])[ \t\n]+", "$1\u0001"), "\u0001")


def blocks(text: Column) -> Column:
    """The distinct lines, sentences and paragraphs of a text, and the whole of it."""
    lines = F.split(text, "\n")
    paragraphs = F.split(text, "\n[ \t\r]*\n")
    bare = F.split(F.regexp_replace(text, r"(?m)^[ \t]*(?:/\*+|\*+/|//+|--+|[*#;%]+)[ \t\r]*$", ""), "\n[ \t\r]*\n")
    return F.array_distinct(F.concat(lines, sentences(text), paragraphs, F.array(text), bare))


def windows(text: Column) -> Column:
    """array<struct<b, i, n>>: the joins b of n = 1 to RUN consecutive sentences from the i-th."""
    none = F.array().cast("array<struct<b:string,i:int,n:int>>")
    join = lambda s, i, n: F.struct(F.array_join(F.slice(s, i, n), " ").alias("b"), i.alias("i"), n.alias("n"))
    joins = lambda s: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(RUN)), lambda n: F.when(F.size(s) >= n, F.transform(F.sequence(F.lit(1), F.size(s) - n + 1), lambda i: join(s, i, n))).otherwise(none)))
    return _let(sentences(text), joins)


def matches(text: Column, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """array<struct<dice, order, license>>: for each block that reaches the threshold its best template."""
    rows = []
    for k, (name, body) in enumerate(templates):
        grams = template_bigrams(body)
        low, high = size_bounds(len(grams), threshold)
        rows.append(F.struct(F.lit(-k).alias("order"), F.lit(name).alias("license"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.array(*[F.lit(g) for g in grams]).alias("grams")))
    known = F.array(*rows)
    anchor = r"(?:^|[^a-z0-9])(?:" + "|".join(anchors(templates, threshold)) + r")(?:[^a-z0-9]|$)"

    def scored(grams: Column) -> Column:
        sized = F.filter(known, lambda t: F.size(grams).between(t["low"], t["high"]))
        dice = lambda t: F.size(F.array_intersect(grams, t["grams"])) * F.lit(2.0) / (F.size(grams) + F.size(t["grams"]))
        return F.array_max(F.transform(sized, lambda t: F.struct(dice(t).alias("dice"), t["order"].alias("order"), t["license"].alias("license"))))

    def reached(parts: Column) -> Column:
        held = F.filter(parts, lambda b: F.lower(b).rlike(anchor))
        return F.filter(F.transform(held, lambda b: _let(bigrams(b), scored)), lambda m: m["dice"] >= threshold)

    def spans(parts: Column) -> Column:
        held = F.filter(parts, lambda w: F.lower(w["b"]).rlike(anchor))
        scores = F.transform(held, lambda w: F.struct(_let(bigrams(w["b"]), scored).alias("m"), w["i"].alias("i"), w["n"].alias("n")))
        return F.filter(scores, lambda w: w["m"]["dice"] >= threshold)

    def best(some: Column) -> Column:
        """Of windows that share sentences, those that no other surpasses."""
        meet = lambda x, y: (y["i"] < x["i"] + x["n"]) & (x["i"] < y["i"] + y["n"]) & (y["m"] > x["m"])
        return F.transform(F.filter(some, lambda x: ~F.exists(some, lambda y: meet(x, y))), lambda x: x["m"])

    def joined(found: Column, more: Column) -> Column:
        new = F.array_except(F.transform(more, lambda m: m["license"]), F.transform(found, lambda m: m["license"]))
        return F.concat(found, F.transform(new, lambda x: F.array_max(F.filter(more, lambda m: m["license"] == x))))

    found = _let(reached(blocks(text)), lambda f: _let(_let(spans(windows(text)), best), lambda more: joined(f, more)))
    return F.when(F.lower(text).rlike(anchor), found)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, licenses, n_matches): the best licence of each document, and all that it names."""
    found = docs.select(F.col("`doc_id`").alias("doc_id"), matches(F.col("`text`").cast("string"), templates, threshold).alias("m"))
    best = F.array_max("m")
    return found.select(
        "doc_id",
        best["license"].alias("license"),
        F.coalesce(F.round(best["dice"], 6), F.lit(0.0)).alias("dice"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda x: x["license"]))), ","), F.lit("")).alias("licenses"),
        F.coalesce(F.size("m"), F.lit(0)).cast("bigint").alias("n_matches"),
    )
