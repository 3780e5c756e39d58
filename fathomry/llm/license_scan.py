"""Licence scans, native: normalised text against licence templates by the Dice coefficient of word bigrams (repeats
included, so that a unit of n words has n - 1).

A text is cut into units: its lines, its sentences within lines, its paragraphs (blocks between blank lines) and itself,
so that a licence line in a long text, a notice between other sentences of a line, and a licence of many lines are
found. A notice is missed where it shares a unit with much else in all of these ways.

Units and templates are normalised alike: lower case, everything but letters and digits is a space. Size bounds prune:
with threshold t a unit of a bigrams can reach a template of b only if t / (2 - t) <= a / b <= (2 - t) / t, and units
outside all bounds are dropped before they are cut into bigrams. As a unit must share that part of a template's bigrams
too, it has at least one of any words that stand in the rest; texts and units without such an anchor are dropped first.
Only DataFrame functions run.

Per document: the best licence (highest Dice, then the first in the list), its Dice, and the number of matching units.
Null and empty texts, and texts without a match, have a null licence, a null Dice and no units. Equal units of a text
count once. Rows that share a doc_id are one document here, null doc_ids too. Columns other than doc_id and text are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DICE = 0.8
#: Characters of templates up to which their bigrams are broadcast.
MOST_BROADCAST = 1 << 20

#: Parts of licences that stand in several templates, as the licences word them.
MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Licence notices as their licences word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", f"{BSD_GRANT} {BSD_TWO} {BSD_AS_IS}"),
    ("BSD-3-Clause", BSD_GRANT),
    ("BSD-3-Clause", f"{BSD_GRANT} {BSD_TWO} {BSD_THREE} {BSD_AS_IS}"),
    ("BSD-3-Clause", BSD_THREE),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("ISC", ISC_GRANT),
    ("ISC", f"{ISC_GRANT} {ISC_AS_IS}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", MIT_GRANT),
    ("MIT", MIT_NOTICE),
    ("MIT", MIT_AS_IS),
    ("MIT", f"{MIT_GRANT} {MIT_NOTICE} {MIT_AS_IS}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "Apache-2.0", "ISC", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "Unlicense", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "AGPL-3.0-only")]

#: Words that stand in texts of every kind; others are better anchors.
COMMON = frozenset("a all an and any are as at be by for from have in is it may must not of on or that the this to under use was which with you your".split())


def normalised(text: Column, keep: str = "") -> Column:
    """Lower case; everything but letters, digits and `keep` is a space."""
    return F.trim(F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}{keep}]+", " "))


def bigrams(words: Column) -> Column:
    """All bigrams of an array of words, repeats included."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def templates(spark: SparkSession, notices: list[tuple[str, str]], dice: float) -> DataFrame:
    """(template, license, size, low, high, bigram, times): the bigrams of each notice and the sizes that can match it; as large as the list is."""
    df = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(notices)], "template int, license string, notice string")
    df = df.select("template", "license", bigrams(F.split(normalised(F.col("notice")), " ")).alias("all"))
    ratio = dice / (2 - dice)
    df = df.withColumn("size", F.size("all")).withColumns({"low": F.ceil(F.col("size") * ratio), "high": F.floor(F.col("size") / ratio)})
    df = df.select("template", "license", "size", "low", "high", F.explode("all").alias("bigram"))
    return df.groupBy(*df.columns).agg(F.count("*").alias("times"))


def anchors(notices: list[tuple[str, str]], dice: float) -> list[str]:
    """Words one of which is in every unit that reaches `dice` with a notice.

    Such a unit has dice / (2 - dice) of the notice's bigrams. Words are chosen, the longest of those that aren't
    COMMON first, until fewer bigrams than that are without one.
    """
    out: set[str] = set()
    for _, notice in notices:
        words = re.sub(r"[\W_]+", " ", notice.lower()).split()
        pairs = list(zip(words, words[1:], strict=False))
        needed = len(pairs) * dice / (2 - dice)
        for word in sorted(Counter(words), key=lambda w: (w in COMMON, -len(w), w)):
            if sum(not out.intersection(p) for p in pairs) < needed:
                break
            out.add(word)
    return sorted(out)


def units(docs: DataFrame, low: int, high: int, any_of: list[str]) -> DataFrame:
    """(doc_id, unit, words): the distinct units of `low` to `high` bigrams that have one of some words, normalised."""
    docs = docs.where(F.lower("text").rlike("|".join(any_of) if any_of else "(?!)"))
    text = normalised(F.col("text"), r"\n")
    parts = F.concat(
        F.split("text_", "\n"),
        F.split(F.lower("text"), r"[.!?]+[ \t]+|\n"),
        F.when(F.col("text_").rlike(r"\n ?\n"), F.split("text_", r"\n ?\n[\n ]*")).otherwise(F.array()),
        F.array("text_"),
    )
    split = docs.select("doc_id", "text", text.alias("text_")).select("doc_id", F.explode(F.array_distinct(parts)).alias("part"))
    split = split.select("doc_id", normalised(F.col("part")).alias("unit")).withColumn("words", F.split("unit", " "))
    return split.where((F.size("words") - 1).between(low, high) & F.arrays_overlap("words", F.array(*map(F.lit, any_of)).cast("array<string>")))


def scan(spark: SparkSession, docs: DataFrame, notices: list[tuple[str, str]] | None = None, dice: float = DICE) -> DataFrame:
    """(doc_id, license, dice, n_units) of every doc_id."""
    notices = TEMPLATES if notices is None else notices
    known = templates(spark, notices, dice)
    low, high = known.agg(F.min("low"), F.max("high")).first()
    found = units(docs, max(1, low or 1), high or 0, anchors(notices, dice))
    found = found.select("doc_id", "unit", (F.size("words") - 1).alias("unit_size"), F.posexplode(bigrams(F.col("words"))).alias("at", "bigram"))
    # a bigram of the fixed list is a hundred bytes; a caller's longer list is left to the optimiser
    side = F.broadcast(known) if sum(len(text) for _, text in notices) < MOST_BROADCAST else known
    shared = found.join(side, (found["bigram"] == known["bigram"]) & found["unit_size"].between(known["low"], known["high"])).drop(found["bigram"])
    shared = shared.groupBy("doc_id", "unit", "unit_size", "template", "license", "size", "bigram", "times").agg(F.count_distinct("at").alias("n"))  # a unit that stands twice counts once
    shared = shared.groupBy("doc_id", "unit", "unit_size", "template", "license", "size").agg(F.sum(F.least("n", "times")).alias("common"))
    matched = shared.withColumn("dice", 2 * F.col("common") / (F.col("unit_size") + F.col("size"))).where(F.col("dice") >= dice)
    best = matched.groupBy("doc_id").agg(F.max_by("license", F.struct("dice", -F.col("template"))).alias("license"), F.max("dice").alias("dice"), F.countDistinct("unit").alias("n_units"))
    ids = docs.select("doc_id").distinct()
    out = ids.alias("d").join(best.alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")), "left")
    return out.select("d.doc_id", "license", "dice", F.coalesce("n_units", F.lit(0)).alias("n_units"))
