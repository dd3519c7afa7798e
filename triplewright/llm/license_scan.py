"""Licence notices and texts found by the Dice coefficient over word bigrams."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

THRESHOLD = 0.8
# Short words that most English texts hold.
COMMON = "a an and any are as at be by for in is it not of on or such that the this to under use with you".split()
# Notices and paragraphs of public licences. A licence of several paragraphs has one entry for each.
TEMPLATES = [
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("bsd", "Licensed under the BSD License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
# Clauses of the BSD licences.
_BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
_BSD_LIABILITY = "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _whole(name: str, *more: str) -> tuple[str, str]:
    """A licence as one template: the long paragraphs that TEMPLATES has of it, with more after the first."""
    first, *rest = [text for known, text in TEMPLATES if known == name and len(text) > 60]
    return name, " ".join((first, *more, *rest))


TEMPLATES += [
    _whole("mit"),
    (lambda name, text: (name, f"{text} {_BSD_LIABILITY}"))(*_whole("bsd", *_BSD_CLAUSES[:2])),
    (lambda name, text: (name, f"{text} {_BSD_LIABILITY}"))(*_whole("bsd", *_BSD_CLAUSES)),
]


def normalised(text: str) -> list[str]:
    """Words of a template: runs of letters and digits in lower case."""
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _rarity(word: str) -> float:
    """A guess that only says which anchors are taken first."""
    return min(len(word), 9) if len(word) > 5 else 1e-4 if word in COMMON or word.isdigit() else 0.01


def anchors(known: list[list[str]], threshold: float) -> list[str]:
    """Words of which every text holds one that comes to the threshold with one of these templates (lists of bigrams).

    Such a text shares t / (2 - t) of a template's n bigrams at least, so it meets any set of bigrams that leaves out
    fewer than that. Words are taken greedily until the bigrams without any of them are fewer for every template.
    """
    chosen: list[str] = []
    open_ = [(set(grams), math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)) for grams in known]
    while True:
        open_ = [(left, need) for left, need in ((({g for g in left if not set(g.split()) & set(chosen[-1:])}), need) for left, need in open_) if len(left) >= need]
        if not open_:
            return sorted(chosen)
        gain: dict[str, float] = {}
        for left, need in open_:
            missing = len(left) - need + 1
            for word in {w for g in left for w in g.split()}:
                gain[word] = gain.get(word, 0) + min(1.0, sum(word in g.split() for g in left) / missing) * _rarity(word)
        chosen.append(max(sorted(gain), key=gain.__getitem__))


def _units(text: Column) -> Column:
    """The text, its paragraphs of two lines or more, its lines, and the sentences of lines that hold several, as (kind, number, body).

    Lines without a letter or digit, such as the marks of an empty line of a comment, part paragraphs.
    """
    paragraphs = F.split(text, r"\n[^\p{L}\p{N}\n]*\n")
    lines = F.split(text, "\n")
    parted = F.filter(F.transform(lines, lambda x: F.split(F.regexp_replace(x, r"([.!?])[\x20\x09-\x0D]+", "$1\x01"), "\x01")), lambda s: F.size(s) > 1)
    unit = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("unit"), i.alias("unit_no"), x.alias("body"))
    whole = F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("unit_no"), text.alias("body")))
    blocks = F.filter(F.transform(paragraphs, unit("paragraph")), lambda x: F.contains(x["body"], F.lit("\n")))
    single, sentences = F.transform(lines, unit("line")), F.transform(F.flatten(parted), unit("sentence"))
    return F.when(F.size(lines) > 1, F.concat(whole, blocks, single, sentences)).otherwise(F.concat(single, sentences))


def license_scan(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, unit (text, paragraph, line or sentence), unit_no (from 0 within its kind), license and dice of each match.

    A unit is compared with the templates whose number of bigrams allows threshold, that is from
    t / (2 - t) to (2 - t) / t times its own; the best one of threshold or more is returned, on ties the first in
    alphabetical order. Words are runs of letters and digits in lower case, and bigrams count once.
    Null and empty texts, and units of one word, match nothing. Repeated rows are scanned each; an empty table gives an
    empty result. Templates are constants of the plan: nothing is joined or shuffled. Texts without any of the anchors()
    can't match and are not cut into units.
    """
    known = sorted((name, bigrams(normalised(text))) for name, text in (templates or TEMPLATES))
    known = [(name, grams) for name, grams in known if grams]
    if not known:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit("").alias("unit"), F.lit(0).alias("unit_no"), F.lit("").alias("license"), F.lit(0.0).alias("dice")).limit(0)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least = min(len(g) for _, g in known) * low
    constants = json.dumps([{"license": name, "grams": grams, "n": len(grams)} for name, grams in known])
    table = F.from_json(F.lit(constants), "array<struct<license: string, grams: array<string>, n: int>>")

    def best(grams: Column) -> Column:
        size = F.size(grams)
        fits = F.filter(table, lambda t: (size >= t["n"] * low - 1e-9) & (size <= t["n"] * high + 1e-9))
        return F.array_min(F.transform(fits, lambda t: F.struct((-2.0 * F.size(F.array_intersect(grams, t["grams"])) / (size + t["n"])).alias("less"), t["license"].alias("license"))))

    def pairs(words: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
        return F.when((F.size(words) > 1) & (F.size(words) - 1 >= least), let(F.array_distinct(every), best))

    tokens = F.filter(F.split(F.lower("body"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    words = anchors([grams for _, grams in known], threshold)
    alone = [r"(?<![\p{L}\p{N}])" + w + r"(?![\p{L}\p{N}])" if len(w) < 6 else w for w in words]
    some = F.rlike(F.lower(F.col(text_col)), F.lit("|".join(alone)))
    units = docs.filter(some).select(F.col(id_col).alias("doc_id"), F.explode(_units(F.col(text_col))).alias("u")).select("doc_id", "u.*")
    found = units.select("doc_id", "unit", "unit_no", let(tokens, pairs).alias("best")).filter(F.col("best.less") <= -threshold)
    return found.select("doc_id", "unit", "unit_no", "best.license", (-F.col("best.less")).alias("dice"))
