"""Licence notices by the Dice coefficient of word bigrams; DataFrame functions only.

A segment is a line of a text, or the whole text where it has more lines than one. Segments and templates are
lower-cased and cut into runs of letters and digits; what is compared are their sets of two neighbouring words.
With ``a`` and ``b`` bigrams the coefficient can only reach ``t`` where a * t <= b * (2 - t) and the reverse; a
template whose size is out of these bounds is not compared. The best template of a segment is reported; ties go to the name that comes first.

Notices that are wrapped over lines or stand among other words are found by windows: over the words of the whole text,
a window of as many words as the template has is laid wherever one of the template's key words stands at its place in it.
Key words are the longest ones, as many as it takes that no set of bigrams reaches the limit without one of them. Of
each licence the window with the highest ``3 * shared - n_bigrams - n_template`` (shared bigrams less the others) is
reported, the first one at ties, unless a better window of another licence overlaps it; so a notice is not also taken for
a like one with another version or a clause less.

Defined cases: null and empty texts have no segments of two words and give no rows; repeated rows are reported each;
an empty table gives no rows; segments of any length are compared whole; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccensus.llm.shared import let

#: least Dice coefficient, in hundredths
MIN_DICE = 80

# Public licence notices and the name each stands for
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]


def words_of(text: Column) -> Column:
    return F.split(F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " ")), " ")


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring words of the normalised text."""
    return let(words_of(text), _bigrams)


def _words(template: str) -> list[str]:
    """The words of a template, which is ASCII; part of the plan as constants."""
    return re.findall("[a-z0-9]+", template.lower())


def _pairs(template: str) -> list[str]:
    words = _words(template)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def key_places(template: str, min_dice: int = MIN_DICE) -> list[tuple[str, int]]:
    """Key words of a template with their places in it.

    A window that reaches the limit shares at least b * t / (2 - t) of the template's b bigrams; words are taken, the
    longest first, until fewer bigrams than that are without one.
    """
    words, pairs = _words(template), _pairs(template)
    need = -(-len(pairs) * min_dice // (200 - min_dice))
    keys: set[str] = set()
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        if sum(keys.isdisjoint(p.split()) for p in pairs) < need:
            break
        keys.add(word)
    return [(w, i) for i, w in enumerate(words) if w in keys]


def _row(hit: Column, segment: Column, start: Column) -> Column:
    a, b, n = hit["n_bigrams"], hit["n_template"], hit["shared"]
    return F.struct(
        segment.cast("int").alias("segment"), start.cast("int").alias("start"), hit["licence"].alias("licence"),
        a.alias("n_bigrams"), b.alias("n_template"), n.alias("shared"), (2 * n / (a + b)).alias("dice"),
    )


def _known(templates: list[tuple[str, str]]) -> Column:
    return F.array(*[
        F.struct(F.lit(n).alias("licence"), F.array(*map(F.lit, _pairs(t))).alias("pairs"), F.lit(len(_words(t))).alias("n_words"))
        for n, t in templates
    ])


def segment_hits(text: Column, templates: list[tuple[str, str]], min_dice: int) -> Column:
    """The best template of each line and of the whole text that has one."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("segment"), x.alias("text")))
    whole = F.when(F.contains(text, F.lit("\n")), F.array(F.struct(F.lit(-1).alias("segment"), text.alias("text")))).otherwise(F.array())
    known, rest = _known(templates), 200 - min_dice

    def best(found: Column) -> Column:
        size = F.size(found)
        near = F.filter(known, lambda t: (size * min_dice <= F.size(t["pairs"]) * rest) & (F.size(t["pairs"]) * min_dice <= size * rest))
        scored = F.transform(
            near,
            lambda t: let(
                F.size(F.array_intersect(found, t["pairs"])),
                lambda n: F.struct(
                    (-2 * n / (size + F.size(t["pairs"]))).alias("order"), t["licence"].alias("licence"),
                    F.size(t["pairs"]).alias("n_template"), n.alias("shared"), size.alias("n_bigrams"),
                ),
            ),
        )
        return F.array_min(F.filter(scored, lambda x: 200 * x["shared"] >= min_dice * (size + x["n_template"])))

    found = F.transform(F.concat(lines, whole), lambda s: F.struct(s["segment"].alias("segment"), let(bigrams(s["text"]), best).alias("hit")))
    return F.transform(F.filter(found, lambda x: x["hit"].isNotNull()), lambda x: _row(x["hit"], x["segment"], F.lit(None)))


def window_hits(words: Column, templates: list[tuple[str, str]], min_dice: int) -> Column:
    """The best window of each licence that no better one of another licence overlaps."""
    places: dict[str, list[tuple[int, int]]] = {}
    for t, (_, text) in enumerate(templates):
        for word, p in key_places(text, min_dice):
            places.setdefault(word, []).append((t, p))
    spots = F.create_map(*[
        x for word, found in sorted(places.items())
        for x in (F.lit(word), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in found]))
    ])
    known, keys, names = _known(templates), sorted(places), sorted({n for n, _ in templates})

    def laid(keyed: Column) -> Column:
        starts = F.transform(
            keyed,
            lambda k: F.transform(
                F.element_at(spots, k["w"]), lambda x: F.struct(x["t"].alias("t"), F.greatest(k["i"] - x["p"], F.lit(0)).alias("start"))
            ),
        )
        return F.array_distinct(F.flatten(starts))

    def scored(at: Column) -> Column:
        def one(template: Column) -> Column:
            def hit(found: Column) -> Column:
                size, b = F.size(found), F.size(template["pairs"])
                return let(
                    F.size(F.array_intersect(found, template["pairs"])),
                    lambda n: F.struct(
                        (size + b - 3 * n).alias("order"), at["start"].alias("start"), template["licence"].alias("licence"), b.alias("n_template"),
                        n.alias("shared"), size.alias("n_bigrams"), template["n_words"].alias("n_words"),
                    ),
                )

            return let(_bigrams(F.slice(words, at["start"] + 1, template["n_words"])), hit)

        return let(F.element_at(known, at["t"] + 1), one)

    def first_of_each(hits: Column) -> Column:
        return F.filter(F.array(*[F.array_min(F.filter(hits, lambda h: h["licence"] == n)) for n in names]), lambda h: h.isNotNull())

    def free(best: Column) -> Column:
        def over(h: Column) -> Column:
            return F.exists(best, lambda g: (g < h) & (g["start"] < h["start"] + h["n_words"]) & (h["start"] < g["start"] + g["n_words"]))

        return F.transform(F.filter(best, lambda h: ~over(h)), lambda h: _row(h, F.lit(-2), h["start"]))

    keyed = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda k: k["w"].isin(keys))
    near = F.filter(F.transform(let(keyed, laid), scored), lambda h: 200 * h["shared"] >= min_dice * (h["n_bigrams"] + h["n_template"]))
    # most texts hold no key word
    return F.when(F.exists(words, lambda w: w.isin(keys)), let(let(near, first_of_each), free))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, min_dice: int = MIN_DICE) -> DataFrame:
    """doc_id, segment, start, licence, n_bigrams, n_template, shared, dice.

    ``segment`` is a line number from 0, -1 for the whole text, or -2 for a window, with the number of words before it
    as ``start`` (else null). All in the row: the templates are constants, so nothing is shuffled, joined or broadcast.
    """
    text = docs["text"]
    inside = let(words_of(text), lambda w: window_hits(w, templates, min_dice))
    rows = F.concat(segment_hits(text, templates, min_dice), F.coalesce(inside, F.array()))
    return docs.select("doc_id", F.explode(rows).alias("b")).select("doc_id", "b.*")
