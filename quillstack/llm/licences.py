"""Licence scans: a trained paragraph classifier, a calibrated unknown class, and confirmation against templates.

The classifier is multinomial logistic regression over word 1- and 2-grams, fitted from the templates below (whole, cut
and with words left out) and from prose that shares their words. Its temperature is set by cross-fitting: every template
and sentence is scored by a model that was fitted without it and without anything made of it, so that the probability of
the class ``none`` can be compared with a fixed limit. Every paragraph is scored. Scoring is DataFrame functions only: a
paragraph's n-grams are hashed (xxhash64), looked up in a table of buckets by hash, and the weights of those found are
summed. A prediction counts
if its probability is ``LEAST_PROBABILITY``; it is confirmed if ``LEAST_OVERLAP`` of the shorter side's 2-grams are
shared with a template of that family.

Paragraphs are parted by blank lines if the text has any, else by line ends that end a sentence, so that a wrapped notice
stays together. Null and empty texts have none. Equal
rows are all returned. No documents give no rows. A very long paragraph costs its words once, whatever the model's size.
Other columns are never read.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_PROBABILITY, LEAST_OVERLAP = 0.7, 0.6
#: Parts of the templates of which each is scored by the model of the others, and steps of the fit.
PARTS, STEPS = 4, 200
#: Buckets of the table of n-grams.
BUCKETS = 1 << 13

# Licence notices and paragraphs by family.
TEMPLATES = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Released under the GNU AGPL v3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. The ASF licenses this file to you under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "bsl-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU GPL v2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        """THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Released under the GNU LGPL v3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        """THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "public-domain": (
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
        "Released under CC0.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.",
        "For more information, please refer to <https://unlicense.org>",
        "SPDX-License-Identifier: Unlicense",
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "Released under the zlib License.",
        "SPDX-License-Identifier: Zlib",
    ),
}
# Prose of the class none.
PROSE = (
    "The driving licence was issued by the public office in the town.", "She works in the general store and is free to leave at noon.",
    "A version of the story was published in the local paper last week.", "The software was slow but the program did what it had to do.",
    "He asked for permission to use the library after hours.", "The source of the river lies in the hills above the village.",
    "They released the birds under the old bridge in the morning.", "The conditions on the road were bad and the notice came late.",
    "The foundation of the house was laid by his father.", "Creative work of that kind is common in this city.",
    "The public may obtain a copy of the map at the station.", "His license to fish in the lake ended with the year.",
    "The domain of the king reached the sea in the north.", "Copyright law is taught in the second year.",
    "The file was on the table together with the other documents.", "Any person could see that the terms were fair.",
    "The work was done by hand and without a plan.", "The international version of the game has other rules.",
    "The following day the whole class went to the museum.", "Commercial fishing is not permitted along this coast.",
    "All rights and duties are listed in the contract.", "The code of the safe was known to both of them.",
    "By using this site you agree to our terms of service and privacy policy.", "We use cookies to improve the services that we provide to you.",
    "Please contact the author for further information about the project.", "All rights reserved.",
        "The warranty covers parts and labour for two years.",
    "The company disclaims liability for goods that are damaged in the post.", "A copy of the contract was sent to the purchaser without charge.",
    "The foundation gives grants to people who work in public education.", "Version two of the program will be distributed next month.",
    "You may not bring food into the reading room except with written permission.", "The binary star was found by two students in the eastern sky.",
    "Their library has the source of the play and its later versions.", "The restrictions on travel were lifted in the spring.",
    "The product is provided in three sizes and for any purpose in the house.", "The original claim was rejected by the court of appeal.",
    "Subject to the weather the concert will be held in the open.", "The holder of the ticket is free to choose a seat.",
    "The terms of the loan were modified twice, and each time in writing.", "The public domain of the town is kept by the council.",
    "In no event did the crew leave the ship before the captain.", "An implied promise is still a promise, she said.",
    "Persons to whom the prize is given must accept it in person.", "The following persons have contributed to this volume.",
    "They distribute free copies of the paper at the gate.", "He was licensed to drive a bus in the city.",
        "The general was seen in public with the mayor.",
)
STOP = frozenset("a an and any are as at be by can for had has have he his if in is it may no not of on one or other out she that the they this to was were what which who with you your".split())
NONE = "none"


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def ngrams(found: list[str]) -> set[str]:
    """Content words, and pairs with a content word in them."""
    return {w for w in found if w not in STOP} | {f"{a} {b}" for a, b in zip(found, found[1:], strict=False) if a not in STOP or b not in STOP}


def gram_hash(gram: str) -> int:
    """Spark's xxhash64 of the string."""
    import xxhash

    h = xxhash.xxh64_intdigest(gram.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def examples() -> list[tuple[set[str], str, int]]:
    """(n-grams, class, the number of the text it was made of)."""
    out, no = [], 0
    for family, texts in [*TEMPLATES.items(), (NONE, PROSE)]:
        for text in texts:
            found = words(text)
            variants = [found, found[: max(2, len(found) * 2 // 3)], found[len(found) // 3 :]]
            for k in range(3):  # each lacks about a sixth of the words
                variants.append([w for i, w in enumerate(found) if zlib.crc32(f"{text}{i}{k}".encode()) % 6])
            out += [(ngrams(v), family, no) for v in variants if v]
            no += 1
    # fragments of single common words belong to nothing
    names = {"affero", "agpl", "apache", "boost", "bsd", "bsl", "cc", "cc0", "eclipse", "epl", "gpl", "isc", "lgpl", "mit", "mozilla", "mpl",
        "unlicense", "zlib"}
    common = sorted({w for texts in TEMPLATES.values() for t in texts for w in words(t)} - names)
    return out + [(ngrams([w]), NONE, no + i) for i, w in enumerate(common)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Examples:
    """The examples as the nonzeros of a 0/1 matrix, their classes and the texts they were made of."""

    def __init__(self):
        data = examples()
        self.classes = tuple(sorted({c for _, c, _ in data}))
        self.vocabulary = tuple(sorted({g for found, _, _ in data for g in found}))
        index = {g: i for i, g in enumerate(self.vocabulary)}
        rows = [sorted(index[g] for g in found) for found, _, _ in data]
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.array([i for r in rows for i in r])
        self.y = np.eye(len(self.classes))[[self.classes.index(c) for _, c, _ in data]]
        self.text = np.array([no for _, _, no in data])

    def logits(self, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        return b + np.stack([np.bincount(self.row, v, len(self.y)) for v in w[self.col].T], axis=1)

    def fit(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights (n-gram by class) and biases from the examples used, by accelerated gradient descent."""
        w, b = np.zeros((len(self.vocabulary), len(self.classes))), np.zeros(len(self.classes))
        b[self.classes.index(NONE)] = 1.0
        last_w, last_b = w, b
        for step in range(1, STEPS + 1):
            momentum = (step - 1) / (step + 2)
            ahead_w, ahead_b = w + momentum * (w - last_w), b + momentum * (b - last_b)
            error = (_softmax(self.logits(ahead_w, ahead_b)) - self.y) * used[:, None] / used.sum()
            slope = np.stack([np.bincount(self.col, e, len(w)) for e in error[self.row].T], axis=1)
            last_w, last_b = w, b
            w, b = ahead_w - 1.0 * (slope + 1e-4 * ahead_w), ahead_b - 0.1 * error.sum(axis=0)
        return w, b


def cross_fitted() -> tuple[Examples, np.ndarray, float]:
    """The examples, each one's logits by a model that saw nothing of its text, and the temperature that suits them."""
    data = Examples()
    z = np.zeros_like(data.y)
    for part in range(PARTS):
        out = data.text % PARTS == part
        z[out] = data.logits(*data.fit(~out))[out]
    loss = {t: -np.log((_softmax(z / t) * data.y).sum(axis=1) + 1e-12).mean() for t in np.arange(0.2, 4.01, 0.1)}
    return data, z, float(min(loss, key=loss.get))


@cache
def model() -> tuple[tuple[str, ...], tuple[str, ...], np.ndarray, np.ndarray]:
    """Classes, n-grams, weights (n-gram by class) and biases, divided by the calibrated temperature."""
    data, _, temperature = cross_fitted()
    w, b = data.fit(np.ones(len(data.y), bool))
    return data.classes, data.vocabulary, np.round(w / temperature, 4), np.round(b / temperature, 4)


@cache
def table_json() -> tuple[str, str]:
    """Buckets of (hash, number) of the n-grams, and the weights by number from 0."""
    _, vocabulary, weights, _ = model()
    buckets: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for i, g in enumerate(vocabulary):
        h = gram_hash(g)
        buckets[h % BUCKETS].append({"k": h, "i": i})
    return json.dumps(buckets, separators=(",", ":")), json.dumps(weights.tolist(), separators=(",", ":"))


#: A line end after a mark that ends a sentence, a clause or a bracketed address.
SENTENCE_END = r"(?<=[.:;!?>])[ \t\r]*\n"


def paragraphs(text: Column) -> Column:
    blank = "\\n[ \\t\\r]*\\n"
    return F.when(text.rlike(blank), F.split(text, blank + "\\s*", -1)).otherwise(F.split(text, SENTENCE_END, -1))


def paragraph_words(paragraph: Column) -> Column:
    return F.filter(F.split(paragraph, "[^a-z0-9]+", -1), lambda w: w != "")


def pairs(found: Column) -> Column:
    """Words side by side; fewer than two words have none."""
    n = F.greatest(F.size(found) - 1, F.lit(0))
    return F.zip_with(F.slice(found, F.lit(1), n), F.slice(found, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs and ``found``: struct<at, family, probability, confirmed> of each licence paragraph."""
    classes, _, _, biases = model()
    literal = lambda xs: F.array(*(F.lit(x) for x in xs))
    # constants that the optimizer folds: arrays, read by place
    buckets, weights = (F.from_json(F.lit(x), kind) for x,
        kind in zip(table_json(), ("array<array<struct<k:bigint,i:int>>>", "array<array<double>>"), strict=True))
    templates = F.array(*(F
        .struct(F.lit(f).alias("family"), literal(sorted({f"{a} {b}" for a, b in zip(words(t), words(t)[1:], strict=False)})).alias("pairs")) for f,
            ts in TEMPLATES.items() for t in ts))
    none = classes.index(NONE)

    def known(h: Column) -> Column:  # the n-gram's number in an array, or none
        return F.filter(F.get(buckets, F.pmod(h, F.lit(BUCKETS)).cast("int")), lambda e: e["k"] == h)

    def judged(p: Column) -> Column:  # p: struct<at, words, pairs>
        hashes = F.transform(F.concat(p["words"], p["pairs"]), lambda g: F.xxhash64(g))
        numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(hashes, lambda h: F.transform(known(h), lambda e: e["i"])))))
        logits = F.aggregate(numbers, literal([float(v) for v in biases]), lambda acc, i: F.zip_with(acc, F.get(weights, i), lambda u, v: u + v))
        return F.element_at(F.transform(F.array(logits), lambda z: probability(p, z)), 1)

    def probability(p: Column, logits: Column) -> Column:
        best = F.array_max(F.zip_with(logits, F.sequence(F.lit(0), F.lit(len(classes) - 1)), lambda z, i: F.struct(z.alias("z"), i.alias("i"))))
        total = F.aggregate(logits, F.lit(0.0), lambda acc, z: acc + F.exp(z - best["z"]))
        return F.struct(p["at"].alias("at"), p["pairs"].alias("pairs"), best["i"].alias("i"), (1.0 / total).alias("probability"))

    def told(p: Column) -> Column:
        family = F.element_at(literal(classes), p["i"] + 1)
        own = F.array_distinct(p["pairs"])
        shared = lambda t: F.size(F.array_intersect(own, t["pairs"])) / F.greatest(F.lit(1), F.least(F.size(own), F.size(t["pairs"])))
        best = F.array_max(F.transform(F.filter(templates, lambda t: t["family"] == family), shared))
        return F.struct(p["at"].alias("at"), family.alias("family"), p["probability"].alias("probability"),
            (best >= LEAST_OVERLAP).alias("confirmed"))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select("doc_id", F.when(text == "", F.array().cast("array<string>")).otherwise(paragraphs(text)).alias("parts"))
    touched = F.transform("parts", lambda p, i: F.struct(i.alias("at"), paragraph_words(F.lower(p)).alias("words")))
    staged = split.select("doc_id", F.size("parts").cast("long").alias("n_paragraphs"), touched.alias("touched"))
    withpairs = F.transform("touched", lambda p: F.struct(p["at"].alias("at"), p["words"].alias("words"), pairs(p["words"]).alias("pairs")))
    scored = staged.select("doc_id", "n_paragraphs", F.transform(withpairs, judged).alias("scored"))
    sure = F.filter("scored", lambda p: (p["i"] != none) & (p["probability"] >= LEAST_PROBABILITY))
    return scored.select("doc_id", "n_paragraphs", F.transform(sure, told).alias("found"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_licences (confirmed), families, unconfirmed and the paragraphs' numbers."""
    found = scan(docs)
    confirmed = F.filter("found", lambda p: p["confirmed"])
    names = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda p: p["family"]))), ",")
    return found.select(
        "doc_id", "n_paragraphs", F.size(confirmed).cast("long").alias("n_licences"), names(confirmed).alias("families"),
        (F.size("found") - F.size(confirmed)).cast("long").alias("n_unconfirmed"),
        F.array_join(F.transform(confirmed, lambda p: F.concat_ws(":", p["family"], p["at"])), ",").alias("paragraphs"),
    )
