"""License scans: a trained paragraph classifier, confirmed against templates.

A paragraph is a run of lines with words. Single lines of it, and windows of adjacent lines for notices that
are wrapped, are scored by a multinomial logistic regression over word unigrams and bigrams, with a class for each licence
family and one for ordinary text. It is trained on the templates below, with words lost and other text
around them, and on ordinary paragraphs of the corpus, some with everyday words of the templates strewn in. A family counts if its probability is above a bound
calibrated on noisy templates that were kept out, and if the words of one of its templates stand there in
order, eight tenths of their weight at least; words that few families use weigh most. Lines surer to be about a
licence than all ordinary ones kept out, with two telling words or one about licences, but without a confirmed family, are of an
unknown licence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semql.llm.common import batch_of, table, text_slices

#: Families, and the paragraphs of their usual notices and texts.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Released under the Apache 2.0 license.",
        "Apache License Version 2.0, January 2004",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see",
        "Released under the GPL, version 3 or later.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
        "Released under the LGPL.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see",
        "Released under the AGPL.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Licensed under the 3-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
        "Licensed under the Eclipse Public License, Version 2.0.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Released under the zlib License.",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "public domain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright under CC0 1.0.",
        "Released under CC0 1.0.",
    ],
}
#: Identifiers that follow "SPDX-License-Identifier:".
SPDX = {
    "MIT": ["MIT"],
    "Apache-2.0": ["Apache-2.0"],
    "GPL": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0", "GPL-3.0"],
    "LGPL": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-2.1", "LGPL-3.0"],
    "AGPL": ["AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL-3.0"],
    "BSD": ["BSD-2-Clause", "BSD-3-Clause"],
    "MPL-2.0": ["MPL-2.0"],
    "EPL": ["EPL-1.0", "EPL-2.0"],
    "ISC": ["ISC"],
    "zlib": ["Zlib"],
    "BSL-1.0": ["BSL-1.0"],
    "CC-BY": ["CC-BY-4.0"],
    "CC-BY-SA": ["CC-BY-SA-4.0"],
    "CC-BY-NC": ["CC-BY-NC-4.0"],
    "CC-BY-ND": ["CC-BY-ND-4.0"],
    "public domain": ["CC0-1.0", "Unlicense"],
}
NONE, UNKNOWN = "none", "unknown"
#: Share of a template's weight that must stand in a paragraph, in order.
LIKE = 0.8
#: With less of a chance to be about a licence, words aren't compared with templates; windows begin at most two lines before a line with more.
DOUBT = 0.2
#: Ordinary paragraphs that the model is trained on, at most; the documents that they come from; and their code points.
MAX_PARAGRAPHS, MAX_DOCUMENTS, MAX_CHARS = 3_000, 400, 10_000
_WORDS = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*|[^\W\d_]+").findall
#: Lines that speak of licences aren't taken for ordinary text.
_ABOUT = "(?i)licen[cs]|copyright|warrant|public domain|creative commons|redistribut|permission"
_SPEAKS = re.compile(_ABOUT).match


def words_of(paragraph: str) -> list[str]:
    return _WORDS(paragraph.lower())


def _grams(words: list[str]) -> list[str]:
    return [*words, *map(" ".join, zip(words, words[1:]))]


def _all_templates() -> dict[str, list[list[str]]]:
    """The words of all templates by family, identifier lines among them."""
    return {f: [words_of(t) for t in [*TEMPLATES[f], *(f"SPDX-License-Identifier: {i}" for i in SPDX[f])]] for f in TEMPLATES}


_TEMPLATES = _all_templates()
_FAMILIES = {w: sum(any(w in t for t in ts) for ts in _TEMPLATES.values()) for ts in _TEMPLATES.values() for t in ts for w in t}
#: The words of a window, at most: the longest template's and a quarter more.
_WINDOW = max(len(t) for ts in _TEMPLATES.values() for t in ts) * 5 // 4


def _weights(template: list[str]) -> np.ndarray:
    """Words weigh more the fewer families use them; numbers, which are versions mostly, weigh least."""
    return np.asarray([math.log(2) if w[0].isdigit() else math.log(1 + len(_TEMPLATES) / _FAMILIES.get(w, 1)) for w in template])


_WEIGHED = [(f, t, _weights(t)) for f, ts in _TEMPLATES.items() for t in ts]


@dataclass
class Model:
    classes: list[str]  # the last is ordinary text
    vocabulary: dict[str, int]
    weights: np.ndarray  # n-grams by classes, the bias last
    words: frozenset  # without any of these a paragraph is ordinary text
    bound: float = 0.5  # of a family
    floor: float = 0.5  # of all families together

    def probabilities(self, words: list[str]) -> np.ndarray:
        at = sorted({self.vocabulary[g] for g in _grams(words) if g in self.vocabulary})
        logits = self.weights[at].sum(axis=0) / max(1.0, len(at)) ** 0.5 + self.weights[-1]
        e = np.exp(logits - logits.max())
        return e / e.sum()


def in_order(template: list[str], words: list[str], weights: np.ndarray | None = None) -> float:
    """The share of the template's words, or of their weight, in the heaviest common subsequence with the paragraph's words."""
    weights = np.ones(len(template)) if weights is None else weights
    best = np.zeros(len(words) + 1)
    at: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        at.setdefault(w, []).append(i)
    for t, weight in zip(template, weights.tolist(), strict=True):
        if places := at.get(t):
            longer = best.copy()
            longer[np.asarray(places) + 1] = best[places] + weight
            best = np.maximum.accumulate(np.maximum(best, longer))
    return float(best[-1] / weights.sum())


def likenesses(words: list[str]) -> dict[str, float]:
    """The share of its best template that stands in the words, for each family; zero where even out of order too little does."""
    held, out = set(words), dict.fromkeys(_TEMPLATES, 0.0)
    for family, template, weights in _WEIGHED:
        if sum(w for t, w in zip(template, weights.tolist(), strict=True) if t in held) >= LIKE * weights.sum() - 1e-9:
            out[family] = max(out[family], in_order(template, words, weights))
    return out


def _noisy(rng: np.random.Generator, words: list[str], others: list[list[str]]) -> list[str]:
    """A template with some words lost and other text around it."""
    kept = [w for w in words if rng.random() > 0.08] or words
    around = others[int(rng.integers(len(others)))] if others and rng.random() < 0.5 else []
    cut = int(rng.integers(len(around) + 1))
    return [*around[:cut][-8:], *kept, *around[cut:][:8]]


def train(ordinary: list[str], copies: int = 24, steps: int = 150, seed: int = 7) -> Model:
    """The model from ``TEMPLATES`` and ordinary paragraphs."""
    rng, classes = np.random.default_rng(seed), [*TEMPLATES, NONE]
    plain = [w for w in map(words_of, ordinary) if w] or [["text"]]
    made = [(i, _noisy(rng, t, plain)) for i, family in enumerate(_TEMPLATES) for t in _TEMPLATES[family] for _ in range(copies)]
    # Ordinary text too uses what most families do, in any order, but for the words about licences.
    everyday = sorted(w for w, n in _FAMILIES.items() if 4 * n >= len(_TEMPLATES) and not w[0].isdigit() and not re.search(_ABOUT, w))
    mixed = [[*w, *rng.choice(everyday, int(rng.integers(3, 16)))] for w in [*plain[::3], *[[]] * 300]]
    made += [(len(TEMPLATES), [str(x) for x in w]) for w in [*plain, *mixed]]
    known = sorted({g for family in _TEMPLATES.values() for t in family for g in _grams(t)})
    vocabulary = {g: i for i, g in enumerate(known)}
    x, y = np.zeros((len(made), len(known) + 1), np.float32), np.zeros((len(made), len(classes)), np.float32)
    for row, (label, words) in enumerate(made):
        at = sorted({vocabulary[g] for g in _grams(words) if g in vocabulary})
        x[row, at] = 1 / max(1.0, len(at)) ** 0.5
        y[row, label] = 1
    x[:, -1] = 1
    apart = rng.random(len(made)) < 0.2
    # Templates and ordinary text weigh the same in all.
    weight = np.where(y[:, -1] > 0, 0.5 / max(1, y[:, -1].sum()), 0.5 / max(1, (1 - y[:, -1]).sum())).astype(np.float32)[:, None]
    w, speed = np.zeros((len(known) + 1, len(classes)), np.float32), np.zeros((len(known) + 1, len(classes)), np.float32)
    fit = ~apart
    for _ in range(steps):
        z = x[fit] @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed + x[fit].T @ ((p - y[fit]) * weight[fit]) + 1e-6 * w
        w -= 8.0 * speed
    model = Model(classes, vocabulary, w, frozenset(g for g in known if " " not in g and len(g) > 2 and g not in everyday and w[vocabulary[g], :-1].max() > w[vocabulary[g], -1]))
    sure = [p[label] for (label, words), a in zip(made, apart, strict=True) if a and label < len(TEMPLATES) and (p := model.probabilities(words)).argmax() == label]
    model.bound = float(np.clip(np.quantile(sure, 0.02), 0.2, 0.9)) if sure else 0.5
    plain_sure = [1 - float(model.probabilities(words)[-1]) for (label, words), a in zip(made, apart, strict=True) if a and label == len(TEMPLATES)]
    model.floor = float(np.clip(max(plain_sure, default=0.5) * 1.05, 0.5, 0.97))
    return model


def classify(model: Model, words: list[str]) -> tuple[str, float, float]:
    """Family (or ``none`` or ``unknown``), its probability, and how much of its best template is there."""
    if not model.words.intersection(words):
        return NONE, 1.0, 0.0
    p = model.probabilities(words)
    if 1 - p[-1] < DOUBT:
        return NONE, float(p[-1]), 0.0
    like = likenesses(words)
    best = model.classes[int(p[:-1].argmax())]
    if p[:-1].sum() >= model.floor and p.max() >= model.bound and like[best] >= LIKE:
        return best, float(p[:-1].max()), like[best]
    # Short notices differ in a word; where the model isn't sure, a whole template decides.
    whole = max(like, key=lambda f: (like[f], p[model.classes.index(f)]))
    if like[whole] > 1 - 1e-9:
        return whole, float(p[model.classes.index(whole)]), 1.0
    if p[:-1].sum() < model.floor or not (len(model.words.intersection(words)) > 1 or any(map(_SPEAKS, words))):
        return NONE, float(p[-1]), max(like.values())
    return UNKNOWN, float(1 - p[-1]), max(like.values())


def notices(model: Model, lines: list[list[str]]) -> list[tuple[int, int, str, float, float]]:
    """Of a paragraph, given as the words of its lines: first line, line after the last, family, probability and likeness of each notice.

    A notice is a line with a family, else a window of adjacent lines without one that has, the best confirmed and then
    the shortest from its first line on, else lines next to each other that are, alone or with the next, of an unknown licence.
    """
    alone = [classify(model, w) for w in lines]
    doubtful = [family == UNKNOWN or p <= 1 - DOUBT for family, p, _ in alone]
    free = [family in (NONE, UNKNOWN) for family, *_ in alone]
    out = [(i, i + 1, *alone[i]) for i, f in enumerate(free) if not f]
    i = 0
    while i < len(lines):
        best, words = None, list(lines[i]) if free[i] else []
        for j in range(i + 1, len(lines)) if free[i] and any(doubtful[i : i + 3]) else ():
            words += lines[j]
            if not free[j] or len(words) > _WINDOW + len(lines[i]):
                break
            family, p, like = classify(model, words)
            if family not in (NONE, UNKNOWN) and (best is None or like > best[4]):
                best = (i, j + 1, family, p, like)
        if best:
            out.append(best)
            free[i : best[1]] = [False] * (best[1] - i)
        i = best[1] if best else i + 1
    unknown = [f and a[0] == UNKNOWN for f, a in zip(free, alone, strict=True)]
    sure = [a[1] if u else 0.0 for u, a in zip(unknown, alone, strict=True)]
    for i in range(len(lines) - 1):
        if free[i] and free[i + 1] and (doubtful[i] or doubtful[i + 1]) and not (unknown[i] and unknown[i + 1]) and (found := classify(model, lines[i] + lines[i + 1]))[0] == UNKNOWN:
            unknown[i] = unknown[i + 1] = True
            sure[i], sure[i + 1] = max(sure[i], found[1]), max(sure[i + 1], found[1])
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and unknown[j]:
            j += 1
        if j > i:
            out.append((i, j, UNKNOWN, max(sure[i:j]), max(a[2] for a in alone[i:j])))
        i = max(j, i + 1)
    return sorted(out)


def paragraphs(text: str) -> Iterator[tuple[list[tuple[int, int]], list[list[str]]]]:
    """Spans and words of the lines of each run of lines with words."""
    at, spans, lines = 0, [], []
    for line in text.split("\n"):
        if words := words_of(line):
            spans.append((at, at + len(line))), lines.append(words)
        elif lines:
            yield spans, lines
            spans, lines = [], []
        at += len(line) + 1
    if lines:
        yield spans, lines


_FOUND = pa.struct([("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64()), ("begin", pa.int64()), ("end", pa.int64())])
_OUT = pa.schema([("n_paragraphs", pa.int64()), ("found", pa.list_(_FOUND))])


def scan(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without ``text_col``, with ``n_paragraphs`` and ``found``: family, probability, likeness
    to the template, and place in code points of the lines of each notice, in their order.

    Null and empty texts have no paragraphs; an empty table gives an empty table. Texts are read whole, however
    long. Of families alike in likeness the more probable is taken, of windows the shortest. Rows repeat as they do
    in the input; inputs named as an added column are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != text_col and c not in _OUT.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        tells = lambda words: not model.words.isdisjoint(words)
        for batch in text_slices(batches, "__text"):
            rows = []
            for text in batch.column("__text").to_pylist():
                found, n = [], 0
                for spans, lines in paragraphs(text or ""):
                    n += 1
                    if any(map(tells, lines)):
                        for i, j, family, p, like in notices(model, lines):
                            found.append({"family": family, "probability": p, "likeness": like, "begin": spans[i][0], "end": spans[j - 1][1]})
                rows.append((n, found))
            new = batch_of(_OUT, *zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *new.columns], names=[*kept, *_OUT.names])

    types = ["long", "array<struct<family:string,probability:double,likeness:double,begin:long,end:long>>"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), *(f"{n} {t}" for n, t in zip(_OUT.names, types, strict=True))])
    return docs.select(*kept, docs[text_col].alias("__text")).mapInArrow(run, schema)


def ordinary_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_documents: int = MAX_DOCUMENTS, max_paragraphs: int = MAX_PARAGRAPHS, max_chars: int = MAX_CHARS) -> list[str]:
    """Lines that don't speak of licences, of documents chosen by a hash of their ids: a sample that the three numbers
    bound. Lines are whole; those of more than ``max_chars`` code points aren't taken."""
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id")).orderBy(F.xxhash64(id_col), id_col).limit(max_documents)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(ids.distinct()), "__id")
    lines = rows.select(F.explode(F.split("__text", "\n", -1)).alias("line")).where((F.trim("line") != "") & ~F.col("line").rlike(_ABOUT))
    lines = lines.where(F.char_length("line") <= max_chars)
    return [r.line for r in lines.orderBy(F.xxhash64("line"), "line").limit(max_paragraphs).collect()]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(ordinary_paragraphs(docs)))
    families = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["family"])))
    spans = F.array_join(F.transform("found", lambda f: F.concat_ws(":", f["family"], f["begin"], f["end"])), ",")
    return found.select(
        "doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_licence"), F.array_join(families, ",").alias("families"), F.sha2(spans, 256).alias("spans_sha256")
    )
