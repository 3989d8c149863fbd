"""Licence scans: a trained paragraph classifier whose findings templates confirm.

A paragraph is what stands between blank lines.  It is read line by line and
in overlapping windows of several widths, so a notice is found where lines
wrap it and where prose surrounds it.  Features are hashed word unigrams and
bigrams.  A multinomial logistic regression over licence families and an
unknown class is fitted on variations and windows of the templates against
units of the corpus; a temperature calibrates its probabilities on notices
whose template was held out and on units that were kept back.  A finding
stands if its probability is high enough and its words overlap a template of
its family; of findings that share words the one with most of a template wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buffers as B

U64 = np.uint64
BUCKETS = 1 << 14
#: Lines are read in windows of so many words, half of one apart; paragraphs in all of these widths.
WINDOW_WORDS = 64
WIDTHS = (8, 16, 32, 64)
#: Documents of the corpus whose units teach the unknown class, about so many; chosen by hash of the id.
LEARN_DOCS = 400
#: Units of these documents that are learned from, at most; chosen by hash of id and place.
LEARN_UNITS = 2500
PROBABILITY = 0.5
#: Shared bigrams over the smaller side's that confirm a finding, if there are so many, or if they are half of what was read.
OVERLAP, LEAST_SHARED = 0.6, 4
UNKNOWN = "unknown"

#: Notices and opening sentences of public licences: fixed values.
NOTICES: dict[str, list[str]] = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "This project is distributed under the terms of the MIT license.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2.",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You can redistribute it under the terms of the GNU Lesser General Public License, version 2.1 or later.",
        "This library is licensed under the GNU Lesser General Public License.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights; this work is dedicated to the public domain under CC0."],
    "CC-BY-ND": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND": ["This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    ],
    "CDDL-1.0": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ],
    "WTFPL": ["This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar."],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"],
    "Artistic-2.0": ["This library is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: http://scripts.sil.org/OFL"],
    "EUPL-1.2": ["Licensed under the EUPL, Version 1.2 or, as soon they will be approved by the European Commission, subsequent versions of the EUPL (the Licence); you may not use this work except in compliance with the Licence."],
    "GFDL": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."],
    "MS-PL": ["This software is licensed under the Microsoft Public License. If you use the software, you accept this license. If you do not accept the license, do not use the software."],
    "PSF-2.0": ["This package is distributed under the Python Software Foundation License Version 2."],
    "ODbL": ["This database is made available under the Open Database License: http://opendatacommons.org/licenses/odbl/1.0/. Any rights in individual contents of the database are licensed under the Database Contents License"],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without permission."],
}
#: How licences are called in prose, and phrases that name them: fixed values.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 license"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD license"],
    "ISC": ["ISC License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPLv3"],
    "LGPL": ["GNU Lesser General Public License", "LGPL"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0"],
    "CC-BY": ["CC BY 4.0"],
    "CC-BY-SA": ["CC BY-SA 4.0"],
    "CC-BY-NC": ["CC BY-NC 4.0"],
    "CC0": ["CC0 1.0"],
    "CC-BY-ND": ["CC BY-ND 4.0"],
    "CC-BY-NC-SA": ["CC BY-NC-SA 4.0"],
    "CC-BY-NC-ND": ["CC BY-NC-ND 4.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0"],
    "CDDL-1.0": ["Common Development and Distribution License"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License 1.0"],
    "WTFPL": ["WTFPL"],
    "0BSD": ["Zero-Clause BSD license"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "OFL-1.1": ["SIL Open Font License 1.1"],
    "EUPL-1.2": ["European Union Public Licence 1.2"],
    "GFDL": ["GNU Free Documentation License"],
    "MS-PL": ["Microsoft Public License"],
    "PSF-2.0": ["Python Software Foundation License"],
    "ODbL": ["Open Database License"],
}
#: How licences are called where several are offered: fixed values.
SHORT: dict[str, str] = {
    "MIT": "MIT", "Apache-2.0": "Apache 2.0|Apache License 2.0|Apache License, Version 2.0|Apache", "BSD": "BSD|BSD 3-Clause", "GPL-2.0": "GPLv2|GPL v2|GPL 2|GPL-2.0", "GPL-3.0": "GPLv3|GPL v3|GPL 3|GPL-3.0", "LGPL": "LGPL|LGPL 2.1",
    "MPL-2.0": "MPL 2.0|MPL", "EPL-2.0": "EPL 2.0|EPL", "Unlicense": "Unlicense", "Zlib": "zlib", "BSL-1.0": "Boost", "ISC": "ISC", "Artistic-2.0": "Artistic", "CDDL-1.0": "CDDL", "CC0": "CC0", "WTFPL": "WTFPL",
}
#: Ways to offer several licences, learned as a class of their own; its findings are told by the names in them.
CHOICE = "choice"
CHOICES = ["Dual licensed under {} or {} at your option.", "Licensed under either of {} or {} at your option.", "This project is dual-licensed under {} and {}.", "available under your choice of the {} license or the {} license", "tri-licensed under {}, {}"]
#: Words that deny what follows within so many words: fixed values.
DENIALS, DENIAL_WORDS = "not never neither nor isn aren cannot without".split(), 5
PHRASES = ["Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "distributed under the terms of the {}", "available under the {}"]
#: The first templates of a family are those that name it.
TEMPLATES = {f: [p.format(n) for n in NAMES.get(f, []) for p in PHRASES] + own for f, own in NOTICES.items()}
_OFFERED = [n.split("|")[0] for n in SHORT.values()]
TEMPLATES[CHOICE] = [p.format(a, _OFFERED[(k + step) % len(_OFFERED)]) for step, p in enumerate(CHOICES, 1) for k, a in enumerate(_OFFERED)]


def paragraphs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; first and last word of each unit in their order, its row, and the number of its paragraph in the row."""
    low = B.LOWER[buf]
    starts, ends = B.runs(low, offs, B.ALNUM)
    words = B.RunHash(low)(starts, ends)
    first = B.counts_in(starts, offs)
    none = np.zeros(0, dtype=np.int64)
    if not len(words):
        return words, none, none, none, none
    lines = np.concatenate(([0], np.cumsum(low == 10)))
    row = B.owners(first)
    gap = np.zeros(len(words), dtype=np.int64)  # line ends before each word
    gap[1:] = lines[starts[1:]] - lines[ends[:-1]]
    gap[np.concatenate(([True], row[1:] != row[:-1]))] = 2
    whole = np.flatnonzero(gap >= 2)
    at, to = _windows(np.flatnonzero(gap >= 1), len(words), WINDOW_WORDS, 1)
    for width in WIDTHS:
        a, b = _windows(whole, len(words), width, width // 2)
        at, to = np.concatenate((at, a)), np.concatenate((to, b))
    at, to = np.divmod(np.unique(at * (len(words) + 1) + to), len(words) + 1)
    own = row[at]
    nth = np.searchsorted(whole, at, side="right") - 1
    return words, at, to, own, nth - np.searchsorted(whole, first[own], side="left")


def _windows(begin: np.ndarray, n: int, width: int, more: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of runs of words that begin at ``begin`` and hold ``more`` words or more, half a width apart."""
    end = np.concatenate((begin[1:], [n]))
    begin, end = begin[end - begin >= more], end[end - begin >= more]
    step = width // 2
    count = np.maximum(1, -(-(end - begin - width) // step) + 1)
    at = np.repeat(begin, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * step
    return at, np.minimum(at + width, np.repeat(end, count))


def _buckets(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of the bigram that ends at it."""
    with np.errstate(over="ignore"):
        pair = np.zeros(len(words), dtype=U64)
        pair[1:] = B.mix(words[1:] + words[:-1] * U64(0x9E3779B97F4A7C15))
    return (words >> U64(50)).astype(np.int64), (pair >> U64(50)).astype(np.int64)


def _bigrams(words: np.ndarray) -> set[int]:
    """Bigrams of a unit with its edges, for comparison with templates."""
    edge = np.concatenate(([U64(1)], words, [U64(2)]))
    with np.errstate(over="ignore"):
        return set(B.mix(edge[1:] + edge[:-1] * U64(0x9E3779B97F4A7C15)).tolist())


def _words_of(text: str) -> np.ndarray:
    return paragraphs(*B.text_arrays(pa.array([text], type=pa.large_string())))[0]


@dataclass
class Model:
    families: list[str]  # the last is the unknown class
    weights: np.ndarray  # buckets + bias x families
    temperature: float
    templates: list[list[set[int]]]

    def logits(self, words: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Units, ordered by their first word, x families; some thousand units at a time."""
        out = np.empty((len(at), len(self.families)))
        for k in range(0, len(at), 1 << 14):
            a, b = at[k : k + (1 << 14)], to[k : k + (1 << 14)]
            lo, hi = int(a.min()), int(b.max())
            one, two = _buckets(words[lo:hi])
            sums = np.zeros((2, hi - lo + 1, len(self.families)))
            np.cumsum(self.weights[one], axis=0, out=sums[0, 1:])
            np.cumsum(self.weights[two], axis=0, out=sums[1, 1:])
            a, b = a - lo, b - lo
            total = sums[0, b] - sums[0, a] + sums[1, b] - sums[1, np.minimum(a + 1, b)]
            out[k : k + len(a)] = total / np.sqrt(2.0 * (b - a) - 1)[:, None] + self.weights[-1]
        return out

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def overlap(self, family: int, words: np.ndarray) -> tuple[float, int]:
        """The largest share of bigrams that a template has in common with the words, and how many those are.

        A template of few words says nothing within many others: unless it has
        some bigrams in common, these must be half of the words' own.
        """
        own = _bigrams(words)
        return max(((common / min(len(own), len(t)), common) for t in self.templates[family] for common in [len(own & t)] if common >= LEAST_SHARED or 2 * common >= len(own)), default=(0.0, 0))

    def denied(self, family: int, own: np.ndarray) -> bool:
        """Whether a word of denial, itself in no template of the family, stands shortly before what a template has."""
        no = np.flatnonzero(np.isin(own, _denials()))
        if not len(no):
            return False
        with np.errstate(over="ignore"):
            pairs = B.mix(own[1:] + own[:-1] * U64(0x9E3779B97F4A7C15))
        every = set().union(*self.templates[family])
        known = np.array([int(p) in every for p in pairs], dtype=bool)
        for i in no.tolist():
            apart = not (i < len(known) and known[i]) and not (i > 0 and known[i - 1])
            if apart and known[i + 1 : i + 1 + DENIAL_WORDS].any():
                return True
        return False

    def offered(self, words: np.ndarray) -> list[int]:
        """Families whose short names stand among the words."""
        out = []
        for family, names in _offers(self.families):
            if any(len(n) <= len(words) and (np.lib.stride_tricks.sliding_window_view(words, len(n)) == n).all(axis=1).any() for n in names):
                out.append(family)
        return out


@lru_cache
def _denials() -> np.ndarray:
    return _words_of(" ".join(DENIALS))


def _offers(families: list[str]) -> list[tuple[int, list[np.ndarray]]]:
    known = _offered_names()
    return [(k, known[f]) for k, f in enumerate(families) if f in known]


@lru_cache
def _offered_names() -> dict[str, list[np.ndarray]]:
    return {f: [_words_of(n) for n in names.split("|")] for f, names in SHORT.items()}


def _features(units: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit, bucket and value of each n-gram."""
    rows, cols, values = [], [], []
    for i, words in enumerate(units):
        one, two = _buckets(words)
        grams = np.concatenate((one, two[1:]))
        rows.append(np.full(len(grams), i))
        cols.append(grams)
        values.append(np.full(len(grams), 1 / np.sqrt(len(grams))))
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


def _train(units: list[np.ndarray], label: np.ndarray, classes: int, steps: int = 60) -> np.ndarray:
    rows, cols, values = _features(units)
    y = np.eye(classes)[label]
    share = np.sqrt(len(label) / np.maximum(np.bincount(label, minlength=classes), 1))[label]
    share /= share.mean()
    used, where = np.unique(cols, return_inverse=True)
    w, bias, pace, speed = np.zeros((len(used), classes)), np.zeros(classes), np.zeros((len(used), classes)), 3.0
    order = np.argsort(where, kind="stable")
    bounds = np.searchsorted(where[order], np.arange(len(used)))
    starts = np.searchsorted(rows, np.arange(len(units)))
    for _ in range(steps):
        z = np.add.reduceat(values[:, None] * w[where], starts, axis=0) + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - y) * share[:, None]
        grad = np.add.reduceat((values[:, None] * error[rows])[order], bounds, axis=0) + 0.01 * w
        pace += grad**2
        w -= speed * grad / (np.sqrt(pace) + 1e-6)
        bias -= 0.5 * error.mean(axis=0)
    out = np.zeros((BUCKETS + 1, classes), dtype=np.float32)
    out[used], out[-1] = w, bias
    return out


def _teaching(group: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """What a family's templates teach: each with variations, inside foreign words, and its own windows."""
    out = []
    for k, words in enumerate(group):
        out += variations(words, seed + k)
        around = B.stream(seed + 50 + k, 2 * WINDOW_WORDS)
        out += [np.concatenate((around[:n], words, around[n : 2 * n])) for n in (4, 12) if len(words) + 2 * n <= WINDOW_WORDS]
        for width in WIDTHS:
            at, to = _windows(np.zeros(1, dtype=np.int64), len(words), width, width + 1)
            out += [words[a:b] for a, b in zip(at.tolist(), to.tolist())]
    return out


def variations(words: np.ndarray, seed: int, n: int = 8) -> list[np.ndarray]:
    """A notice as it stands, and with words left out and foreign words around it, by fixed draws."""
    draws = B.stream(seed, n * (len(words) + 8))
    out = [words]
    for k in range(1, n):
        own = draws[k * (len(words) + 8) : (k + 1) * (len(words) + 8)]
        kept = words[(own[: len(words)] % U64(100)) >= U64(4 * (k % 3))]
        around = own[len(words) :]
        out.append(np.concatenate((around[: k % 4], kept, around[4 : 4 + (k // 4) % 3])))
    return [x for x in out if len(x)]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The units of each text, with their place."""
    for batch in batches:
        for a, b, buf, offs in B.pieces(batch.column(1), 1 << 19):
            words, at, to, row, _ = paragraphs(buf, offs)
            ids = batch.column(0).slice(a, b - a).take(pa.array(row))
            cells = [words[x:y].view(np.int64) for x, y in zip(at.tolist(), to.tolist())]
            yield pa.RecordBatch.from_arrays([ids, pa.array(at - at[np.searchsorted(row, row, "left")]), pa.array(cells, type=pa.list_(pa.int64()))], names=["id", "place", "words"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn_docs: int = LEARN_DOCS, learn_units: int = LEARN_UNITS) -> Model:
    """Fits the classifier.

    At most ``learn_units`` units of about ``learn_docs`` documents reach the
    driver, as hashes of words; which ones depends on ids, places and words
    alone, whatever the layout of the table.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    total = max(1, rows.count())
    least = int((1 << 30) * min(1.0, learn_docs / total))
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit("licence")), F.lit(1 << 30)) < least)
    units = sample.mapInArrow(_units, f"id {rows.schema['id'].dataType.simpleString()}, place long, words array<long>")
    taken = units.select(F.xxhash64("id", "place", "words").alias("h"), "words").orderBy("h", "words").limit(learn_units).select("words").collect()

    families = [*TEMPLATES, UNKNOWN]
    none = len(families) - 1
    notices = [[_words_of(t) for t in group] for group in TEMPLATES.values()]
    model = Model(families, np.zeros((BUCKETS + 1, len(families)), np.float32), 1.0, [[_bigrams(w) for w in group] for group in notices])
    other = [np.array(r[0], dtype=np.int64).view(U64) for r in taken]
    # units of the sample that are notices themselves teach nothing about the unknown class
    known = set().union(*(t for group in model.templates for t in group))
    other = [w for w in other if len(_bigrams(w) & known) < 0.3 * (len(w) + 1)]
    if not other:
        other = [B.stream(9000 + k, 12) for k in range(50)]

    def learn(groups: list[list[np.ndarray]], rest: list[np.ndarray]) -> np.ndarray:
        made = [_teaching(group, 100 * f) for f, group in enumerate(groups)]
        label = np.concatenate([np.full(len(m), f) for f, m in enumerate(made)] + [np.full(len(rest), none)])
        return _train([u for m in made for u in m] + rest, label, len(families))

    # notices of every third template, and every third unit, are asked of a model that never saw them
    model.weights = learn([[w for k, w in enumerate(g) if k % 3 != 1 or len(g) == 1] for g in notices], [w for k, w in enumerate(other) if k % 3 != 1])
    held = [(f, u) for f, g in enumerate(notices) for k, w in enumerate(g) if k % 3 == 1 for u in (w[: WINDOW_WORDS], *variations(w, 7000 + 10 * f + k, 3)[1:])]
    held += [(none, w) for k, w in enumerate(other) if k % 3 == 1]
    bounds = np.concatenate(([0], np.cumsum([len(u) for _, u in held])))
    logits, label = model.logits(np.concatenate([u for _, u in held]), bounds[:-1], bounds[1:]), np.array([f for f, _ in held])

    def loss(t: float) -> float:
        z = logits / t
        return float((np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) + z.max(axis=1) - z[np.arange(len(z)), label]).mean())

    model.temperature = min((0.25 * 1.25**k for k in range(20)), key=loss)
    model.weights = learn(notices, other)
    return model


_FINDING = [("family", pa.string()), ("paragraph", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64()), ("overlap", pa.float64()), ("confirmed", pa.bool_())]


def _scanner(shared):
    kind = pa.list_(pa.struct(_FINDING))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        none = len(model.families) - 1
        for batch in batches:
            for a, b, buf, offs in B.pieces(batch.column(1), 1 << 19):
                words, at, to, row, nth = paragraphs(buf, offs)
                found: list[list[dict]] = [[] for _ in range(b - a)]
                n = np.zeros(b - a, dtype=np.int64)
                if len(at):
                    np.maximum.at(n, row, nth + 1)
                    begin = np.searchsorted(row, np.arange(b - a), "left")
                    p = model.probabilities(model.logits(words, at, to))
                    best = p.argmax(axis=1)
                    likely = []
                    for u in np.flatnonzero((best != none) & (p.max(axis=1) >= PROBABILITY)).tolist():
                        near, common = model.overlap(int(best[u]), words[at[u] : to[u]])
                        sure = near >= OVERLAP
                        if model.families[best[u]] == CHOICE:
                            sure = common >= LEAST_SHARED and len(model.offered(words[at[u] : to[u]])) > 1
                        # the words before a unit, of the same text, may deny it
                        sure = sure and not model.denied(int(best[u]), words[max(int(at[u]) - DENIAL_WORDS, int(at[begin[row[u]]])) : to[u]])
                        likely.append((not sure, -common, -float(p[u, best[u]]), u, near))
                    taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
                    for weak, _, minus, u, near in sorted(likely):
                        own = taken.setdefault((int(row[u]), int(nth[u])), [])
                        if all(to[u] <= x or y <= at[u] for x, y in own):
                            own.append((at[u], to[u]))
                            base = at[begin[row[u]]]
                            names = [model.families[best[u]]]
                            if names == [CHOICE]:  # several licences, each found by its name
                                names = [model.families[f] for f in model.offered(words[at[u] : to[u]])]
                            for name in names:
                                found[row[u]].append({"family": name, "paragraph": int(nth[u]), "start": int(at[u] - base), "end": int(to[u] - base), "probability": -minus, "overlap": near, "confirmed": not weak})
                for own in found:
                    own.sort(key=lambda x: x["start"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(found, type=kind)], names=["doc_id", "n_paragraphs", "findings"])

    return scan


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_paragraphs, findings`` for every row.

    A finding has the family, the paragraph's number, its first and last word
    in the text (end excluded), the probability, the overlap with the family's
    nearest template and whether that confirms it; findings of a paragraph
    share no word, but for licences that are offered together.  What is denied
    ("not licensed under") is not confirmed.  Of findings that would share one, a confirmed one wins,
    then that with most in common with its template, then the likelier, then
    the earlier.  Null and wordless texts have no paragraphs; rows that repeat
    are answered one by one; an empty table gives an empty one and further
    columns are left.  A very long text is read whole, its units some thousand
    at a time.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x families numbers
    found = "array<struct<family:string,paragraph:int,start:long,end:long,probability:double,overlap:double,confirmed:boolean>>"
    return narrow.mapInArrow(_scanner(shared), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_paragraphs long, findings {found}")


def report(found: DataFrame) -> DataFrame:
    """Families that a template confirms, and the surest finding of any kind, per document."""
    sure = F.filter("findings", lambda x: x["confirmed"])
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("findings").cast("long").alias("n_findings"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("licences"),
        F.coalesce(F.array_max(F.transform("findings", lambda x: x["probability"])), F.lit(0.0)).alias("probability"),
    )
