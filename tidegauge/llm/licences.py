"""Licence scans of paragraphs.

A multinomial logistic regression over sparse word 1- to 3-grams (64-bit hashes; an L1 penalty leaves few weights) tells
licence families, licences of no known family and other text apart. It is trained on notices set amid ordinary
paragraphs of the corpus; its chances are calibrated on rows of notices that it has not seen. A prediction of a family
counts only if a template of that family confirms it: enough of the template's word pairs must be in the paragraph.
Licence-like paragraphs of no known family, or that no template confirms, are ``unknown``. Each line is judged, and so
are runs of lines of a paragraph where a template's pairs begin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, blocks, mix

# Customary notices of licence families.
NOTICES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license. See the LICENSE file for details.",
        "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "distributed under the terms of the Apache License",
        "Released under the Apache 2.0 license.",
        "Apache License Version 2.0, January 2004",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed to the Foundation under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Released under the GNU GPL version 2 or later.",
        "Licensed under the GPLv3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "You should have received a copy of the GNU General Public License along with this program. If not, see",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Released under the LGPL version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Released under the AGPLv3.",
        "You should have received a copy of the GNU Affero General Public License along with this program",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause license.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "distributed under a BSD-style license",
        "governed by a BSD-style license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
        "The contents of this file are subject to the Mozilla Public License Version 1.1",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
        "Licensed under the ISC license.",
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Content is available under the Creative Commons Attribution License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0",
        "This work is dedicated to the public domain under CC0 1.0.",
        "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Released under the Unlicense.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "Released under the zlib License.",
    ),
    "Boost": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
        "made available under the terms of the Eclipse Public License 2.0",
    ),
    "Proprietary": (
        "All rights reserved.",
        "No part of this publication may be reproduced or transmitted without the prior written permission of the publisher. All rights reserved.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ),
}
# Short names in identifier lines.
IDENTIFIERS: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT",), "Apache": ("Apache-2.0",), "GPL": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0", "GPL-3.0"), "LGPL": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "AGPL": ("AGPL-3.0-only", "AGPL-3.0-or-later"), "BSD": ("BSD-2-Clause", "BSD-3-Clause"), "MPL": ("MPL-2.0",), "ISC": ("ISC",), "CC-BY": ("CC-BY-4.0",), "CC-BY-SA": ("CC-BY-SA-4.0",), "CC-BY-NC": ("CC-BY-NC-4.0",),
    "CC0": ("CC0-1.0",), "Unlicense": ("Unlicense",), "Zlib": ("Zlib",), "Boost": ("BSL-1.0",), "EPL": ("EPL-1.0", "EPL-2.0"),
}
TEMPLATES: dict[str, tuple[str, ...]] = {f: (*own, *(f"SPDX-License-Identifier: {x}" for x in IDENTIFIERS.get(f, ()))) for f, own in NOTICES.items()}
# Notices of other licences, from which the regression learns what a licence of no known family looks like.
OTHERS: tuple[str, ...] = (
    "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "Licensed under the European Union Public Licence, version 1.2 or later.",
    "This font software is licensed under the SIL Open Font License, Version 1.1.",
    "This is free software; you may redistribute it under the terms of the Artistic License 2.0.",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted",
    "This source file is subject to version 3.01 of the PHP license, that is bundled with this package in the file LICENSE.",
    "Licensed under the Python Software Foundation License Version 2.",
    "This software is released under the Microsoft Public License.",
    "This material is made available under the Open Government Licence v3.0.",
    "The database is licensed under the Open Database License.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "By installing or using the software you agree to be bound by the terms of this license agreement.",
    "Licensed under the Academic Free License version 3.0.",
    "You are granted a limited, non-exclusive, non-transferable license to use this software for evaluation only.",
    "This work is licensed under the Community Data License Agreement.",
    "SPDX-License-Identifier: CDDL-1.0",
    "SPDX-License-Identifier: OFL-1.1",
    "SPDX-License-Identifier: LicenseRef-Custom",
    "Distributed under the terms of the Server Side Public License.",
    "Released under the Business Source License 1.1.",
)
UNKNOWN = "unknown"
#: Bounds of the sample of ordinary paragraphs that the regression learns from; longer ones are not drawn.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS, SAMPLE_CHARS = 400, 1500, 4000
#: Rows made of each notice; passes, rows a step and L1 penalty of the fit; one notice in so many is kept from a first fit, to calibrate.
VARIANTS, EPOCHS, BATCH_ROWS, SPARSITY, KEPT = 20, 8, 128, 2e-5, 4
#: Part of all paragraphs that are taken to be licences; rows of the fit hold far more.
PRIOR = 0.02
#: A licence's chance and the part of a template's word pairs from which a prediction counts.
CHANCE, CONFIRM = 0.5, 0.7
#: A notice over several lines has its last line begin within so many words: three times the longest template.
NEAR_WORDS = 3 * max(len(t.split()) for own in TEMPLATES.values() for t in own)
_SEPARATOR = np.asarray([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])


def _features(b, upto: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and paragraph of each word 1- to 3-gram of a block, and each paragraph's row. A paragraph is a line."""
    h = b.hashes()
    breaks = np.concatenate([[0], np.cumsum(b.data == 10)])
    # paragraphs are numbered through the block; a row's first differs from the last one's of the row before
    row = b.row_of_word()
    para = breaks[b.start] + row
    out, at = [h], [para]
    with np.errstate(over="ignore"):
        g = h
        for n in range(1, upto):
            g = mix(g[:-1] * U(0x2545F4914F6CDD1D) + h[n:] + U(n)) if len(g) > 1 else g[:0]
            same = para[n:] == para[: len(h) - n] if len(h) > n else np.zeros(0, bool)
            out.append(g[same])
            at.append(para[n:][same])
    return np.concatenate(out), np.concatenate(at), row


def _grams(texts: list[str], upto: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of each text, line feeds taken for blanks: hashes and texts' numbers, in order of the texts."""
    hashes, rows = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for b in blocks(pa.array([t.replace("\n", " ") for t in texts], pa.large_string()), separator=_SEPARATOR):
        grams, para, _ = _features(b, upto)  # without line feeds, a paragraph is a row
        hashes.append(grams)
        rows.append(para + b.rows.start)
    h, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
    return h[new], r[new]


def _pairs(texts: list[str]) -> list[np.ndarray]:
    """Hashes of each text's word pairs."""
    (both, at), (one, own) = _grams(texts, 2), _grams(texts, 1)
    return [np.setdiff1d(both[at == i], one[own == i]) for i in range(len(texts))]


class LicenceModel:
    """Sorted gram hashes, weights per gram and class (class 0, no licence, weighs 0; the last is a licence of no known family), calibration, and templates."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, constant: np.ndarray, heat: float, common: np.ndarray):
        self.families = [*TEMPLATES, UNKNOWN]
        flat = [(f, t) for f, own in enumerate(TEMPLATES.values()) for t in own]
        pairs = _pairs([t for _, t in flat])
        self.of_template = np.asarray([f for f, _ in flat])
        self.vocabulary = np.union1d(vocabulary, np.concatenate(pairs))
        self.weights = np.zeros((len(self.vocabulary), weights.shape[1]))
        self.weights[np.searchsorted(self.vocabulary, vocabulary)] = weights
        self.constant, self.heat = constant, heat
        self.member = np.zeros((len(self.vocabulary), len(pairs)), np.float32)
        for i, own in enumerate(pairs):
            self.member[np.searchsorted(self.vocabulary, own), i] = 1.0 / max(len(own), 1)
        self.sizes = np.asarray([len(own) for own in pairs])
        # pairs that ordinary paragraphs have, too, begin no notice
        self.is_pair = self.member.any(1) & ~np.isin(self.vocabulary, common)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.vocabulary & U(0xFFFFF)).astype(np.int64)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and their places."""
        may = np.flatnonzero(self.maybe[(grams & U(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, grams[may]), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == grams[may]
        return may[hit], at[hit]

    def judge(self, para: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Paragraphs with known grams: their numbers, likeliest licence, its chance (of any licence: the sum), confirmation (0 where the chance is too low), and the pairs that confirm it."""
        pair = np.unique(para.astype(np.int64) * len(self.vocabulary) + place)
        number, at = np.divmod(pair, len(self.vocabulary))
        head = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, np.int64)
        if not len(head):
            return head, head, np.zeros(0), np.zeros(0), np.zeros(0)
        p = _chances((np.add.reduceat(self.weights[at], head, axis=0) + self.constant) / self.heat)
        family = p[:, 1:].argmax(1)
        chance = 1 - p[:, 0]
        covered, shared = np.zeros(len(head)), np.zeros(len(head))
        size = np.diff(np.append(head, len(at)))
        good = chance >= CHANCE
        if good.any():
            own = np.repeat(good, size)
            start = np.cumsum(size[good]) - size[good]
            part = np.add.reduceat(self.member[at[own]], start, axis=0)
            part = np.where(self.of_template[None, :] == family[good][:, None], part, 0)
            covered[good], shared[good] = part.max(1), (part * (part >= CONFIRM) * self.sizes).max(1)
        return number[head], family, chance, covered, shared


def _chances(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _wrapped(m: LicenceModel, b, row: np.ndarray, of_word: np.ndarray, sure: dict[int, float]) -> list[tuple[int, int, int, int, float, float]]:
    """Notices over several lines of a paragraph (lines without a blank one between): row, first and last line as numbered
    in the block, family, chance and confirmation. Lines that are sure on their own (with so many pairs) go into one that has more."""
    h = b.hashes()
    if len(h) < 2:
        return []
    with np.errstate(over="ignore"):
        pair = mix(h[:-1] * U(0x2545F4914F6CDD1D) + h[1:] + U(1))
    near = np.flatnonzero((row[1:] == row[:-1]) & (of_word[1:] - of_word[:-1] <= 1))
    found, place = m.find(pair[near])
    starts = np.unique(of_word[near[found[m.is_pair[place]]]])
    lines, first = np.unique(of_word, return_index=True)
    last = np.append(first[1:], len(of_word))
    home = row[first]
    windows = []
    for a in np.searchsorted(lines, starts).tolist():
        z = a + 1
        while z < len(lines) and lines[z] == lines[z - 1] + 1 and home[z] == home[a] and first[z] - first[a] <= NEAR_WORDS:
            windows.append((a, z))
            z += 1
    if not windows:
        return []
    texts = [b.data[b.start[first[a]] : b.end[last[z] - 1]].tobytes().replace(b"\n", b" ").decode("utf-8", "replace") for a, z in windows]
    best: dict[int, tuple[float, int, int, float, float]] = {}  # by first line: the one that most pairs confirm
    done = 0
    for own in blocks(pa.array(texts, pa.large_string()), separator=_SEPARATOR):
        grams, para, _ = _features(own)
        at, place = m.find(grams)
        # a window is one line, numbered by its row
        number, family, chance, covered, shared = m.judge(para[at], place)
        for i, f, c, v, n in zip(number.tolist(), family.tolist(), chance.tolist(), covered.tolist(), shared.tolist(), strict=True):
            a, z = windows[done + i]
            alone = max((sure.get(x, 0.0) for x in range(int(lines[a]), int(lines[z]) + 1)), default=0.0)
            if c >= CHANCE and v >= CONFIRM and n > alone + 0.5 and (a not in best or n > best[a][0] + 0.5):
                best[a] = (n, z, f, c, v)
        done += own.rows.stop - own.rows.start
    out, free = [], 0
    for a in sorted(best):
        _, z, f, c, v = best[a]
        if a >= free:
            out.append((int(home[a]), int(lines[a]), int(lines[z]), f, c, v))
            free = z + 1
    return out


class _Sparse:
    """Texts by the grams that two of them have at least, or a notice."""

    def __init__(self, texts: list[str], always: np.ndarray):
        h, row = _grams(texts)
        found, at, n = np.unique(h, return_inverse=True, return_counts=True)
        keep = (n >= 2) | np.isin(found, always)
        self.vocabulary, self.rows = found[keep], len(texts)
        number = np.cumsum(keep) - 1
        own = keep[at]
        self.column, self.row = number[at[own]], row[own]

    def only(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns and new row numbers of some of the rows."""
        number = np.cumsum(which) - 1
        own = which[self.row]
        return self.column[own], number[self.row[own]]


def _times(column: np.ndarray, row: np.ndarray, rows: int, w: np.ndarray) -> np.ndarray:
    """The product of a matrix of ones at (row, column), in order of rows, with w."""
    out = np.zeros((rows, w.shape[1]), w.dtype)
    if len(row):
        head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[head]] = np.add.reduceat(w[column], head, axis=0)
    return out


def _fit(column: np.ndarray, row: np.ndarray, y: np.ndarray, columns: int, classes: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Weights and constants: adaptive gradient steps on the likelihood of some rows at a time, each followed by the L1 penalty's shrinkage."""
    target = np.eye(classes, dtype=np.float32)[y]
    w, c = np.zeros((columns, classes), np.float32), np.zeros(classes, np.float32)
    speed_w, speed_c = np.full_like(w, 1e-8), np.full_like(c, 1e-8)
    cut = np.searchsorted(row, np.arange(len(y) + 1))
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for own in np.split(order, range(BATCH_ROWS, len(y), BATCH_ROWS)):
            size = cut[own + 1] - cut[own]
            at = np.arange(int(size.sum())) + np.repeat(cut[own] - (np.cumsum(size) - size), size)
            used, place = np.unique(column[at], return_inverse=True)
            x = np.zeros((len(own), len(used)), np.float32)
            x[np.repeat(np.arange(len(own)), size), place] = 1
            over = (_chances(x @ w[used] + c) - target[own]) / np.float32(len(own))
            g_w, g_c = x.T @ over, over.sum(0)
            speed_w[used] += g_w**2
            speed_c += g_c**2
            rate = np.float32(0.3) / np.sqrt(speed_w[used])
            new = w[used] - rate * g_w
            w[used] = np.sign(new) * np.maximum(np.abs(new) - SPARSITY * rate * (g_w != 0), 0)
            c -= np.float32(0.3) * g_c / np.sqrt(speed_c)
    return w, c


def train(paragraphs: list[str], seed: int = 5) -> LicenceModel:
    """Fit on notices in ordinary surroundings, and on ordinary paragraphs.

    Chances are calibrated by a temperature: of a first fit without one notice in KEPT of each family (and without one
    ordinary paragraph in KEPT), on the rows of those. Sampled paragraphs that hold a notice are left out.
    """
    rng = np.random.default_rng(seed)
    last = len(TEMPLATES) + 1
    flat = [(f + 1, i, t) for f, own in enumerate(TEMPLATES.values()) for i, t in enumerate(own)] + [(last, i, t) for i, t in enumerate(OTHERS)]
    notices = [t for _, _, t in flat]
    pairs = _pairs(notices)
    h, row = _grams(paragraphs, 2)
    like = np.zeros(len(paragraphs), bool)
    for own in pairs:
        like |= np.bincount(row[np.isin(h, own)], minlength=len(paragraphs)) >= CONFIRM * max(len(own), 1)
    ordinary = [t for t, x in zip(paragraphs, like.tolist(), strict=True) if not x]
    words = np.asarray([w for t in ordinary for w in t.split()] or ["text", "page", "note", "here"])
    texts, labels, kept = list(ordinary), [0] * len(ordinary), [i % KEPT == 0 for i in range(len(ordinary))]
    for label, number, t in flat:
        for i in range(VARIANTS):
            own = t.split()
            if i % 3:  # some words lost
                own = [w for w, x in zip(own, rng.random(len(own)).tolist(), strict=True) if x > 0.1]
            if i % 2:  # amid other text
                around = rng.choice(words, int(rng.integers(1, 30))).tolist()
                cut = int(rng.integers(0, len(around) + 1))
                own = around[:cut] + own + around[cut:]
            if i % 5 == 4:
                own = ["Copyright", str(int(rng.integers(1990, 2030))), *rng.choice(words, 2).tolist(), *own]
            texts.append(" ".join(own))
            labels.append(label)
            kept.append(number % KEPT == KEPT - 1)
    # notices' single words in other company are no licence
    stock = np.concatenate([words, np.asarray(sorted({w for t in notices for w in t.split()}))])
    for i in range(max(600, len(flat) * VARIANTS - len(ordinary))):  # as many rows without a notice as with one, at least
        texts.append(" ".join(rng.choice(stock if i % 2 else words, int(rng.integers(3, 25))).tolist()))
        labels.append(0)
        kept.append(i % KEPT == 0)
    y, out = np.asarray(labels), np.asarray(kept)
    x = _Sparse(texts, _grams(notices)[0])
    w, c = _fit(*x.only(~out), y[~out], len(x.vocabulary), last + 1, rng)
    z, aim = (_times(*x.only(out), int(out.sum()), w) + c).astype(np.float64), y[out]

    def loss(heat: float) -> float:
        return float(-np.log(np.maximum(_chances(z / heat)[np.arange(len(aim)), aim], 1e-12)).mean())

    heat = min(np.geomspace(0.3, 5.0, 25).tolist(), key=loss)
    w, c = _fit(x.column, x.row, y, len(x.vocabulary), last + 1, rng)
    w, c = (w - w[:, :1]).astype(np.float64), (c - c[0]).astype(np.float64)
    c[1:] -= heat * np.log((1 - PRIOR) / PRIOR * (y > 0).sum() / (y == 0).sum())
    used = np.abs(w).max(1) > 1e-3
    return LicenceModel(x.vocabulary[used], w[used], c, heat, np.unique(h[~like[row]]))


def sample_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """A sample of ordinary paragraphs, drawn by hash of the id and of the line: bounded in rows and in length."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spread = F.xxhash64("id", F.lit(3))
    ids = rows.select("id").filter("id is not null").orderBy(spread, "id").limit(SAMPLE_DOCS).distinct()
    lines = rows.join(F.broadcast(ids), "id", "left_semi").select(F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line").between(1, SAMPLE_CHARS))
    found = lines.distinct().orderBy(F.xxhash64("line"), "line").limit(SAMPLE_PARAGRAPHS).collect()
    return [r["line"] for r in found]


_HIT = "array<struct<paragraph:int,family:string,chance:double,confirmed:double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LicenceModel | None = None) -> DataFrame:
    """doc_id, n_paragraphs (lines with a word), hits: one row per row of ``docs``.

    A hit is a paragraph (counted from 0 by line) that is a licence by its chance: its family where a template confirms
    it, else ``unknown``. A notice wrapped over lines counts once, at its first line. Null and empty texts have no paragraphs
    and no hits. Whole texts are scanned, however long; rows that repeat are scanned each. An empty table gives an empty
    result; other columns are ignored, whatever their names. Of classes of one chance, the first in order is taken.
    """
    model = model or train(sample_paragraphs(docs, id_col, text_col))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.asarray(m.families, object)
        for batch in batches:
            n_all, hits = [], []
            for b in blocks(batch.column(1), separator=_SEPARATOR):
                rows = b.rows.stop - b.rows.start
                grams, para, row = _features(b)
                breaks = np.concatenate([[0], np.cumsum(b.data == 10)])
                of_word = breaks[b.start] + row
                first = np.concatenate([[True], of_word[1:] != of_word[:-1]]) if len(of_word) else np.zeros(0, bool)
                n_all.append(np.bincount(row[first], minlength=rows))
                found, place = m.find(grams)
                number, family, chance, covered, shared = m.judge(para[found], place)
                own: list[list] = [[] for _ in range(rows)]
                ok = chance >= CHANCE
                before = breaks[b.offsets[:-1]] + np.arange(rows)
                confirmed = ok & (covered >= CONFIRM)
                sure = dict(zip(number[confirmed].tolist(), shared[confirmed].tolist(), strict=True))
                wrapped = _wrapped(m, b, row, of_word, sure)
                if ok.any():
                    inside = np.zeros(len(number), bool)
                    for _, i, z, *_ in wrapped:
                        inside |= (number >= i) & (number <= z)
                    ok &= ~inside
                    home = row[np.searchsorted(of_word, number[ok])]
                    line = number[ok] - before[home]
                    label = np.where(covered[ok] >= CONFIRM, family[ok], len(names) - 1)
                    for r, i, f, c, v in zip(home.tolist(), line.tolist(), names[label], chance[ok].tolist(), covered[ok].tolist(), strict=True):
                        own[r].append({"paragraph": i, "family": f, "chance": c, "confirmed": v})
                for r, i, _, f, c, v in wrapped:
                    own[r].append({"paragraph": i - int(before[r]), "family": names[f], "chance": c, "confirmed": v})
                    own[r].sort(key=lambda x: x["paragraph"])
                hits += own
            kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("chance", pa.float64()), ("confirmed", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, np.int64), *n_all])), pa.array(hits, kind)], ["doc_id", "n_paragraphs", "hits"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_paragraphs long, hits {_HIT}")
