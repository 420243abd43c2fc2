"""Licence scan: a trained paragraph classifier, confirmed by templates.

Paragraphs are lines; long ones are read by overlapping windows of words, too. A
sparse logistic regression over word n-grams names a licence family or none.
Probabilities are calibrated on texts that were held out whole, with all rows made
from them; below the calibrated limit the family is unknown. A named family is
confirmed where the words' shingles lie in one of the family's templates, or
one of these in the shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, prefix_sums, substring_hash, words
from .common import text_of

ORDERS = 3
SHINGLE = 5
SIMILARITY = 0.8
#: Labelled rows that are used for fitting, at most.
MAX_LABELLED = 5000
#: Words of a window of a long line, and from one window to the next.
WINDOW = 16
STEP = 8
#: Folds of texts that are held out in turn, and the share of right families above the limit of the unknown class.
FOLDS = 4
PRECISION = 0.98
NONE = "none"
# Notices by licence family.
TEMPLATES = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.", "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. The ASF licenses this file to you under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD License. Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "This text is available under the Creative Commons Attribution-ShareAlike License"),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Available under the Creative Commons Attribution-NonCommercial License for non-commercial use"),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "Licensed under the Eclipse Public License, version 2.0.",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.", "This software is licensed under the terms of the ISC license.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.", "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "Licensed under the Mozilla Public License, version 2.0."),
    "proprietary": ("All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.", "All rights reserved. No part of this work may be reproduced without the prior written permission of the owner."),
}
# Paragraphs without a licence, among them some with a licence's words.
OTHERS = """
The driver lost his license in the spring and walked to work.
A version of the story was released in the summer to the general public.
The terms of the treaty were published by the foundation under pressure.
He was free to use the software at work but not at home.
The school is under the old bridge and has a license to sell tea.
All of the seats were reserved for the rights committee.
Permission to land was granted by the tower after an hour.
She wrote a copy of the letter and kept it in a file.
There were four tables, a lamp and a map of the river in the room.
This work is the result of many years and of the help of friends.
The general was a public man, and the public liked him.
You may not enter the house without the key.
The following conditions of the weather were met with a smile.
The source of the river lies in the north, at the foot of a hill.
A commons is land that all may use, with some limits.
Apache is also the name of a people of the plains.
The MIT team won the match in version two of the game.
Under the table lay a dog, and on it lay a book on law.
La casa de la playa es de todos los que viven en el pueblo.
Der Vertrag ist unter der Lizenz der Stadt und gilt bis zum Jahr.
Les droits de la maison sont dans la lettre que nous avons reçue.
It is what it is, and that was that, said the man at the door.
The eclipse of the sun was seen by the public at noon.
Fees for the library are due at the end of the month.
The foundation of the house was laid without any warranty of the weather.
""".strip().split("\n")
FILLER = "note the end of this part and in a file or see below now for more on that page".split()


def labelled_rows() -> list[tuple[str, str, int]]:
    """The labelled table: (text, family, origin), rows with one origin being made from one text.

    Notices and other paragraphs whole, in parts and among other words.
    """
    rng = np.random.default_rng(0)
    rows, origin = [], 0
    for family, texts in [*TEMPLATES.items(), (NONE, OTHERS)]:
        for text in texts:
            w = text.split()
            origin += 1
            for turn in range(24 if family != NONE else 16):
                some = w
                if turn % 3 == 1 and len(w) > 9:
                    a = int(rng.integers(0, len(w) - 7))
                    some = w[a : a + int(rng.integers(7, len(w) - a + 1))]
                if turn % 3 == 2:
                    extra = lambda: [FILLER[k] for k in rng.integers(0, len(FILLER), rng.integers(0, 4))]
                    some = [*extra(), *w, *extra()]
                rows.append((" ".join(some), family, origin))
    for n in range(150):
        rows.append((" ".join(FILLER[k] for k in rng.integers(0, len(FILLER), rng.integers(1, 30))), NONE, origin + 1 + n))
    origin += 150
    # Foreign words with a few that notices have, so that such words alone name no family.
    common = sorted({w.lower() for texts in TEMPLATES.values() for t in texts for w in t.split()})
    rows += [(" ".join([w] * k), NONE, origin + n) for n, w in enumerate(common) for k in (1, 2)] * 2
    origin += len(common)
    for n in range(400):
        foreign = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(int(rng.integers(0, 12)))]
        some = foreign + [common[k] for k in rng.integers(0, len(common), 1 + n % 3)]
        rows.append((" ".join(some[k] for k in rng.permutation(len(some))), NONE, origin + n))
    return rows


def grams(data: np.ndarray, offsets: np.ndarray):
    """Paragraphs (text, line) of the words, words of each, and the n-grams of up to ORDERS words: hash and paragraph.

    Words are lower-case and without punctuation around them. What yields
    n-grams of one order is a function, so that callers can drop words first.
    """
    starts, ends, _ = words(data, offsets)
    lower = data | (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    letter = ((lower >= 97) & (lower <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    at = np.arange(len(data))
    if len(starts):
        starts, ends = np.minimum.accumulate(np.where(letter, at, len(data))[::-1])[::-1][starts], np.minimum(np.maximum.accumulate(np.where(letter, at, -1))[ends - 1] + 1, ends)
        keep = starts < ends
        starts, ends = starts[keep], ends[keep]
    text = np.searchsorted(offsets, starts, "right") - 1
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    line = feeds[starts] - feeds[offsets[:-1]][text]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1])
    paragraph = np.cumsum(fresh) - 1
    return text[fresh], line[fresh], paragraph, substring_hash(prefix_sums(lower), starts, ends)


def joined(h: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(start), n, np.uint64)
    for k in range(n):
        out = (out ^ h[start + k]) * np.uint64(0x9E3779B97F4A7C55)
        out ^= out >> np.uint64(29)
    return out


def shingles(text: str) -> set[int]:
    data = text.encode()
    _, _, _, h = grams(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    n = min(SHINGLE, len(h))
    return set(joined(h, np.arange(len(h) - n + 1), n).tolist()) if n else set()


class Model:
    """Weights by n-gram hash; biases, temperature and the limit below which a family is unknown."""

    def __init__(self, families, single, keys, weights, bias, temperature, limit):
        self.families, self.single, self.keys, self.weights, self.bias, self.temperature, self.limit = families, single, keys, weights, bias, temperature, limit

    def features(self, paragraph: np.ndarray, h: np.ndarray, n: int):
        """Known n-grams (paragraph, index) and the words of each paragraph. Longer ones consist of known words."""
        known = self.single[np.minimum(np.searchsorted(self.single, h), len(self.single) - 1)] == h
        rows, cols = [], []
        for k in range(1, ORDERS + 1):
            start = np.flatnonzero(known[: len(h) - k + 1]) if len(h) >= k else np.zeros(0, int)
            for j in range(1, k):
                start = start[known[start + j] & (paragraph[start + j] == paragraph[start])]
            g = joined(h, start, k)
            at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
            hit = self.keys[at] == g
            rows.append(paragraph[start[hit]])
            cols.append(at[hit])
        return np.concatenate(rows), np.concatenate(cols), np.bincount(paragraph, minlength=n)

    def logits(self, rows, cols, size) -> np.ndarray:
        """Sums of weights over the words, so that a paragraph of foreign words has the biases alone."""
        out = np.empty((len(size), len(self.families)))
        scale = 1 / np.maximum(size, 1)
        for c in range(len(self.families)):
            out[:, c] = np.bincount(rows, weights=self.weights[cols, c], minlength=len(size)) * scale + self.bias[c]
        return out

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        x = logits / self.temperature
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def as_chunk(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = [t.replace("\n", " ").encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def trained(rows: list[tuple], families: list[str], rounds: int, rate: float, decay: float) -> Model:
    """Multinomial logistic regression on all rows, not calibrated."""
    text, _, paragraph, h = grams(*as_chunk([r[0] for r in rows]))
    gold = np.array([families.index(rows[i][1]) for i in text.tolist()])
    often, times = np.unique(h, return_counts=True)
    single = often[times > 1]
    keys = []
    for k in range(1, ORDERS + 1):
        start = np.arange(len(h) - k + 1)
        found, times = np.unique(joined(h, start[paragraph[start] == paragraph[start + k - 1]], k), return_counts=True)
        keys.append(found[times > 1])
    keys = np.unique(np.concatenate(keys))
    model = Model(families, single, keys, np.zeros((len(keys), len(families))), np.zeros(len(families)), 1.0, 0.5)
    r, c, size = model.features(paragraph, h, len(text))
    x = np.zeros((len(text), len(keys)), np.float32)
    np.add.at(x, (r, c), 1)
    x /= np.maximum(size, 1)[:, None]
    want = np.eye(len(families), dtype=np.float32)[gold]
    w, sums, bias_sums = np.zeros_like(model.weights, np.float32), np.full_like(model.weights, 1e-6), np.full(len(families), 1e-6)
    for _ in range(rounds):
        p = model.probabilities(x @ w + model.bias).astype(np.float32)
        g = x.T @ (want - p) / len(want) - decay * w
        b = (want - p).mean(0)
        sums += g * g
        bias_sums += b * b
        w += rate * g / np.sqrt(sums)
        model.bias += 0.1 * b / np.sqrt(bias_sums)
    model.weights = w
    return model


def held_out(rows: list[tuple], rounds: int, rate: float, decay: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Families, logits and true families of all rows, each by a model that saw no row of the same origin."""
    families = sorted({r[1] for r in rows} | {NONE})
    fold = {o: n % FOLDS for n, o in enumerate(dict.fromkeys(r[2] for r in rows))}
    logits, gold = [], []
    for k in range(FOLDS):
        train, test = [r for r in rows if fold[r[2]] != k], [r for r in rows if fold[r[2]] == k]
        if not train or not test:
            continue
        model = trained(train, families, rounds, rate, decay)
        text, _, paragraph, h = grams(*as_chunk([r[0] for r in test]))
        logits.append(model.logits(*model.features(paragraph, h, len(text))))
        gold.append(np.array([families.index(test[i][1]) for i in text.tolist()]))
    return families, np.concatenate(logits), np.concatenate(gold)


def fit(rows: list[tuple], rounds: int = 200, rate: float = 2.0, decay: float = 1e-5) -> Model:
    """A model of all rows (text, family, origin), whose temperature and limit come from rows held out with their origin.

    From the limit on, PRECISION of the held-out rows that get a family get the
    right one; it is over 1, so that every family is unknown, where no limit reaches that.
    """
    families, logits, gold = held_out(rows, rounds, rate, decay)
    model = trained(rows, families, rounds, rate, decay)
    loss = {}
    for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0):
        model.temperature = t
        loss[t] = -np.log(np.maximum(model.probabilities(logits)[np.arange(len(gold)), gold], 1e-12)).mean()
    model.temperature = min(loss, key=loss.get)
    p = model.probabilities(logits)
    named = np.flatnonzero(p.argmax(1) != families.index(NONE))
    named = named[np.argsort(-p[named].max(1), kind="stable")]
    right = np.cumsum(p[named].argmax(1) == gold[named]) >= PRECISION * np.arange(1, len(named) + 1)
    right[:-1] &= np.diff(p[named].max(1)) < 0  # rows of one probability stay together
    model.limit = float(p[named[np.flatnonzero(right)[-1]]].max()) if right.any() else 1.1
    return model


def units(paragraph: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is classified: paragraph, first and end word of each, windows of the long ones beside the whole."""
    edge = np.concatenate([np.flatnonzero(np.diff(paragraph, prepend=-1)), [len(paragraph)]])
    size = np.diff(edge)
    whole = np.arange(len(size))
    more = np.where(size > WINDOW, -(-(size - WINDOW) // STEP) + 1, 0)
    owner = np.repeat(whole, more)
    first = edge[owner] + STEP * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))
    return np.concatenate([whole, owner]), np.concatenate([edge[:-1], first]), np.concatenate([edge[1:], np.minimum(first + WINDOW, edge[owner + 1])])


def find_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", labelled: DataFrame | None = None, templates: dict[str, tuple] = TEMPLATES) -> DataFrame:
    """(doc_id, family, n_paragraphs, n_confirmed, n_unknown, paragraphs) of each row.

    paragraphs has, in order, line:family:state of each line that looks like a
    licence, state being confirmed, or unconfirmed, or unknown (under the calibrated
    limit); of a long line the most probable window counts. family is the one with most
    confirmed lines, the first in order on ties, "unknown" if none is confirmed, "none"
    without such lines. labelled (text, family) replaces the built-in table, of which
    MAX_LABELLED rows are used, equal texts as one origin; bring templates of other families.
    A null text is empty, very long ones are read whole, repeated rows get the same result,
    other columns aren't read.
    """
    rows = labelled_rows() if labelled is None else [(r.text, r.family, r.text) for r in labelled.select("text", "family").orderBy(F.xxhash64("text", "family")).limit(MAX_LABELLED).collect()]
    held = docs.sparkSession.sparkContext.broadcast(vars(fit(rows)))

    def run(batches):
        model = Model(**held.value)
        none = model.families.index(NONE)
        known = {f: [s for s in map(shingles, texts) if s] for f, texts in templates.items()}
        for batch in batches:
            for part, data, offsets in chunks(batch):
                owner, line, paragraph, h = grams(data, offsets)
                found: list[list[tuple[int, str, str]]] = [[] for _ in range(part.num_rows)]
                counts = np.bincount(owner, minlength=part.num_rows)
                if len(owner):
                    unit, first, end = units(paragraph)
                    size = end - first
                    words_of = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                    p = model.probabilities(model.logits(*model.features(np.repeat(np.arange(len(unit)), size), h[words_of], len(unit))))
                    best = p.argmax(1)
                    named = np.flatnonzero(best != none)
                    # Of the units of a paragraph the most probable one, the first on ties.
                    named = named[np.lexsort((named, -p[named].max(1), unit[named]))]
                    for i in named[np.flatnonzero(np.diff(unit[named], prepend=-1))].tolist():
                        family = model.families[best[i]]
                        a, b = int(first[i]), int(end[i])
                        n = min(SHINGLE, b - a)
                        mine = set(joined(h, np.arange(a, b - n + 1), n).tolist())
                        sure = any(len(mine & s) >= SIMILARITY * min(len(mine), len(s)) for s in known.get(family, ()))
                        state = "confirmed" if sure else "unconfirmed" if p[i, best[i]] >= model.limit else "unknown"
                        found[owner[unit[i]]].append((int(line[unit[i]]), family, state))
                out = []
                for x in found:
                    sure = [f for _, f, s in x if s == "confirmed"]
                    out.append((max(sorted(set(sure)), key=sure.count) if sure else "unknown" if x else NONE, len(sure), sum(s == "unknown" for _, _, s in x), ",".join(f"{n}:{f}:{s}" for n, f, s in x)))
                cols = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cols[0], pa.string()), pa.array(counts, pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["doc_id", "family", "n_paragraphs", "n_confirmed", "n_unknown", "paragraphs"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text")).mapInArrow(run, "doc_id long, family string, n_paragraphs long, n_confirmed long, n_unknown long, paragraphs string")
