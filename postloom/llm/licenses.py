"""Licence scans: a trained paragraph classifier, confirmed by template comparison.

Paragraphs (runs of lines up to a blank one) and their lines are read in windows of up to 64 words. A softmax regression over
word uni- and bigrams of the known notices gives a window's licence family, `unknown` (a licence of none of them) or `none`; it is trained on the notices with words
dropped, changed and embedded in running text, against windows of the corpus itself that name no licence. Probabilities are
calibrated by a temperature on variants and windows kept back, and the least probability is set so that no more than one kept-back window in a thousand has a family that likely. A
window passes with that probability for all families together, so that families named together do not divide it; the score of
each is its probability against running text alone. A window shows every family of which a notice confirms it: most of its word
bigrams must stand in the window. Where several do, the most similar takes the places of its bigrams, and others need places of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import map_text, text_bytes
from postloom.llm.words import batches, gram_hashes, mix

UNKNOWN = "unknown"  # a licence of no family below
NONE = "none"         # running text
BLOCK = 32           # a window is two neighbouring blocks of a line
RUN = 1 << 14        # windows weighed at a time, however long the line
FIT_WINDOWS = 4000   # corpus windows that the unknown class learns from and is calibrated on
VARIANTS = 60
CONFIRM = 0.6
PASS = 0.001
_BITS = 20

# Short public licence notices, by family.
NOTICES = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0",
                   "you may not use this file except in compliance with the License",
                   "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"],
    "MIT": ["The MIT License (MIT)", "SPDX-License-Identifier: MIT", "Released under the MIT License", "Licensed under the MIT license",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later",
                "Distributed under the GNU GPL v3", "This work is licensed under the GNU General Public License, version 3",
                "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later",
                "Distributed under the GNU GPL v2", "licensed under the GNU General Public License, version 2",
                "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "LGPL": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
             "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-or-later", "under the terms of the GNU Lesser General Public License", "licensed under the GNU Lesser General Public License, version 2.1",
             "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
             "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later",
                 "under the terms of the GNU Affero General Public License",
                 "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
                 "licensed under the GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0"],
    "BSD": ["SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD 3-Clause License",
            "Released under the BSD License"],
    "ISC": ["SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC0": ["Released under CC0 1.0 Universal", "dedicated the work to the public domain by waiving all of his or her rights"],
    "Zlib": ["SPDX-License-Identifier: Zlib", "In no event will the authors be held liable for any damages arising from the use of this software",
             "The origin of this software must not be misrepresented; you must not claim that you wrote the original software"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License - v 2.0", "SPDX-License-Identifier: EPL-2.0",
                "made available under the terms of the Eclipse Public License 2.0"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0", "SPDX-License-Identifier: BSL-1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "All-Rights-Reserved": ["All rights reserved. No part of this publication may be reproduced", "Copyright. All rights reserved."],
}
# What licences of any family say. One of these whole, and no family in its paragraph, makes an unknown licence.
GENERAL = ["is licensed under the", "are licensed under the", "Licensed under the terms of the", "Released under the terms of the",
           "distributed under the terms of the license", "made available under the terms of the license",
           "Permission to use, copy, modify and distribute this software", "This software is provided under the license"]
NAMES = r"(?i)licen[sc]e|copyright|creative commons|public domain|all rights reserved|cc by|cc0"


def _strip(line: bytes) -> bytes:
    """Punctuation at the ends of words is no part of them here."""
    return line.translate(_DROP)


_MARKS = b".,;:()[]{}\"'<>|!?*#&%$"
_DROP = bytes.maketrans(_MARKS, b" " * len(_MARKS))


def _grams(lines: list[bytes]):
    """Per run of lines: word hashes, bigram hashes (one fewer), offsets."""
    for first, words, offsets in batches([_strip(x) for x in lines]):
        yield first, mix(words + np.uint64(1)), gram_hashes(words, 2), offsets


@dataclass
class LicenseModel:
    families: list[str]   # the last ones are UNKNOWN and NONE
    place: np.ndarray     # low bits of a gram hash -> feature, -1: none
    grams: np.ndarray     # the full hash of each feature
    weights: np.ndarray   # feature x family
    bias: np.ndarray
    heat: float           # temperature
    least: float          # probability a family needs
    notices: list[list[list[int]]]  # per family the distinct bigrams of each notice as features, in order
    lengths: list[list[int]]        # and their number with repeats

    def features(self, values: np.ndarray) -> np.ndarray:
        at = self.place[(values & np.uint64((1 << _BITS) - 1)).astype(np.int64)]
        return np.where((at >= 0) & (self.grams[at] == values), at, -1)


def _one(line: bytes) -> np.ndarray:
    for _, uni, bi, _ in _grams([line]):
        return np.concatenate((uni, bi))
    return np.zeros(0, np.uint64)


def train(corpus: list[bytes], *, seed: int = 3, turns: int = 400) -> LicenseModel:
    """From the notices and windows of running text. Full-batch descent with soft thresholding: sparse weights."""
    rng, families = np.random.default_rng(seed), [*NOTICES, UNKNOWN, NONE]
    known = [*NOTICES.values(), GENERAL]
    vocabulary = np.unique(np.concatenate([_one(n.encode()) for ns in known for n in ns]))
    place = np.full(1 << _BITS, -1, np.int64)
    place[(vocabulary & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = np.arange(len(vocabulary))
    model = LicenseModel(families, place, vocabulary, np.zeros((len(vocabulary), len(families))), np.zeros(len(families)), 1.0, 0.5, [], [])
    every = [[model.features(gram_hashes(w, 2)).tolist() for n in ns for _, w, _ in batches([_strip(n.encode())])] for ns in known]
    model.notices, model.lengths = [[list(dict.fromkeys(n)) for n in ns] for ns in every], [[len(n) for n in ns] for ns in every]
    pool = [w for line in corpus for w in line.split()][:200_000] or [b"text"]
    rows, y = [], []
    for k, notices in enumerate(known):
        for v in range(VARIANTS):
            words = notices[v % len(notices)].encode().split()
            if v >= len(notices):
                words = [pool[rng.integers(len(pool))] if rng.random() < 0.05 else w for w in words if rng.random() > 0.05]
                at = rng.integers(len(pool))
                words = pool[at:at + rng.integers(0, 12)] + words + pool[at + 50:at + 50 + rng.integers(0, 12)]
            rows.append(b" ".join(words)), y.append(k)
    every = sorted({w for ns in known for n in ns for w in n.encode().split()})
    for line in corpus:
        words = line.split()
        if words and rng.random() < 0.5:  # words of notices out of place teach nothing but caution
            words = words + [every[i] for i in rng.integers(len(every), size=rng.integers(1, 4))]
        rows.append(b" ".join(words)), y.append(len(families) - 1)
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, line in enumerate(rows):
        f = model.features(_one(line))
        np.add.at(x[i], f[f >= 0], 1)
    y, fit = np.array(y), rng.random(len(rows)) < 0.7
    target = np.eye(len(families))[y]
    share = 1 / np.maximum(1, np.bincount(y[fit], minlength=len(families)))[y]
    share = (share / share[fit].mean())[fit, None]
    xf, tf, w, b, pace, n = x[fit], target[fit], model.weights, model.bias, 0.5, fit.sum()
    for _ in range(turns):
        z = xf @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - tf) * share / n
        w -= pace * (xf.T @ g)
        b -= pace * g.sum(0)
        w[:] = np.sign(w) * np.maximum(0, np.abs(w) - pace * 2e-5)
    z = x[~fit] @ w + b

    def chances(heat: float) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) / heat)
        return p / p.sum(1, keepdims=True)

    own = y[~fit]
    model.heat = min(np.geomspace(0.05, 4, 40), key=lambda h: -np.log(chances(h)[np.arange(len(own)), own] + 1e-12).sum())
    p = chances(model.heat)[own == len(families) - 1, :-1].max(1)
    model.least = float(min(0.95, max(0.5, np.quantile(p, 1 - PASS)))) if len(p) else 0.5
    return model


def _windows(at: np.ndarray, feature: np.ndarray, starts: np.ndarray, stops: np.ndarray, model: LicenseModel):
    """(first word, word behind, scores by family) of each window that holds a feature. `at` ascends; a window stays in its segment."""
    own = np.searchsorted(starts, at, "right") - 1
    low = starts[own]
    block = low + (at - low) // BLOCK * BLOCK
    back = block > low
    first = np.unique(np.concatenate((block, block[back] - BLOCK)))
    for k in range(0, len(first), RUN):
        some = first[k:k + RUN]
        i, j = np.searchsorted(at, (some[0], some[-1] + 2 * BLOCK))
        sums = np.zeros((len(some), len(model.families)))
        for base in (block[i:j], np.where(back[i:j], block[i:j] - BLOCK, -1)):
            to = np.minimum(np.searchsorted(some, base), len(some) - 1)
            own = some[to] == base
            np.add.at(sums, to[own], model.weights[feature[i:j][own]])
        ends = np.minimum(stops[np.searchsorted(starts, some, "right") - 1], some + 2 * BLOCK)
        yield from zip(some.tolist(), ends.tolist(), (sums + model.bias) / model.heat)


def _candidates(windows, pairs: np.ndarray, grams: np.ndarray, model: LicenseModel) -> set[tuple]:
    """Notices that a window confirms: (similarity, bigrams met, first and behind of the window's `pairs`, family, notice, probability)."""
    out = set()
    for a, b, z in windows:
        i, j = np.searchsorted(pairs, (a, b - 1))
        if j - i < 1:
            continue
        p = 1 / (1 + np.exp(np.clip(z[-1] - z[:-1], -500, 500)))  # of each family against running text alone
        if 1 - 1 / np.exp(np.clip(z - z[-1], None, 500)).sum() < model.least:
            continue
        met = set(grams[i:j].tolist())
        for f in range(len(model.notices)):
            for k, notice in enumerate(model.notices[f]):
                n = len(met.intersection(notice))
                if n >= (CONFIRM if f < len(model.notices) - 1 else 1) * len(notice):
                    out.add((n / len(notice), n, int(i), int(j), f, k, float(p[f])))
    return out


def _placed(found: set[tuple], pairs: np.ndarray, grams: np.ndarray, model: LicenseModel):
    """(first word, word behind, family, probability, similarity) of the notices, those first of which most is met at free places,
    then the densest. A place of a bigram counts for one notice: another needs half of its bigrams at places of its own, of a
    family already found there `CONFIRM` of the notice."""
    taken: dict[int, int] = {}
    heap = [((-2.0, 0, 0), i, j, f, k, -p) for _, _, i, j, f, k, p in found]
    heapify(heap)
    while heap:
        key, i, j, f, k, p = heappop(heap)
        notice = model.notices[f][k]
        places: dict[int, list[int]] = {g: [] for g in notice}
        for at in range(i, j):
            if (g := int(grams[at])) in places:
                places[g].append(at)
        free = [(at, xs) for at, g in enumerate(notice) if (xs := [x for x in places[g] if x not in taken])]
        own, n = len(free), sum(map(bool, places.values()))
        same = any(taken.get(x) == f for xs in places.values() for x in xs)
        if own == 0 or own < (CONFIRM * len(notice) if same else n / 2):
            continue
        # from each place of the first bigram the others where the notice's order has them, or nearest to it
        tries = [[min(xs, key=lambda x: abs(pairs[x] - pairs[x0] - at + free[0][0])) for at, xs in free] for x0 in free[0][1]]
        spots = min(tries, key=lambda t: pairs[max(t)] - pairs[min(t)])
        now = (-own / len(notice), max(0, int(pairs[max(spots)] - pairs[min(spots)]) + 1 - model.lengths[f][k]), -own)
        if now > key:
            heappush(heap, (now, i, j, f, k, p))
            continue
        taken.update((x, f) for x in spots)
        if not same:
            spots = spots + [xs[0] for xs in places.values() if xs and all(x in taken for x in xs) and not set(xs) & set(spots)]
        yield int(pairs[min(spots)]), int(pairs[max(spots)]) + 2, model.families[f], -p, len(spots) / len(notice)
        heappush(heap, ((-2.0, 0, 0), i, j, f, k, p))  # the window may hold it again


def scan_paragraphs(paragraphs: list[list[bytes]], model: LicenseModel) -> list[tuple[int, int, int, int, str, float, float]]:
    """(paragraph, line in it, first word, word behind, family, probability, similarity) of every notice found. The line is the one
    in which the notice starts; the words count from its start and may lie in the lines that follow. Windows are cut from the
    whole paragraph and from each of its lines."""
    out = []
    for first, uni, bi, offsets in _grams([b"\n".join(lines) for lines in paragraphs]):
        hits = np.flatnonzero((f := model.features(uni)) >= 0)
        pairs = np.flatnonzero((g := model.features(bi)) >= 0)
        owner = np.searchsorted(offsets, pairs, "right") - 1
        good = pairs + 2 <= offsets[owner + 1]
        pairs, owner = pairs[good], owner[good]
        for k in np.flatnonzero(np.bincount(owner, minlength=1)):
            a, b = offsets[k], offsets[k + 1]
            mine = pairs[owner == k] - a
            grams = g[mine + a]
            own = hits[np.searchsorted(hits, a):np.searchsorted(hits, b)]
            at, feature = np.concatenate((own - a, mine)), np.concatenate((f[own], grams))
            order = np.argsort(at, kind="stable")
            at, feature = at[order], feature[order]
            lines = np.cumsum([0] + [len(_strip(x).split()) for x in paragraphs[first + k]])
            found = _candidates(_windows(at, feature, lines[:1], lines[-1:], model), mine, grams, model)
            if len(lines) > 2:
                inside = mine + 2 <= lines[np.searchsorted(lines, mine, "right")]
                some = np.concatenate((np.ones(len(own), bool), inside))[order]
                some &= np.isin(np.searchsorted(lines, at, "right"), np.searchsorted(lines, mine[inside], "right"))
                if some.any():
                    found |= _candidates(_windows(at[some], feature[some], lines[:-1], lines[1:], model), mine, grams, model)
            general = len(model.notices) - 1
            named = sorted(_placed({c for c in found if c[4] != general}, mine, grams, model))
            for start, stop, family, p, similar in named or sorted(_placed(found, mine, grams, model)):
                line = int(np.searchsorted(lines, start, "right")) - 1
                out.append((int(first + k), line, start - int(lines[line]), stop - int(lines[line]), family, p, similar))
    return out


def paragraphs_of(text: bytes) -> list[tuple[int, list[bytes]]]:
    """Runs of lines up to one without words, with the number of the first."""
    out, open_ = [], False
    for number, line in enumerate(text.split(b"\n")):
        if not _strip(line).strip():
            open_ = False
        elif open_:
            out[-1][1].append(line)
        else:
            out.append((number, [line]))
            open_ = True
    return out


def fit(docs: DataFrame, *, text: str = "text", windows: int = FIT_WINDOWS) -> LicenseModel:
    """Trained with a window each of about `windows` distinct texts, the first by hash, that name no licence. The window's place in its
    text is drawn by the hash, so that all parts of texts are learned from. A threshold on the hash goes first: no task sends more."""
    h, span = F.xxhash64(text), 1 << 40
    distinct = docs.agg(F.approx_count_distinct(h).alias("n")).first()["n"]
    drawn = docs.filter(F.col(text).isNotNull() & (F.pmod(h, F.lit(span)) < int(min(1.0, 1.5 * windows / max(1, distinct)) * span)))
    rows = drawn.filter(~F.col(text).rlike(NAMES)).select(h.alias("h"), F.split(F.col(text), r"[ \n]+").alias("w"))
    at = F.pmod(F.shiftright("h", 7), F.greatest(F.lit(1), F.size("w") - BLOCK)).cast("int") + 1
    few = rows.select("h", F.slice("w", at, F.lit(2 * BLOCK)).alias("w")).groupBy("h").agg(F.min("w").alias("w"))
    return train([" ".join(r["w"]).encode() for r in few.orderBy("h").limit(windows).collect()])


def scan_licenses(docs: DataFrame, model: LicenseModel, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, paragraph, word_from, word_to, family, score, similarity: one row per notice in a row of `docs`.

    `paragraph` is the number (from 0) of the line in which the notice starts; its words count from the start of that line and go on
    over line ends, up to a blank line. Whole texts are read. Null and empty texts have none, equal rows have equal results, an
    empty table gives none. A place in a text counts for one notice, the most similar. A paragraph that speaks of a licence, of none of
    the known families, gives rows of the family `unknown`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ddl = "doc_id long, found array<struct<paragraph: bigint, word_from: bigint, word_to: bigint, family: string, score: double, similarity: double>>"

    def make():
        def work(piece: pa.RecordBatch) -> dict:
            paragraphs, owner, number = [], [], []
            for i, t in enumerate(text_bytes(piece.column("text"))):
                for n, lines in paragraphs_of(t or b""):
                    paragraphs.append(lines), owner.append(i), number.append(n)
            found: list[list[dict]] = [[] for _ in range(piece.num_rows)]
            for k, line, a, b, family, score, similar in scan_paragraphs(paragraphs, shared.value):
                found[owner[k]].append({"paragraph": number[k] + line, "word_from": a, "word_to": b, "family": family, "score": score, "similarity": similar})
            return {"doc_id": piece.column("doc_id"), "found": found}
        return work

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_text(rows, "text", ddl, make).filter(F.size("found") > 0).select("doc_id", F.inline("found"))
