"""Licence scan: a paragraph classifier names the family, template comparison confirms it.

A document's paragraphs are its lines, and, since a notice may be wrapped, two
neighbouring lines together where one of them looks like a notice, not both are
confirmed, and together they name another family than either does.  A softmax regression (numpy) on word 1- and 2-grams, kept
sparse by taking only those that occur in some template, is trained on the
sentences and names of licences, altered by dropping, adding and changing words
and by words that announce a licence, and on ordinary lines as the class unknown.
Those are lines of the ``UNKNOWN_DOCS`` documents with the smallest hash of their
id (a parameter; at most ``UNKNOWN_LINES`` of their lines of ``LINE_CHARS``
characters or less, by hash), without lines that resemble a template.  A
temperature fitted on held-out examples calibrates the probabilities.  A
paragraph's family is confirmed if it is not unknown, its probability reaches
``THRESHOLD``, and at least ``CONTAINED`` of the paragraph's word 2-grams, if it
has ``LEAST_PAIRS``, occur in the family's texts, or all 2-grams of one of the family's texts in the paragraph.

Every line of every document is classified, whole, however long it is.  Defined
results: null and empty texts have no paragraphs; lines without words are none;
repeated rows give repeated results; other columns than doc_id and text are not
read; with an empty table the unknown class is trained on made-up lines alone.
"""

from __future__ import annotations

import random
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import ALNUM, hashed, mixed, sliced
from .storage import table

UNKNOWN_DOCS = 300
UNKNOWN_LINES = 3000
LINE_CHARS = 2000
VARIANTS = 24
THRESHOLD = 0.5
CONTAINED = 0.5
LEAST_PAIRS = 4
UNKNOWN = "unknown"
_FILLED = re.compile(rb"[0-9A-Za-z\x80-\xff]")

#: Names of common licences and sentences of their texts and notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "The MIT License (MIT)",
        "the MIT License",
        "This software is distributed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1",
    ),
    "agpl": (
        "GNU Affero General Public License, version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0",
    ),
    "mpl": (
        "Mozilla Public License, version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Creative Commons Attribution 4.0 International (CC BY 4.0)",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Creative Commons Attribution-ShareAlike 4.0 International (CC BY-SA 4.0)",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Creative Commons Attribution-NonCommercial 4.0 International (CC BY-NC 4.0)",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc0": (
        "CC0 1.0 Universal Public Domain Dedication",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "proprietary": (
        "All rights reserved",
        "Unauthorized copying of this file is strictly prohibited.",
        "Proprietary and confidential. No part may be reproduced without written permission.",
    ),
}
#: What may stand before a licence's name.
_BEFORE = ("", "licensed under the", "released under the", "licensed under", "this work is licensed under the", "available under", "distributed under the terms of the", "covered by the", "see the")
FAMILIES = (UNKNOWN, *TEMPLATES)


def _grams(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of every word 1- and 2-gram."""
    row = np.searchsorted(ends, np.arange(len(words)), side="right")
    same = row[1:] == row[:-1]
    pairs = mixed(words[:-1] * np.uint64(3) + words[1:] * np.uint64(5))[same]
    return np.concatenate([row, row[1:][same]]), np.concatenate([words, pairs])


class Model(NamedTuple):
    names: np.ndarray  # sorted hashes of the templates' n-grams
    likely: np.ndarray  # whether the low bits of a hash are those of a name
    weights: np.ndarray  # names by families
    bias: np.ndarray
    temperature: float
    known: dict[str, np.ndarray]  # sorted 2-grams of each family's texts
    sentences: dict[str, list[np.ndarray]]


_LOW = np.uint64((1 << 16) - 1)


def _names() -> tuple[np.ndarray, np.ndarray]:
    texts = [t.encode() for own in TEMPLATES.values() for t in own]
    names = np.unique(np.concatenate([_grams(words, ends)[1] for _, words, ends in hashed(texts, ALNUM)]))
    likely = np.zeros(1 << 16, bool)
    likely[(names & _LOW).astype(np.int64)] = True
    return names, likely


def _columns(lines: list[bytes], names: np.ndarray, likely: np.ndarray):
    """For groups of lines: how many, row and name of their known n-grams by row, a row's scale, words and where each line's end."""
    for n, words, ends in hashed(lines, ALNUM):
        row, value = _grams(words, ends)
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))
        at = np.flatnonzero(likely[(value & _LOW).astype(np.int64)])
        place = np.minimum(np.searchsorted(names, value[at]), len(names) - 1)
        hit = names[place] == value[at]
        row, place = row[at][hit], place[hit]
        order = np.argsort(row, kind="stable")
        yield n, row[order], place[order], scale, words, ends


def _sums(values: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of values that have equal numbers, which are sorted."""
    out = np.zeros((n, values.shape[1]))
    if len(by):
        first = np.flatnonzero(np.diff(by, prepend=-1))
        out[by[first]] = np.add.reduceat(values, first)
    return out


def _pairs(words: np.ndarray) -> np.ndarray:
    return np.unique(mixed(words[:-1] * np.uint64(3) + words[1:] * np.uint64(5)))


def _templates() -> tuple[dict[str, np.ndarray], dict[str, list[np.ndarray]]]:
    own = {}
    for family, sentences in TEMPLATES.items():
        own[family] = [_pairs(words) for s in sentences for _, words, _ in hashed([s.encode()], ALNUM)]
    return {f: np.unique(np.concatenate(x)) for f, x in own.items()}, own


def _examples(ordinary: list[str], variants: int, seed: int) -> tuple[list[bytes], np.ndarray]:
    rnd = random.Random(seed)
    filler = [w for line in ordinary for w in line.split()] or ["lorem", "ipsum", "dolor", "sit", "amet"]
    lines, y = [], []
    for k, family in enumerate(FAMILIES):
        for s in TEMPLATES.get(family, ()):
            for v in range(variants):
                w = s.split()
                if len(w) < 9 and not s.startswith("SPDX"):  # a name
                    w = _BEFORE[v % len(_BEFORE)].split() + w
                    # Some is often left out of a name in several parts.
                    if "(" in s and v % 2:
                        w = _BEFORE[v % len(_BEFORE)].split() + s[s.index("(") + 1 : -1].split()
                if v:
                    w = [x for x in w if rnd.random() > 0.06]
                    for _ in range(rnd.choice([0, 0, 1, 3])):
                        w.insert(rnd.choice([0, len(w)]), rnd.choice(filler))
                lines.append(" ".join(w).encode())
                y.append(k)
    made_up = [" ".join(rnd.choices(filler, k=rnd.randint(1, 30))) for _ in range(400)]
    made_up += ["the license plate of the car was lost", "he is a licensed doctor", "open source of the river", "version 2.0 of the plan", "a work of art under the bridge", "driving licence renewal form"] * 8
    for line in [*ordinary, *made_up]:
        lines.append(line.encode())
        y.append(0)
    return lines, np.array(y)


def fit(ordinary: list[str], variants: int = VARIANTS, steps: int = 200, seed: int = 0) -> Model:
    """Softmax regression by full-batch steps with adaptive rates; every fourth example is for the temperature."""
    known, sentences = _templates()
    names, likely = _names()
    lines, y = _examples(ordinary, variants, seed)
    rows, cols, scales, at = [], [], [], 0
    for n, row, col, scale, _, _ in _columns(lines, names, likely):
        rows.append(row + at)
        cols.append(col)
        scales.append(scale)
        at += n
    row, col, scale = np.concatenate(rows), np.concatenate(cols), np.concatenate(scales)[:, None]
    by_name = np.argsort(col, kind="stable")
    m, k = len(lines), len(FAMILIES)
    test = np.arange(m) % 4 == 3
    w, b, seen = np.zeros((len(names), k)), np.zeros(k), np.full((len(names), k), 1e-8)
    target = np.eye(k)[y]
    share = np.where(test, 0, 1.0)[:, None] / np.maximum(1, np.bincount(y, minlength=k))[y][:, None]

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for _ in range(steps):
        g = (softmax(_sums(w[col], row, m) * scale + b) - target) * share
        grad = _sums((g * scale)[row[by_name]], col[by_name], len(names)) + 1e-5 * w
        seen += grad**2
        w -= 0.3 * grad / np.sqrt(seen)
        b -= 0.5 * g.sum(0)
    z = (_sums(w[col], row, m) * scale + b)[test]
    loss = {t: -np.log(softmax(z / t)[np.arange(len(z)), y[test]] + 1e-12).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0)}
    return Model(names, likely, w, b, min(loss, key=loss.get), known, sentences)


def _resembles(line: str, known: dict[str, np.ndarray]) -> bool:
    for _, words, _ in hashed([line.encode()], ALNUM):
        pairs = _pairs(words)
        return len(pairs) > 0 and any(np.isin(pairs, x).mean() >= 0.3 for x in known.values())
    return False


def train(docs: DataFrame, unknown_docs: int = UNKNOWN_DOCS, unknown_lines: int = UNKNOWN_LINES) -> Model:
    few = docs.where("text is not null and doc_id is not null").select("doc_id").orderBy(F.xxhash64(F.lit(17), "doc_id")).limit(unknown_docs)
    marks = docs.sparkSession.createDataFrame([tuple(r) for r in few.collect()], few.schema)  # at most unknown_docs ids
    few = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    lines = few.select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line").between(1, LINE_CHARS))
    lines = lines.orderBy(F.xxhash64("line"), "line").limit(unknown_lines)  # examples only
    known, _ = _templates()
    return fit(sorted(r.line for r in lines.collect() if not _resembles(r.line, known)))


def classify(lines: list[bytes], model: Model) -> list[tuple[int, int, float, bool]]:
    """(line, family, probability, confirmed) of the lines that are not unknown."""
    out, at = [], 0
    for n, row, col, scale, words, ends in _columns(lines, model.names, model.likely):
        z = _sums(model.weights[col], row, n) * scale[:, None] + model.bias
        best = z.argmax(1)
        filled = np.diff(ends, prepend=0) > 0
        for i in np.flatnonzero((best > 0) & filled):
            e = np.exp((z[i] - z[i].max()) / model.temperature)
            p = float(e[best[i]] / e.sum())
            family = FAMILIES[best[i]]
            own = words[ends[i - 1] if i else 0 : ends[i]]
            pairs = _pairs(own)
            inside = len(pairs) >= LEAST_PAIRS and np.isin(pairs, model.known[family]).mean() >= CONTAINED
            around = any(len(s) > 1 and np.isin(s, pairs).all() for s in model.sentences[family])
            out.append((at + int(i), int(best[i]), p, bool(p >= THRESHOLD and (inside or around))))
        at += n
    return out


def notices(texts: list[bytes | None], model: Model) -> tuple[list[int], list[list[tuple[str, int, int]]]]:
    """How many paragraphs each text has, and of the confirmed ones family, first and last line."""
    lines, owner, number, count = [], [], [], []
    for i, text in enumerate(texts):
        own = [(k, x) for k, x in enumerate((text or b"").split(b"\n")) if _FILLED.search(x)]
        count.append(len(own))
        lines += [x for _, x in own]
        number += [k for k, _ in own]
        owner += [i] * len(own)
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    near, sure = set(), {}
    for line, family, _, confirmed in classify(lines, model):
        near.add(line)
        if confirmed:
            sure[line] = family
    # Two lines without one between them, not both confirmed, one of them like a notice.
    firsts = sorted({k for x in near for k in (x - 1, x) if 0 <= k < len(lines) - 1})
    firsts = [k for k in firsts if owner[k] == owner[k + 1] and number[k] + 1 == number[k + 1]]
    firsts = [k for k in firsts if not (k in sure and k + 1 in sure)]
    taken = -1
    for j, family, _, confirmed in classify([lines[k] + b" " + lines[k + 1] for k in firsts], model) if firsts else ():
        k = firsts[j]
        if confirmed and k > taken and family not in (sure.get(k), sure.get(k + 1)):
            sure.pop(k, None)
            sure.pop(k + 1, None)
            found[owner[k]].append((FAMILIES[family], number[k], number[k + 1]))
            count[owner[k]] -= 1
            taken = k + 1
    for line, family in sure.items():
        found[owner[line]].append((FAMILIES[family], number[line], number[line]))
    return count, found


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs, n_licences, families, spans: confirmed families in alphabetical order, and family:line (or family:first-last) of each paragraph."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shown = lambda f, a, b: f"{f}:{a}" if a == b else f"{f}:{a}-{b}"

    def run(batches):
        for batch in sliced(batches):
            count, found = notices(batch.column(1).cast(pa.binary()).to_pylist(), shared.value)
            cols = [
                batch.column(0),
                pa.array(count, pa.int64()),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([",".join(sorted({f for f, _, _ in x})) for x in found], pa.string()),
                pa.array([",".join(shown(*s) for s in sorted(x)) for x in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_paragraphs", "n_licences", "families", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_paragraphs long, n_licences long, families string, spans string")


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))


QUERIES = {"op5_licence_scan": op5_licence_scan}
ORACLES: dict[str, str] = {}
