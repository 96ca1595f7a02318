"""Licence notices, found by a trained paragraph classifier and confirmed by templates.

A multinomial logistic regression over sparse word 1- to 3-grams names the licence
family of a paragraph, or none. It is trained on variants of the templates below and on
paragraphs of the corpus; a temperature, fitted on samples kept apart, calibrates its
probabilities, that of ``UNKNOWN`` included. Where it names any family, the templates of all
are looked for; a notice is confirmed by four fifths of a template's 5-word shingles.

Notices are often wrapped, and may share a paragraph: lines without a blank one between
them are read both one by one and joined, and each notice bears the number of the line in
which it begins.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Set
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import durable

UNKNOWN = "unknown"
# Notices that the licences themselves ask for, or that are commonly written.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.", "under the Apache 2.0 license", "and the Apache 2.0 license", "or the Apache 2.0 license",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.", "under the BSD license", "and the BSD license", "or the BSD license",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-2-Clause", "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "bsl": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0",
    ],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal public domain dedication.", "This work is dedicated to the public domain under CC0.", "SPDX-License-Identifier: CC0-1.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GPL, version 2 or later.", "under the GPL", "under the GNU General Public License",
        "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Released under the MIT License.", "This project is licensed under the MIT license.", "under the MIT license", "and the MIT license", "or the MIT license", "is open under MIT terms", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved. No part of this work may be reproduced without written permission.", "Copyright by the authors. All rights reserved.", "All rights reserved.", "This document is confidential and proprietary and may not be distributed."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
}
# Uses of the same words that are no notice.
OTHER = [
    "The driver lost his license after the accident.", "A license is needed to fish in this lake.", "The version of the story that the general public knows is free of details.",
    "She asked for permission to use the source of the river.", "The court granted the copyright claim, with costs.", "Public domain software was common at the time.",
    "The foundation gave a commons to the village, free of charge.", "Students may not use this room without permission.", "They licensed the technology to a competitor under a new contract.",
]
#: Stretches of the corpus, those with the least hashes, and variants of each template to train on.
PARAGRAPHS, VARIANTS = 3000, 60
#: Words in a shingle, and the part of a template's shingles that confirms it.
SHINGLE, CONFIRM = 5, 0.8
#: Parts of the hashes that are sorted by themselves.
PARTS = 8
#: Calibrated probability of all families together from which a stretch is of some, and of one from which it is named.
SURE, NAMED = 0.5, 0.25
#: A longer paragraph is looked at in overlapping stretches of so many words.
STRETCH = 24
TOKEN = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def grams(words: list[str]) -> list[str]:
    return [*words, *map(" ".join, zip(words, words[1:])), *map(" ".join, zip(words, words[1:], words[2:]))]


def grams_within(words: list[str], some: Set[str]) -> list[str]:
    """The 1- to 3-grams of which all words are among ``some``: most texts have few, which saves making the others."""
    out, before, last = [], "", ""
    for w in words:
        if w not in some:
            before = last = ""
            continue
        out.append(w)
        if last:
            out.append(f"{last} {w}")
            if before:
                out.append(f"{before} {last} {w}")
        before, last = last, w
    return out


def paragraphs(text: str | None) -> list[list[str]]:
    """The tokens of each line that has any."""
    return [words for line in (text or "").split("\n") if (words := tokens(line))]


def blocks(text: str | None) -> Iterator[list[list[str]]]:
    """The tokens of lines, those together that no line without tokens parts."""
    held: list[list[str]] = []
    for line in (text or "").split("\n"):
        if words := tokens(line):
            held.append(words)
        elif held:
            yield held
            held = []
    if held:
        yield held


def stretches(words: list[str]) -> Iterator[list[str]]:
    """A paragraph, or overlapping stretches of a longer one."""
    for at in range(0, max(1, len(words) - STRETCH // 2), STRETCH // 2):
        yield words[at : at + STRETCH]


def shingles(words: list[str]) -> set[tuple]:
    return set(zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else {tuple(words)}


_TEMPLATE_SHINGLES = {family: [(shingles(w), len(w)) for w in map(tokens, texts)] for family, texts in TEMPLATES.items()}


def similarity(words: list[str], family: str) -> float:
    """The largest part of a template's shingles that the words hold. A template of less than five words is one shingle of its own length."""
    best, own = 0.0, shingles(words)
    for wanted, length in _TEMPLATE_SHINGLES[family]:
        have = own if length >= SHINGLE else set(zip(*(words[k:] for k in range(length))))
        best = max(best, len(wanted & have) / len(wanted))
    return best


#: The templates, and where each shingle of theirs stands: (template, place).
_LISTED = [(family, tokens(t)) for family, texts in TEMPLATES.items() for t in texts]
_TAG = "spdx-license-identifier"
_TAGGED = {words[1]: family for family, words in _LISTED if words[0] == _TAG}


def _places() -> dict[int, dict[tuple, list[tuple[int, int]]]]:
    """By length of shingle."""
    out: dict[int, dict[tuple, list[tuple[int, int]]]] = {}
    for t, (_, words) in enumerate(_LISTED):
        if words[0] == _TAG:
            continue
        n = min(SHINGLE, len(words))
        for k, shingle in enumerate(zip(*(words[j:] for j in range(n)))):
            out.setdefault(n, {}).setdefault(shingle, []).append((t, k))
    return out


_SHINGLE_PLACES = _places()


def _tagged(words: list[str]) -> Iterator[tuple[str, float, list[int]]]:
    """The identifiers that a tag lists, with or, and, with between them."""
    for k, word in enumerate(words):
        if word == _TAG:
            for j in range(k + 1, len(words)):
                if family := _TAGGED.get(words[j]):
                    yield family, 1.0, [k, j] if j == k + 1 else [j]
                elif words[j] not in ("or", "and", "with"):
                    break


def notices(words: list[str]) -> list[tuple[str, float, list[int]]]:
    """Family, similarity and places in the words of each notice that a template confirms, in their order. Words are used once, by the most similar template and then the longest.

    One pass over the words has the hits of each template; a run of them ends where a shingle comes again, or
    twice the template's length and a stretch after it began.
    """
    hits: dict[int, list[tuple[int, int]]] = {}
    for n, places in _SHINGLE_PLACES.items():
        for k, shingle in enumerate(zip(*(words[j:] for j in range(n)))):
            for t, at in places.get(shingle, ()):
                hits.setdefault(t, []).append((k, at))
    proposed = [(like, len(places), family, places) for family, like, places in _tagged(words)]
    for t, found in hits.items():
        family, wanted = _LISTED[t]
        n = min(SHINGLE, len(wanted))
        total, run = len(wanted) - n + 1, {}
        for k, at in [*found, (len(words) + 3 * len(wanted) + STRETCH, -1)]:
            if run and (at in run or k > min(run.values()) + 2 * len(wanted) + STRETCH):
                if (like := len(run) / total) >= CONFIRM:
                    proposed.append((like, len(run), family, sorted({p + j for p in run.values() for j in range(n)})))
                run = {}
            run[at] = k
    claimed, kept = bytearray(len(words)), []
    for like, _, family, places in sorted(proposed, key=lambda x: (-x[0], -len(x[3]), x[3])):
        if not any(claimed[k] for k in places):
            for k in places:
                claimed[k] = 1
            kept.append((family, like, places))
    return sorted(kept, key=lambda x: x[2])


def _variants(rng: np.random.Generator, words: list[str], around: list[list[str]]) -> list[str]:
    """Some words left out, and sometimes other text before or after."""
    out = [w for w in words if rng.random() > 0.08]
    if rng.random() < 0.3 and around:
        out = around[rng.integers(len(around))][: rng.integers(1, 12)] + out
    if rng.random() < 0.3 and around:
        out = out + around[rng.integers(len(around))][: rng.integers(1, 12)]
    return out


@dataclass
class Model:
    """``place`` numbers the n-grams that count; the classes are the families in order, and UNKNOWN last."""

    place: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def __post_init__(self) -> None:
        self.words = frozenset(w for g in self.place for w in g.split(" "))

    def vector(self, words: list[str]) -> Counter:
        return Counter(k for g in grams_within(words, self.words) if (k := self.place.get(g)) is not None)

    def probabilities(self, words: list[str]) -> np.ndarray | None:
        """None if no n-gram counts, which leaves UNKNOWN."""
        if self.words.isdisjoint(words) or not (some := self.vector(words)):
            return None
        x = np.fromiter(some.values(), float) / np.sqrt(len(words))
        z = (x @ self.weights[list(some)] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def of(self, text: str | None) -> tuple[int, list[dict]]:
        """How many lines with words a text has, and all notices in it: those confirmed, and families named without."""
        found, n = [], 0
        for block in blocks(text):
            found += [{"paragraph": n + line, **rest} for line, rest in self._in_block(block)]
            n += len(block)
        return n, found

    def _named(self, words: list[str], base: int) -> list[tuple[int, int, np.ndarray]]:
        """First and last place, and probabilities, of the stretches that are of some family, by place."""
        parts = ((base + k * (STRETCH // 2), part, self.probabilities(part)) for k, part in enumerate(stretches(words)))
        return [(at, at + len(part), p) for at, part, p in parts if p is not None and 1 - p[-1] >= SURE]

    def _in_block(self, block: list[list[str]]) -> list[tuple[int, dict]]:
        begins = np.cumsum([0, *map(len, block)])
        line_of = lambda k: int(np.searchsorted(begins, k, "right")) - 1
        words = [w for line in block for w in line]
        if self.words.isdisjoint(words):
            return []
        singly = [x for k, line in enumerate(block) for x in self._named(line, int(begins[k]))]
        joined = self._named(words, 0) if len(block) > 1 else []
        stretched = sorted([*singly, *joined], key=lambda x: x[:2])
        # a notice may reach beyond the stretches that name it: to the ends of their lines, and a stretch further
        wide: list[list[int]] = []
        for a, b in sorted((max(0, min(a - STRETCH, int(begins[line_of(a)]))), min(len(words), max(b + STRETCH, int(begins[line_of(b - 1) + 1])))) for a, b, _ in stretched):
            if wide and a <= wide[-1][1]:
                wide[-1][1] = max(wide[-1][1], b)
            else:
                wide.append([a, b])
        starts = [a for a, _, _ in stretched]
        found: list[tuple[int, int, dict]] = []
        held: set[tuple[int, str]] = set()
        for a, b in wide:
            for family, like, places in notices(words[a:b]):
                first, last, k = a + places[0], a + places[-1], FAMILIES.index(family)
                held.update((line_of(a + x), family) for x in places)
                near = stretched[bisect_left(starts, first - STRETCH) : bisect_right(starts, last)] or stretched
                found.append((line_of(first), first, {"family": family, "probability": max(float(p[k]) for *_, p in near), "similarity": like, "confirmed": True}))
        for a, b, p in stretched:
            lines = range(line_of(a), line_of(b - 1) + 1)
            for k in np.flatnonzero(p[:-1] >= NAMED):
                family = FAMILIES[k]
                if not any((x, family) in held for x in lines):
                    held.update((x, family) for x in lines)
                    text = words[a:b] if len(lines) > 1 else block[lines[0]][max(0, a - int(begins[lines[0]]) - STRETCH) : b - int(begins[lines[0]]) + STRETCH]
                    found.append((lines[0], a, {"family": family, "probability": float(p[k]), "similarity": similarity(text, family), "confirmed": False}))
        return [(line, item) for line, _, item in sorted(found, key=lambda x: (x[0], x[2]["family"], x[1]))]


FAMILIES = sorted(TEMPLATES)


CANDIDATES = frozenset(g for texts in TEMPLATES.values() for t in texts for g in grams(tokens(t)))
_CANDIDATE_WORDS = frozenset(g for g in CANDIDATES if " " not in g)


_FIRST = frozenset(s for templates in _TEMPLATE_SHINGLES.values() for wanted, n in templates if n >= SHINGLE for s in wanted)
_SHORT = [min(wanted) for templates in _TEMPLATE_SHINGLES.values() for wanted, n in templates if n < SHINGLE]


def _plain(words: list[str]) -> bool:
    if _FIRST.isdisjoint(shingles(words)) and not any(set(s) <= set(words) for s in _SHORT):
        return True
    return not any(similarity(words, f) >= CONFIRM for f in FAMILIES)


def gram_counts(texts: Iterable[str | None], sample: int = 0) -> tuple[int, Counter, dict[int, str]]:
    """The number of stretches that no template confirms, of those with each n-gram of the templates, and of those the ``sample`` with the least hashes, by hash."""
    total, counts, least, bound = 0, Counter(), {}, 1 << 64
    for text in texts:
        for words in (part for line in paragraphs(text) for part in stretches(line)):
            some = _CANDIDATE_WORDS.intersection(words)
            if len(some) >= 2 and not _plain(words):  # no template has fewer words
                continue
            total += 1
            if some:
                counts.update(CANDIDATES.intersection(grams_within(words, _CANDIDATE_WORDS)))
            if sample and (h := xxh64_intdigest(joined := " ".join(words))) < bound:
                least[h] = joined
                if len(least) >= 2 * sample:
                    least = dict(sorted(least.items())[:sample])
                    bound = max(least)
    return total, counts, dict(sorted(least.items())[:sample])


def corpus_counts(docs: DataFrame, sample: int = PARAGRAPHS) -> tuple[set[str], list[list[str]]]:
    """The n-grams of templates that are in over 1 % of all stretches of all documents but for notices, and the words of the ``sample``
    such stretches with the least hashes, each once: one pass over all texts, of any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts, least = 0, Counter(), {}
        for b in batches:
            n, some, few = gram_counts((t.as_py() for t in b.column(0)), sample)
            total += n
            counts.update(some)
            least = dict(sorted((least | few).items())[:sample])
        hashes = [h - (1 << 63) for h in least]  # in the same order as signed numbers
        yield pa.RecordBatch.from_arrays([pa.array(["", *counts, *least.values()]), pa.array([total, *counts.values(), *hashes], pa.int64()), pa.array([True] * (1 + len(counts)) + [False] * len(least))], ["gram", "n", "counted"])

    made = durable(docs.select("text").mapInArrow(run, "gram string, n long, counted boolean"))
    n = {r.gram: r.n for r in made.where("counted").groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # as many as the templates have
    # each task's sample is cut to that of its part of the hashes first, so that the driver gets as much from any number of tasks
    order = W.partitionBy(F.pmod("n", F.lit(PARTS))).orderBy("n", "gram")
    least = made.where("not counted").select("n", "gram").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    few = least.select("n", "gram").orderBy("n", "gram").limit(sample).collect()
    return {g for g, k in n.items() if g and k > 0.01 * n[""]}, [r.gram.split(" ") for r in few]


def common_grams(docs: DataFrame) -> set[str]:
    return corpus_counts(docs, 1)[0]


def fit_texts(corpus: list[list[str]], common: set[str], rounds: int = 250, ridge: float = 1e-4) -> Model:
    """Trained on template variants, the sentences in OTHER, and paragraphs of the corpus that no template confirms; n-grams in ``common`` don't count."""
    rng = np.random.default_rng(11)
    plain = [w for w in corpus if _plain(w)]
    known = [(tokens(t), k) for k, f in enumerate(FAMILIES) for t in TEMPLATES[f]]
    rows = [(w, k) for w, k in known for _ in range(5)] + [(_variants(rng, w, plain), k) for w, k in known for _ in range(VARIANTS)]
    rows += [(w, len(FAMILIES)) for w in plain] + [(tokens(t), len(FAMILIES)) for t in OTHER for _ in range(10)]
    rows = [(w, k) for w, k in rows if w]
    vocabulary = sorted(CANDIDATES - common)
    model = Model({g: i for i, g in enumerate(vocabulary)}, np.zeros((len(vocabulary), len(FAMILIES) + 1)), np.zeros(len(FAMILIES) + 1))
    x, y = np.zeros((len(rows), len(vocabulary)), np.float32), np.array([k for _, k in rows])
    for i, (words, _) in enumerate(rows):
        for k, n in model.vector(words).items():
            x[i, k] = n / np.sqrt(len(words))
    apart = rng.random(len(rows)) < 0.2
    a, target = x[~apart], np.eye(len(FAMILIES) + 1, dtype=np.float32)[y[~apart]]
    w, b = np.zeros((len(vocabulary), len(FAMILIES) + 1), np.float32), np.zeros(len(FAMILIES) + 1, np.float32)
    dw, db = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):  # gradient descent with momentum
        z = a @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        dw, db = 0.9 * dw - 4 * (a.T @ (p - target) / len(a) + ridge * w), 0.9 * db - 4 * (p - target).mean(0)
        w, b = w + dw, b + db
    model.weights, model.bias = w.astype(float), b.astype(float)
    z = x[apart] @ w + b

    def loss(t: float) -> float:
        s = z / t - (z / t).max(1, keepdims=True)
        return float(-(s[np.arange(len(s)), y[apart]] - np.log(np.exp(s).sum(1))).mean())

    model.temperature = min(np.geomspace(0.25, 4, 33), key=loss)
    return model


def fit(docs: DataFrame, sample: int = PARAGRAPHS) -> Model:
    """Other text is ``sample`` stretches of the corpus; which n-grams are too common is counted over all documents."""
    common, corpus = corpus_counts(docs, sample)
    return fit_texts(corpus, common)


def scan(df: DataFrame, model: Model, text: str = "text", out: str = "licences") -> DataFrame:
    """Adds ``out`` struct: n_paragraphs (lines with words), and ``found``, an array with the paragraph it begins in, family, probability, similarity and confirmed of each notice.

    Null and empty texts have no paragraphs; ids don't count, and rows that come again are read again. All other columns stay; there is no shuffle. The model, of a fixed size, is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    item = pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())])

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            got = [shared.value.of(t.as_py()) for t in texts]
            yield pa.array([{"n_paragraphs": n, "found": f} for n, f in got], pa.struct([("n_paragraphs", pa.int64()), ("found", pa.list_(item))]))

    kind = "struct<n_paragraphs:long,found:array<struct<paragraph:int,family:string,probability:double,similarity:double,confirmed:boolean>>>"
    return df.withColumn(out, F.arrow_udf(of, kind)(F.col(text)))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: paragraphs, notices named and confirmed, and the confirmed families in order, comma-joined."""
    got = scan(docs.select("doc_id", "text"), fit(docs), out="x")
    confirmed = F.filter("x.found", lambda f: f["confirmed"])
    families = F.array_join(F.array_sort(F.array_distinct(F.transform(confirmed, lambda f: f["family"]))), ",")
    return got.select("doc_id", "x.n_paragraphs", F.size("x.found").cast("long").alias("n_named"), F.size(confirmed).cast("long").alias("n_confirmed"), families.alias("families"))
