"""License scans: paragraphs classified by a sparse word n-gram logistic regression, confirmed by template comparison."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.common import texts

#: Phrases in which public licences name or grant themselves, by family. Templates of the comparison and
#: seeds of the training paragraphs. A family's order is by its usual name.
TEMPLATES = {
    "agpl": (
        "GNU Affero General Public License Version 3",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "artistic": (
        "The Artistic License 2.0",
        "SPDX-License-Identifier: Artistic-2.0",
        "This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    ),
    "boost": (
        "Boost Software License Version 1.0",
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD 3-Clause License",
        "BSD 2-Clause License",
    ),
    "busl": (
        "Business Source License 1.1",
        "SPDX-License-Identifier: BUSL-1.1",
        "The Licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the Licensed Work.",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc0": (
        "CC0 1.0 Universal",
        "SPDX-License-Identifier: CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "epl": (
        "Eclipse Public License Version 2.0",
        "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    ),
    "gfdl": (
        "GNU Free Documentation License Version 1.3",
        "SPDX-License-Identifier: GFDL-1.3-or-later",
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU General Public License Version 3",
        "GNU General Public License Version 2",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "isc": (
        "ISC License",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "lgpl": (
        "GNU Lesser General Public License Version 3",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
        "MIT License Copyright (c)",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License Version 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Proprietary and confidential. Unauthorised copying of this file is strictly prohibited.",
    ),
    "sspl": (
        "Server Side Public License VERSION 1",
        "SPDX-License-Identifier: SSPL-1.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "wtfpl": (
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2",
        "SPDX-License-Identifier: WTFPL",
    ),
    "zlib": (
        "The zlib/libpng License",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
        "SPDX-License-Identifier: Zlib",
    ),
}
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *TEMPLATES)
#: Bounds: hashed features, documents from which background runs of words are drawn, runs of each of them, words of a run.
FEATURES, SAMPLE_DOCS, SAMPLE_RUNS, SAMPLE_WORDS = 1 << 14, 400, 4, 40
#: Least probability of a family, and least similarity with one of its templates, for a paragraph to be reported as it.
LEAST_PROBABILITY, LEAST_SIMILARITY = 0.5, 0.5
#: What parts two blocks: a line of white space only.
_BLANK = re.compile(rb"\n(?:[ \t\r\f\v]*\n)+")
_WORD = re.compile(rb"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def _words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def tokens(paragraph: str) -> list[str]:
    return [w.decode() for w in _words(paragraph.encode("utf-8", "replace"))]


def features(words: list[str]) -> np.ndarray:
    """Distinct hashed word 1- to 3-grams."""
    grams = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    return np.unique(np.fromiter((zlib.crc32(g.encode()) % FEATURES for g in grams), np.int64, len(grams)))


#: Words and phrases that licences share: background runs with one of them aren't taken for the unknown class in training,
#: and lines with one that no family claims are counted as unknown. No text is skipped for want of them.
_HINT = re.compile(rb"(?i)licen[sc]e|copyright|rights reserved|spdx|redistribut|permission is|free software|creative commons|confidential")


def similarity(words: list[str], template: list[str]) -> float:
    """Share of the template's word pairs that the paragraph has, in any place."""
    pairs = lambda w: set(zip(["^", *w], w, strict=False))
    own, want = pairs(words), pairs(template)
    return len(own & want) / max(1, len(want))


def blocks(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the runs of lines between blank lines: a wrapped notice is in one of them."""
    at = 0
    for m in _BLANK.finditer(text):
        yield at, text[at : m.start()]
        at = m.end()
    yield at, text[at:]


class Pairs:
    """The word pairs of all templates, numbered, to count for each template how many of them a run of words has."""

    def __init__(self, templates: list[list[str]]):
        pairs = [sorted(set(zip(["^", *t], t, strict=False))) for t in templates]
        self.word = {w.encode(): k for k, w in enumerate(sorted({w for t in templates for w in t}), 1)}
        self.number = {q: k for k, q in enumerate(sorted({q for ps in pairs for q in ps}), 1)}
        self.sizes = np.array([len(ps) for ps in pairs])
        self.has = np.zeros((len(self.number) + 1, len(templates)), bool)
        self.inner = np.zeros((len(self.word) + 1, len(self.word) + 1), np.int64)
        self.first = np.zeros(len(self.word) + 1, np.int64)
        for (a, b), k in self.number.items():
            to = self.word[b.encode()]
            if a == "^":
                self.first[to] = k
            else:
                self.inner[self.word[a.encode()], to] = k
        for t, ps in enumerate(pairs):
            self.has[[self.number[q] for q in ps], t] = True

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.word.get, words, repeat(0)), np.int64, len(words))

    def within_reach(self, ids: np.ndarray) -> np.ndarray:
        """The templates of which the words hold enough pairs, wherever a run of them begins: no other can be confirmed."""
        seen = np.zeros(len(self.has), bool)
        seen[self.inner[ids[:-1], ids[1:]]] = True
        seen[self.first[ids]] = True
        seen[0] = False
        return np.flatnonzero(self.has[seen].sum(axis=0) >= LEAST_SIMILARITY * self.sizes)

    def windows(self, ids: np.ndarray, t: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, counts) of the windows of ``length`` words, cut short by the end only, that hold enough pairs of template ``t``."""
        at = np.flatnonzero(self.has[inner := self.inner[ids[:-1], ids[1:]], t]) + 1
        at = at[np.argsort(inner[at - 1], kind="stable")]
        pair = inner[at - 1]
        again = np.concatenate([[False], pair[1:] == pair[:-1]]) if len(at) else np.zeros(0, bool)
        start = np.maximum(0, at - length + 1)
        start[again] = np.maximum(start[again], at[:-1][again[1:]])
        change = np.bincount(start, minlength=len(ids) + 1) - np.bincount(at, minlength=len(ids) + 1)
        counts = np.cumsum(change)[: len(ids)] + self.has[self.first[ids], t]
        found = np.flatnonzero(counts >= LEAST_SIMILARITY * self.sizes[t])
        return found, counts[found]


class LicenceModel:
    """Multinomial logistic regression over hashed n-grams, with a temperature fitted on paragraphs left out of it."""

    def __init__(self, weights: np.ndarray, temperature: float):
        self.weights, self.temperature = weights, temperature
        self.templates = {k: [tokens(t) for t in ts] for k, ts in TEMPLATES.items()}
        self.flat = [(label, t) for label, family in enumerate(FAMILIES[1:], 1) for t in self.templates[family]]
        self.pairs = Pairs([t for _, t in self.flat])

    def within_reach(self, text: bytes) -> bool:
        """Whether a template could confirm any part of ``text``: a necessary condition, so that skipping the rest loses nothing."""
        return len(words := _words(text)) > 0 and len(self.pairs.within_reach(self.pairs.ids(words))) > 0

    def probabilities(self, words: list[str]) -> np.ndarray:
        f = features(words)
        z = (self.weights[f].sum(axis=0) / np.sqrt(max(1, len(f))) + self.weights[FEATURES]) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def score(self, words: list[str]) -> tuple[str, float, float]:
        """(family or unknown, probability, best template similarity) of all ``words`` at once: a family needs both its bounds."""
        p = self.probabilities(words)
        best = int(p.argmax())
        if best == 0 or p[best] < LEAST_PROBABILITY:
            return UNKNOWN, float(p[0]), 0.0
        near = max(similarity(words, t) for t in self.templates[FAMILIES[best]])
        return (FAMILIES[best] if near >= LEAST_SIMILARITY else UNKNOWN), float(p[best]), float(near)

    def windows(self, words: list[bytes]) -> list[tuple[int, int, str, float, float]]:
        """(first word, word behind the last, family, probability, similarity) of each notice among ``words``.

        Every template is laid on every word; the window of its length has to hold enough of its pairs and to be
        classified as its family. Of overlapping windows the one with the most pairs is a notice, which reaches from the
        first of its pairs to the last.
        """
        ids = self.pairs.ids(words)
        found = []
        for t in self.pairs.within_reach(ids) if len(ids) else ():
            starts, counts = self.pairs.windows(ids, t, len(self.flat[t][1]))
            found += zip((-counts).tolist(), starts.tolist(), repeat(int(t)), strict=False)
        out, taken = [], bytearray(len(words))
        for count, start, t in sorted(found):
            label, template = self.flat[t]
            own = words[start : start + len(template)]
            first, last = self._extent(ids[start : start + len(template)], t)
            if any(taken[start + first : start + last]):
                continue
            p = self.probabilities([w.decode() for w in own])
            if int(p.argmax()) == label and p[label] >= LEAST_PROBABILITY:
                taken[start + first : start + last] = b"\1" * (last - first)
                out.append((start + first, start + last, FAMILIES[label], float(p[label]), -count / int(self.pairs.sizes[t])))
        return sorted(out)

    def _extent(self, ids: np.ndarray, t: int) -> tuple[int, int]:
        at = np.flatnonzero(self.pairs.has[self.pairs.inner[ids[:-1], ids[1:]], t])
        starts = bool(self.pairs.has[self.pairs.first[ids[0]], t])
        return (0 if starts else int(at[0])), (int(at[-1]) + 2 if len(at) else 1)

    def notices(self, block: bytes) -> list[tuple[int, int, str, float, float]]:
        """(start, end, family, probability, similarity) of each notice of a block, in bytes.

        Windows come first. A line without any of theirs is scored as a whole, too, as a template's pairs may lie farther
        apart than the template is long.
        """
        if not self.within_reach(block):
            return []
        words, out = _words(block), []
        if found := self.windows(words):
            where = [m.span() for m in _WORD.finditer(block.lower())]
            out = [(where[i][0], where[j - 1][1], *rest) for i, j, *rest in found]
        taken, k, at = list(out), 0, 0
        for line in block.split(b"\n"):
            end = at + len(line)
            while k < len(taken) and taken[k][1] <= at:
                k += 1
            if not (k < len(taken) and taken[k][0] < end) and self.within_reach(line):
                got = self.score([w.decode() for w in _words(line)])
                if got[0] != UNKNOWN:
                    out.append((at, end, *got))
            at = end + 1
        return sorted(out)

    def classify(self, paragraph: str) -> tuple[str, float, float]:
        """(family or unknown, probability, similarity) of the paragraph's best notice, by similarity."""
        found = self.notices(paragraph.encode("utf-8", "replace"))
        return max((x[2:] for x in found), key=lambda x: (x[2], x[1]), default=None) or (UNKNOWN, float(self.probabilities(tokens(paragraph))[0]), 0.0)


def training_set(background: list[str], copies: int = 60, seed: int = 7) -> list[tuple[list[str], int]]:
    """Templates in disguise (words lost, changed, put among background words) against background paragraphs."""
    rng = np.random.default_rng(seed)
    plain = [w for p in background if not _HINT.search(p.encode()) for w in tokens(p)] or ["the", "of", "and"]
    plain = np.array(plain)  # once: each choice from a list would turn the whole list into an array
    out = [(tokens(p), 0) for p in background if not _HINT.search(p.encode())]
    for label, family in enumerate(FAMILIES[1:], 1):
        for t in TEMPLATES[family]:
            words = tokens(t)
            for k in range(copies):
                kept = [w for w in words if k < 4 or rng.random() > 0.08] or words
                around = [str(x) for x in rng.choice(plain, int(rng.integers(0, 25)))] if k % 2 else []
                at = int(rng.integers(0, len(around) + 1))
                out.append((around[:at] + kept + around[at:], label))
    # Licence-like talk that names no family teaches the unknown class.
    for words in (["license"], ["copyright"], ["the", "license", "of", "the", "software"], ["licensed", "under", "terms"], ["permission", "of", "the", "owner"], ["all", "rights"], ["all", "rights", "of"], ["released", "under", "the"], ["licensed", "under", "the"], ["this", "work", "is"], ["spdx-license-identifier"]):
        for _ in range(copies):
            out.append((words + [str(x) for x in rng.choice(plain, int(rng.integers(0, 12)))], 0))
    return out


def train(background: list[str], rounds: int = 80) -> LicenceModel:
    """Fit by full-batch gradient steps (Adam) on four fifths of the set, then the temperature on the last fifth."""
    data = training_set(background)
    rows = [features(w) for w, _ in data]
    labels = np.array([k for _, k in data])
    test = np.arange(len(data)) % 5 == 4
    use = np.array([i for i in np.flatnonzero(~test) if len(rows[i])])
    seen, column = np.unique(np.concatenate([rows[i] for i in use]), return_inverse=True)
    sizes = np.array([len(rows[i]) for i in use])
    # As the draw and the templates are bounded, so is this table of paragraphs by n-grams.
    x = np.zeros((len(use), len(seen)), np.float32)
    x[np.repeat(np.arange(len(use)), sizes), column] = np.repeat(1 / np.sqrt(sizes), sizes)
    goal = np.eye(len(FAMILIES))[labels[use]]
    share = 1 / np.bincount(labels[use], minlength=len(FAMILIES)).clip(1)
    weight = share[labels[use]][:, None] / len(FAMILIES)
    w, bias = np.zeros((len(seen), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, bias)]
    for k in range(1, rounds + 1):
        z = x @ w + bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        error = ((z / z.sum(axis=1, keepdims=True) - goal) * weight).astype(np.float32)
        for p, grad, (first, second) in zip((w, bias), (x.T @ error + np.float32(1e-5) * w, error.sum(axis=0)), moments, strict=True):
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            p -= 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    weights = np.zeros((FEATURES + 1, len(FAMILIES)))
    weights[seen], weights[FEATURES] = w, bias
    held = np.flatnonzero(test)
    logits = np.array([weights[rows[i]].sum(axis=0) / np.sqrt(max(1, len(rows[i]))) + weights[FEATURES] for i in held]).reshape(-1, len(FAMILIES))

    def loss(temperature: float) -> float:
        z = logits / temperature
        return float((np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) + z.max(axis=1) - z[np.arange(len(held)), labels[held]]).sum())

    best = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    return LicenceModel(weights, best)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LicenceModel:
    """Draw background paragraphs from the ``sample_docs`` texts with the least hashes of their ids, and train on them."""
    ids = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    word = F.split(F.trim("text"), r"\s+")
    n = F.size("words")
    # Runs begin at places spread over the whole text by hashes of the id, not at its head.
    runs = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_RUNS - 1)), lambda k: F.array_join(F.slice("words", F.pmod(F.xxhash64("doc_id", k), F.greatest(n - SAMPLE_WORDS + 1, F.lit(1))).cast("int") + 1, SAMPLE_WORDS), " "))
    drawn = docs.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id", "left_semi").select("doc_id", word.alias("words")).select("doc_id", runs.alias("p")).groupBy("doc_id").agg(F.min("p").alias("p")).collect()
    return train([p for r in sorted(drawn, key=lambda r: r["doc_id"]) for p in r["p"]])


_OUT = [("doc_id", pa.int64()), ("n_paragraphs", pa.int64()), ("n_hits", pa.int64()), ("n_unknown", pa.int64()), ("families", pa.list_(pa.string())), ("best_probability", pa.float64()), ("best_similarity", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("family", pa.string())])))]
SCHEMA = "doc_id bigint, n_paragraphs bigint, n_hits bigint, n_unknown bigint, families array<string>, best_probability double, best_similarity double, spans array<struct<start: bigint, end: bigint, family: string>>"


def unknown_lines(text: bytes, spans: list[dict]) -> int:
    """Lines that speak of a licence or of rights where no family was found: the unknown class, for a look by eye."""
    lines = {(text.rfind(b"\n", 0, m.start()) + 1) for m in _HINT.finditer(text)}
    edges = sorted((x["start"], x["end"]) for x in spans)
    count, k = 0, 0
    for at in sorted(lines):
        end = text.find(b"\n", at)
        end = len(text) if end < 0 else end
        while k < len(edges) and edges[k][1] <= at:
            k += 1
        count += not (k < len(edges) and edges[k][0] < end)
    return count


def _scan(batches: Iterator[pa.RecordBatch], model: LicenceModel) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, text in zip(b["doc_id"].to_pylist(), texts(b["text"]), strict=True):
            spans, p, s = [], 0.0, 0.0
            n = sum(bool(line.strip()) for line in text.split(b"\n"))
            for start, block in blocks(text) if model.within_reach(text) else ():
                for first, end, family, probability, near in model.notices(block):
                    spans.append({"start": start + first, "end": start + end, "family": family})
                    p, s = max(p, probability), max(s, near)
            rows.append((doc, n, len(spans), unknown_lines(text, spans), sorted({x["family"] for x in spans}), p, s, spans))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True) if rows else [()] * len(_OUT), _OUT, strict=True)], names=[k for k, _ in _OUT])


def scan(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): paragraphs, licence families found, and their byte spans.

    A paragraph counts as a line, but notices are sought in whole blocks, the lines between blank ones, as they may be
    wrapped. Templates are laid on every word of a block: the classifier tells the family of the window under one or
    unknown, and the template has to confirm it. A hit is a notice, of which a block can have several; ``n_unknown`` counts
    the lines with words of licences that are in no hit. Null and empty texts have no paragraphs and no hits; equal
    texts give equal rows; null ids stay null; an empty table gives no rows.
    """
    model = model or fit(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(lambda batches: _scan(batches, sent.value), SCHEMA)


def licence_report(docs: DataFrame) -> DataFrame:
    """op3: the families of each document as one string, with counts and the best scores; rows are as in ``scan``."""
    return scan(docs).select("doc_id", "n_paragraphs", "n_hits", "n_unknown", F.concat_ws(",", "families").alias("families"), F.round("best_probability", 6).alias("best_probability"), F.round("best_similarity", 6).alias("best_similarity"))
