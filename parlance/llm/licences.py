"""Licence scan: a paragraph classifier on sparse word n-grams, an unknown class, and comparison with templates.

A paragraph is a line that holds a word, or several lines in a row without an empty one between them, as licence texts are
wrapped. Multinomial logistic regression over hashed one- and two-word features is trained
here on the templates below, on damaged copies of them, and on a bounded sample of the corpus as the unknown class; its
temperature is set on held-out rows. A family is reported for a paragraph if its probability passes the threshold and a
template of that family confirms it: enough of the template's word pairs stand in the paragraph. Paragraphs that no template could confirm are not
classified, which changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8
from .textvec import Words

#: Short public licence phrases by family.
TEMPLATES = {
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.", "This program is free software under the terms of the GNU Affero General Public License as published by the Free Software Foundation."),
    "apache": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"),
    "bsd": ("Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "SPDX-License-Identifier: BSD-3-Clause"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0": ("Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License.", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software under the terms of the GNU Lesser General Public License."),
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "SPDX-License-Identifier: MIT"),
    "mpl": ("Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "proprietary": ("All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
    "unlicense": ("Released under the Unlicense.", "This is free and unencumbered software released into the public domain."),
}
UNKNOWN = "unknown"
#: The GNU notices share most of their words: a run of lines is one of these only with a word of its name.
NAMED = {"agpl": {b"affero"}, "lgpl": {b"lesser", b"library"}}
FAMILIES = (*TEMPLATES, UNKNOWN)
BUCKETS = 1 << 14
#: Punctuation that a word may carry at its ends.
_EDGE = b".,;:!?()[]{}<>\"'`*#$%&|/\\-_=+~"


def normal(text: bytes) -> bytes:
    """Lower-case words without punctuation at their ends, joined by one space."""
    return b" ".join(w for w in (p.strip(_EDGE) for p in text.lower().split()) if w)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each one- and two-word feature of normalised texts."""
    words = Words(texts)
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n)
    pair = at[:-1][words.text[:-1] == words.text[1:]]
    both = np.concatenate([words.hash, words.runs(pair, pair + 2)])
    return np.concatenate([words.text, words.text[pair]]), (both & np.uint64(BUCKETS - 1)).astype(np.int64)


class Classifier:
    """Sparse weights (buckets, families), bias, temperature."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.weights, self.bias, self.temperature = weights, bias, temperature
        self.pairs = {f: [_pairs(normal(t.encode())) for t in TEMPLATES[f]] for f in TEMPLATES}

    def logits(self, texts: list[bytes]) -> np.ndarray:
        text, bucket = features(texts)
        size = np.bincount(text, minlength=len(texts)).clip(1)
        out = np.stack([np.bincount(text, self.weights[bucket, c], len(texts)) for c in range(len(FAMILIES))], 1)
        return out / np.sqrt(size)[:, None] + self.bias

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        z = self.logits(texts) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def similarity(self, family: str, text: bytes) -> float:
        """The largest share of a template's word pairs that the text holds."""
        own = _pairs(text)
        return max(len(own & t) / len(t) for t in self.pairs[family])


def _pairs(text: bytes) -> set[tuple[bytes, bytes]]:
    words = text.split()
    return set(zip([b"", *words], words, strict=False)) if len(words) < 2 else set(zip(words, words[1:], strict=False))


_TEMPLATE_PAIRS = [_pairs(normal(t.encode())) for ts in TEMPLATES.values() for t in ts]
_HOLDERS = {pair: [t for t, pairs in enumerate(_TEMPLATE_PAIRS) if pair in pairs] for pairs in _TEMPLATE_PAIRS for pair in pairs}
#: A wrapped template fills the lines between the first and the last of its own: these hold no more than twice its words.
_INNER = 2 * max(len(normal(t.encode()).split()) for ts in TEMPLATES.values() for t in ts)


def windows(lines: list[list[bytes]], confirm: float) -> list[tuple[int, int]]:
    """(first, last) of each line and run of lines of one paragraph that hold a share `confirm` of a template's word pairs."""
    hits: list[tuple[int, int, tuple[bytes, bytes]]] = []
    before = None
    for i, words in enumerate(lines):
        if not words:
            before = None
            continue
        if before is not None and (before, words[0]) in _HOLDERS:
            hits.append((i - 1, i, (before, words[0])))
        hits += [(i, i, p) for p in zip(words, words[1:], strict=False) if p in _HOLDERS]
        before = words[-1]
    out = []
    for k, (a, _, _) in enumerate(hits):
        if k and hits[k - 1][0] == a:
            continue
        seen: set[tuple[bytes, bytes]] = set()
        held = [0] * len(_TEMPLATE_PAIRS)
        inner, at, enough = 0, a, False
        for n in range(k, len(hits)):
            _, b, pair = hits[n]
            while at < b and lines[at + 1] and inner <= _INNER:
                inner += len(lines[at]) if at > a else 0
                at += 1
            if at < b or inner > _INNER:
                break
            if pair not in seen:
                seen.add(pair)
                for t in _HOLDERS[pair]:
                    held[t] += 1
                    enough |= held[t] / len(_TEMPLATE_PAIRS[t]) >= confirm
            if enough and (n + 1 == len(hits) or hits[n + 1][1] > b):
                out.append((a, b))
    return out


def train(background: list[bytes], seed: int = 5, copies: int = 12, rounds: int = 120) -> Classifier:
    """Train on damaged templates and all background paragraphs, whose words also fill up the damaged templates; every fifth
    row is held out to set the temperature."""
    rng = np.random.default_rng(seed)
    filler = [w for t in background for w in t.split()] or [b"the", b"of", b"and"]
    texts, labels = [], []
    for c, family in enumerate(TEMPLATES):
        for template in TEMPLATES[family]:
            words = normal(template.encode()).split()
            for i in range(copies):
                kept = [w for w in words if i == 0 or len(words) < 5 or rng.random() > 0.06]
                extra = [filler[j] for j in rng.integers(0, len(filler), 0 if i == 0 else rng.integers(0, 6))]
                texts.append(b" ".join(kept + extra if i % 2 else extra + kept))
                labels.append(c)
    for t in background:
        if not _licensed(t):
            texts.append(t)
            labels.append(len(TEMPLATES))
    own = [w for ts in TEMPLATES.values() for t in ts for w in normal(t.encode()).split()]
    for _ in range(copies * 60):  # words of templates among others are no licence
        mixed = [own[j] for j in rng.integers(0, len(own), rng.integers(1, 7))] + [filler[j] for j in rng.integers(0, len(filler), rng.integers(2, 13))]
        text = b" ".join(mixed[j] for j in rng.permutation(len(mixed)))
        if not _licensed(text):
            texts.append(text)
            labels.append(len(TEMPLATES))
    y = np.array(labels)
    held = np.arange(len(y)) % 5 == 4
    text, bucket = features(texts)
    scale = 1 / np.sqrt(np.bincount(text, minlength=len(y)).clip(1))
    on = ~held[text]
    weights, bias = np.zeros((BUCKETS, len(FAMILIES))), np.zeros(len(FAMILIES))
    balance = 1 / np.bincount(y, minlength=len(FAMILIES)).clip(1)[y]
    balance = np.where(held, 0, balance * len(y) / len(FAMILIES))[:, None]
    sums = np.full((BUCKETS, len(FAMILIES)), 1e-6)
    for _ in range(rounds):
        z = np.stack([np.bincount(text[on], weights[bucket[on], c] * scale[text[on]], len(y)) for c in range(len(FAMILIES))], 1) + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = p * balance / len(y)
        grad = np.stack([np.bincount(bucket[on], g[text[on], c] * scale[text[on]], BUCKETS) for c in range(len(FAMILIES))], 1) + 1e-5 * weights
        sums += grad**2
        weights -= 0.5 * grad / np.sqrt(sums)
        bias -= 2.0 * g.sum(0)
    model = Classifier(weights, bias)
    z = model.logits([t for t, h in zip(texts, held, strict=True) if h])
    best = (np.inf, 1.0)
    for temperature in np.geomspace(0.1, 5, 30):
        s = z / temperature
        s = s - s.max(1, keepdims=True)
        loss = -(s[np.arange(len(s)), y[held]] - np.log(np.exp(s).sum(1))).mean()
        best = min(best, (float(loss), float(temperature)))
    model.temperature = best[1]
    return model


def _licensed(text: bytes) -> bool:
    pairs = _pairs(text)
    return any(len(pairs & t) >= 0.6 * len(t) for t in _TEMPLATE_PAIRS)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 400, max_paragraphs: int = 2_000, max_chars: int = 4_000) -> Classifier:
    """Train with paragraphs of at most `max_docs` documents, chosen by a hash of the id, as the unknown class: at most
    `max_paragraphs` lines, chosen by a hash of theirs among those of at most `max_chars` characters. These bound the sample
    that the driver holds, whatever the corpus; `scan` then judges every line of every document. A table without such lines
    gives a model of the templates and their shuffled words alone.

    Only the chosen ids are sorted and broadcast (the parameter bounds them); texts stay where they are read.
    """
    chosen = docs.select(F.col(id_col).alias("__id")).where("__id IS NOT NULL").distinct().orderBy(F.xxhash64("__id"), "__id").limit(max_docs)
    rows = docs.join(F.broadcast(chosen), docs[id_col] == chosen["__id"], "left_semi")
    lines = rows.select(F.explode(F.split(F.col(text_col).cast("string"), "\n")).alias("line")).where(F.length("line").between(1, max_chars))
    found = lines.orderBy(F.xxhash64("line"), "line").limit(max_paragraphs).collect()
    return train([n for n in (normal(r["line"].encode("utf-8", "replace")) for r in found) if n])


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, confirm: float = 0.6) -> DataFrame:
    """Licences of every document, from every paragraph of its whole text: doc_id, licences (families in order of name),
    n_licence_paragraphs, and found, a list of (paragraph, family, probability, similarity). A paragraph that spans lines
    has the number of its first one, and is listed only for a family that none of its lines gives alone.

    Documents without licences, null and empty texts have empty lists; null ids and repeated rows pass through; an empty
    table gives no rows; other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    item = pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())])
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, licences array<string>, n_licence_paragraphs long, found array<struct<paragraph:int,family:string,probability:double,similarity:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            texts: list[bytes] = []
            owner: list[tuple[int, int, int]] = []
            for d, text in enumerate(utf8(batch.column("text"))):
                words = [normal(line).split() for line in text.split(b"\n")] if text else []
                for first, last in sorted(windows(words, confirm), key=lambda w: (w[1] - w[0], w)):
                    texts.append(b" ".join(w for ws in words[first : last + 1] for w in ws))
                    owner.append((d, first, last))
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            spans: list[list[tuple[str, int, int]]] = [[] for _ in range(batch.num_rows)]
            if texts:
                p = model.probabilities(texts)
                for (d, first, last), text, row in zip(owner, texts, p, strict=True):
                    c = int(row[:-1].argmax())
                    # Shorter runs come first: a run adds a family only where none of its lines gave it.
                    if last > first and FAMILIES[c] in NAMED and NAMED[FAMILIES[c]].isdisjoint(text.split()):
                        continue
                    if row[c] >= least and not any(f == FAMILIES[c] and a <= last and first <= b for f, a, b in spans[d]):
                        like = model.similarity(FAMILIES[c], text)
                        if like >= confirm:
                            spans[d].append((FAMILIES[c], first, last))
                            found[d].append({"paragraph": first, "family": FAMILIES[c], "probability": float(row[c]), "similarity": like})
            for fs in found:
                fs.sort(key=lambda f: f["paragraph"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([sorted({f["family"] for f in fs}) for fs in found], pa.list_(pa.string())), pa.array([len(fs) for fs in found], pa.int64()), pa.array(found, pa.list_(item))], ["doc_id", "licences", "n_licence_paragraphs", "found"])

    return source.mapInArrow(run, schema)
