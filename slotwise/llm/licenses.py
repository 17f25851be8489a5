"""Licence families of documents by a trained paragraph classifier.

Paragraphs are lines, and sentences of them. Sparse multinomial logistic regression over hashed words and word pairs tells
licence families from ordinary text. It is trained on notices written below, with words
left out at random, and on a bounded sample of paragraphs of the corpus as class ``unknown``. The unknown class is calibrated:
a family must be likelier than all but ``FALSE_SHARE`` of held-out ordinary paragraphs make it. A prediction counts
only if the paragraph also shares enough word triples with a notice of its family.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.words import groups, mix

# Short notices by which licence families are declared.
NOTICES = {
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3", "you can redistribute it under the terms of the GNU Affero General Public License"],
    "apache": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "you can redistribute it under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 3", "you can redistribute it under the terms of the GNU Lesser General Public License"],
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved. Unauthorized copying of this file is strictly prohibited", "This software is proprietary and confidential"],
}
FAMILIES = list(NOTICES)
#: Coordinates, copies of a notice, ordinary paragraphs (a bounded sample), passes, rate, L1, share of false alarms, shared triples.
BITS, COPIES, ORDINARY, STEPS, RATE, L1, FALSE_SHARE, SHARED = 14, 24, 4000, 300, 2.0, 1e-5, 1e-3, 0.6
_SPLIT = r"[\r\n]+|[.!?;]\s+"


def _paragraphs(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Document and text of each paragraph."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    parts = pc.split_pattern_regex(col.fill_null("").cast(pa.large_string()), _SPLIT)
    return pc.list_parent_indices(parts).to_numpy(), parts.flatten()


def _terms(paragraphs: pa.Array):
    """Per group: first paragraph, count, (paragraph, coordinate) once each, (paragraph, word triple)."""
    mask = np.uint64((1 << BITS) - 1)
    for g in groups(paragraphs, lower=True, letters=True):
        docs = g.docs()
        at, two = g.grams(2)
        doc, dim = np.r_[docs, docs[at]], np.r_[mix(g.hashes) & mask, mix(two) & mask].astype(np.int64)
        cell = np.unique(doc.astype(np.int64) * (1 << BITS) + dim)
        at3, three = g.grams(3)
        yield g.lo, g.hi - g.lo, cell >> BITS, cell & ((1 << BITS) - 1), docs[at3], three


class Model:
    """Weights (coordinates x families and unknown), the calibrated bar, and the word triples of each family's notices."""

    def __init__(self, ordinary: list[str]):
        rng = np.random.default_rng(5)
        texts, y = [], []
        for f, notices in enumerate(NOTICES.values()):
            for notice in notices:
                words = notice.split()
                for i in range(COPIES):
                    keep = rng.random(len(words)) > (0.15 if i else 0)
                    texts.append(" ".join(w for w, k in zip(words, keep) if k))
                    y.append(f)
        # ordinary text does not repeat what notices say
        held, trained = ordinary[::4], [t for i, t in enumerate(ordinary) if i % 4]
        texts += trained
        y = np.array(y + [len(FAMILIES)] * len(trained))
        row, dim = self._rows(texts)
        size, kinds = 1 << BITS, len(FAMILIES) + 1
        self.w, self.bias = np.zeros((size, kinds)), np.zeros(kinds)
        scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(texts)), 1))
        used, local = np.unique(dim, return_inverse=True)
        w, target = np.zeros((len(used), kinds)), np.eye(kinds)[y]
        weight = 1 / np.maximum(np.bincount(y, minlength=kinds), 1)[y] / kinds
        for _ in range(STEPS):  # proximal gradient steps
            z = np.zeros((len(texts), kinds))
            np.add.at(z, row, w[local] * scale[row, None])
            d = (_softmax(z + self.bias) - target) * weight[:, None]
            grad = np.zeros_like(w)
            np.add.at(grad, local, d[row] * scale[row, None])
            w -= RATE * kinds * grad
            w = np.sign(w) * np.maximum(np.abs(w) - RATE * kinds * L1, 0)
            self.bias -= RATE * d.sum(0)
        self.w[used] = w
        self.bar = 0.5
        if held:
            best = self.probabilities(len(held), *self._rows(held))[:, :-1].max(1)
            self.bar = max(self.bar, min(0.9, float(np.quantile(best, 1 - FALSE_SHARE))))
        self.triples = []
        for notices in NOTICES.values():
            col = pa.array([f"{n}" for n in notices])
            sets = [[] for _ in notices]
            for lo, n, _, _, doc, three in _terms(col):
                for i in range(n):
                    sets[lo + i] = np.unique(three[doc == i])
            self.triples.append(sets)

    @staticmethod
    def _rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [(doc + lo, dim) for lo, _, doc, dim, _, _ in _terms(pa.array(texts, pa.string()))]
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.int64),) * 2

    def probabilities(self, n: int, row: np.ndarray, dim: np.ndarray) -> np.ndarray:
        scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
        z = np.stack([np.bincount(row, weights=self.w[dim, k], minlength=n) * scale for k in range(self.w.shape[1])], axis=1)
        return _softmax(z + self.bias)

    def confirmed(self, family: int, three: np.ndarray) -> bool:
        """Whether a notice of the family shares enough of its word triples with the paragraph."""
        return any(len(s) and np.isin(s, three).mean() >= SHARED for s in self.triples[family])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The sample: paragraphs of the ``ORDINARY`` documents with the smallest hashed ids, one each, cut to 60 words, that name no licence."""
    one = F.split(F.col(text_col), _SPLIT)
    n = F.size(one)
    part = F.array_join(F.slice(F.split(F.get(one, F.pmod(F.xxhash64(id_col), n).cast("int")), r"\s+"), 1, 60), " ")
    rows = docs.where(F.length(text_col) > 0).select(F.xxhash64(id_col, text_col).alias("o"), part.alias("p")).where(~F.col("p").rlike("(?i)licen[sc]e|spdx|rights reserved|proprietary"))
    return Model([r.p for r in rows.orderBy("o", "p").limit(ORDINARY).select("p").collect()])


def _scan(shipped):
    def run(batches):
        model = shipped.value
        for b in batches:
            doc, parts = _paragraphs(b.column("text"))
            n_parts = np.bincount(doc, minlength=b.num_rows)
            found: list[list] = [[] for _ in range(b.num_rows)]
            for lo, n, row, dim, at3, three in _terms(parts):
                p = model.probabilities(n, row, dim)
                best = p[:, :-1].argmax(1)
                score = p[np.arange(n), best]
                first = np.searchsorted(at3, np.arange(n + 1))
                for i in np.flatnonzero((score >= model.bar) & (np.diff(first) > 0)):
                    if model.confirmed(best[i], three[first[i] : first[i + 1]]):
                        found[doc[lo + i]].append((FAMILIES[best[i]], int(lo + i), float(score[i])))
            start = np.r_[0, np.cumsum(n_parts)]
            hits = [[{"family": f, "paragraph": i - int(start[d]), "score": s} for f, i, s in x] for d, x in enumerate(found)]
            yield pa.RecordBatch.from_arrays(
                [b.column("given"), pa.array(n_parts.astype(np.int64)), pa.array(hits, pa.list_(pa.struct([("family", pa.string()), ("paragraph", pa.int64()), ("score", pa.float64())])))], names=["given", "n_paragraphs", "hits"]
            )

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_paragraphs``, ``hits`` (family, paragraph from 0, score) in order, ``families`` (sorted, comma-joined).

    Null and empty texts have one empty paragraph and no hits. Paragraphs of any length are read whole. Null ids and repeated rows are kept.
    Other columns are ignored; an empty table gives an empty one.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("given"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_scan(shipped), f"given {kind}, n_paragraphs long, hits array<struct<family:string,paragraph:long,score:double>>")
    return out.select(F.col("given").alias(id_col), "n_paragraphs", "hits", F.array_join(F.array_sort(F.array_distinct("hits.family")), ",").alias("families"))


def digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return result.select(id_col, "n_paragraphs", F.size("hits").cast("long").alias("n_hits"), "families")
