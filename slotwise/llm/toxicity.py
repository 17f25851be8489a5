"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text are the presence of its words, word pairs and pairs with one word between (words
are runs of letters, digits and non-ASCII bytes, lower-cased in A-Z), hashed into ``2 ** BITS`` coordinates.
Training takes at most ``PER_CLASS`` rows of either label, those with the smallest hashed ids, so one task can
run FTRL-proximal over them in several passes, with a learning rate of its own per coordinate. The
L1 threshold leaves nearly all weights exactly zero; the others go to every scoring task.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import fold
from slotwise.llm.quality import labelled_sample
from slotwise.llm.words import Group, groups, mix

#: Bounds of what is fitted: labelled rows of either class, coordinates.
PER_CLASS, BITS = 4000, 18
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 1.0


def _coordinates(g: Group) -> tuple[np.ndarray, np.ndarray]:
    """Document and coordinate of each feature occurrence of a group."""
    docs, h = g.docs(), g.hashes
    mask = np.uint64((1 << BITS) - 1)
    doc, dim = [docs], [mix(h) & mask]
    for gap in (1, 2):
        if len(h) > gap:
            ok = docs[gap:] == docs[:-gap]
            doc.append(docs[gap:][ok])
            dim.append(mix(h[:-gap] * np.uint64(31) + h[gap:] + np.uint64(gap))[ok] & mask)
    return np.concatenate(doc), np.concatenate(dim).astype(np.int64)


def _train(batches):
    """FTRL-proximal over the rows of one task; emits the weights that are not zero."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the intercept, free of L1
    rows = []
    for b in batches:
        label = b.column("label").to_numpy(zero_copy_only=False)
        for g in groups(b.column("text"), lower=True, letters=True):
            doc, dim = _coordinates(g)
            cell = np.unique(doc.astype(np.int64) * size + dim)
            for i, part in enumerate(np.split(cell % size, np.searchsorted(cell, np.arange(1, g.hi - g.lo) * size))):
                rows.append((np.r_[part, size], label[g.lo + i]))

    def weights(at):
        zi, ni = z[at], n[at]
        cut = np.where(at == size, 0.0, L1)
        return np.where(np.abs(zi) <= cut, 0.0, -(zi - np.sign(zi) * cut) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    order = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, y = rows[i]
            w = weights(at)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            sigma = (np.sqrt(n[at] + gradient * gradient) - np.sqrt(n[at])) / ALPHA
            z[at] += gradient - sigma * w
            n[at] += gradient * gradient
    at = np.arange(size + 1)
    w = weights(at)
    some = np.flatnonzero(w)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(w[some])], names=["dim", "w"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that are not zero (at most ``2 ** BITS + 1``); coordinate ``2 ** BITS`` is the intercept."""
    sample = labelled_sample(docs, labels, label, id_col, text_col, folds, PER_CLASS)
    rows = sample.select("text", "label").repartition(1).sortWithinPartitions(F.xxhash64("text"), "label").mapInArrow(_train, "dim long, w double").collect()
    return np.array([r.dim for r in rows], np.int64), np.array([r.w for r in rows], float)


def _score(dims: np.ndarray, w: np.ndarray):
    def run(batches):
        size = 1 << BITS
        full = np.zeros(size + 1)
        full[dims] = w
        for b in batches:
            out = [np.zeros(0)]
            for g in groups(b.column("text"), lower=True, letters=True):
                doc, dim = _coordinates(g)
                some = full[dim] != 0
                cell = np.unique(doc[some].astype(np.int64) * size + dim[some])
                total = np.bincount(cell // size, weights=full[cell % size], minlength=g.hi - g.lo) + full[size]
                out.append(1 / (1 + np.exp(-np.clip(total, -500, 500))))
            yield pa.RecordBatch.from_arrays([b.column("given"), pa.array(np.concatenate(out))], names=["given", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` and ``predicted``.

    Null and empty texts are scored by the intercept alone. Null labels and labels other than 0 and 1
    are ignored; without any label every score is 0.5. A null id is not held out. Repeated rows get
    equal scores. Other columns are ignored.
    """
    dims, w = fit(docs, labels, label, id_col, text_col, folds)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("given"), F.col(text_col).alias("text")).mapInArrow(_score(dims, w), f"given {kind}, score double")
    return out.select(F.col("given").alias(id_col), F.coalesce(fold(F.col("given"), folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
