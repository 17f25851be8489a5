"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms of a document are its words (lower-cased in A-Z), the shapes of its words (runs of capitals, small
letters, digits and each other character, collapsed) and steps of how repetitive it is. Hashed, weighted
by log frequency and inverse document frequency and projected by a truncated SVD, they give a short
vector. The SVD and the labelled vectors come from a sample of labelled rows whose size is
bounded (``PER_CLASS`` of either label, those with the smallest hashed ids), so both are small enough to ship to every task. Every
document is compared with all of them in exact blocked cosine products; the ``NEIGHBOURS`` nearest vote
with weights that grow with their similarity.
"""
from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import fold
from slotwise.llm.words import groups, mix, text_buffers, word_shapes

#: Bounds of what is fitted: labelled rows of either class, hashed terms, dimensions.
PER_CLASS, TERMS, RANK = 2000, 4096, 48
NEIGHBOURS, POWER, BLOCK_ROWS = 25, 4, 256


def _features(col: pa.Array):
    """For groups of documents: first document, number of documents, and (document, term, log frequency) of their distinct terms."""
    raw, off = text_buffers(col)
    half = np.uint64(TERMS // 2)
    for g in groups(col, lower=True):
        docs, n = g.docs(), g.hi - g.lo
        shape = word_shapes(raw, off, g)
        size = np.maximum(np.diff(g.first), 1)
        same = np.zeros(len(docs), bool)
        same[1:] = (g.hashes[1:] == g.hashes[:-1]) & (docs[1:] == docs[:-1])
        at, pairs = g.grams(2)
        first = np.unique(mix(pairs ^ (docs[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1]
        distinct = docs[at[first]]
        step = lambda x: np.minimum(np.sqrt(np.clip(x, 0, 1)) * 8, 7).astype(np.int64)
        steps = [step(np.bincount(docs[same], minlength=n) / size), 8 + step(1 - np.bincount(distinct, minlength=n) / np.maximum(size - 1, 1))]
        doc = np.concatenate([docs, docs, *[np.arange(n)] * 2])
        term = np.concatenate([(g.hashes % half).astype(np.int64), ((mix(shape) % half) + half).astype(np.int64), *((mix(s.astype(np.uint64) + np.uint64(77)) % np.uint64(TERMS)).astype(np.int64) for s in steps)])
        weight = np.concatenate([np.ones(2 * len(docs)), *[np.repeat(np.maximum(size, 1).astype(float), 1)] * 2])
        cell, inverse = np.unique(doc * TERMS + term, return_inverse=True)
        yield g.lo, n, cell // TERMS, cell % TERMS, np.log1p(np.bincount(inverse, weights=weight, minlength=len(cell))).astype(np.float32)


def _term_rows(batches):
    for b in batches:
        label, key = b.column("label").to_pylist(), b.column("key").to_pylist()
        for lo, n, doc, term, tf in _features(b.column("text")):
            cut = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[lo : lo + n], pa.int64()), pa.array(label[lo : lo + n], pa.int32()), pa.ListArray.from_arrays(pa.array(cut), pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(pa.array(cut), pa.array(tf))],
                names=["key", "label", "terms", "tf"],
            )


class Model:
    """Inverse document frequencies, projection, and the labelled unit vectors."""

    _PARTS = ("labels", "idf", "projection", "known")

    def __init__(self, labels: np.ndarray, idf: np.ndarray, projection: np.ndarray, known: np.ndarray):
        self.labels, self.idf, self.projection, self.known = labels, idf, projection, known
        self.prior = float(labels.mean()) if len(labels) else 0.5

    @classmethod
    def learn(cls, labels: np.ndarray, x: np.ndarray) -> Model:
        """From the log term frequencies ``x``, one row per labelled document; ``x`` is used up."""
        idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
        x *= idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        rank = min(RANK, *x.shape) if len(x) else 0
        basis = np.random.default_rng(7).standard_normal((TERMS, min(TERMS, rank + 8))).astype(np.float32)
        for _ in range(4):  # subspace iteration
            basis, _ = np.linalg.qr(x.T @ (x @ basis))
        _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
        projection = np.ascontiguousarray((basis @ right.T)[:, :rank], np.float32)
        return cls(labels, idf, projection, cls._unit(x @ projection))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self._PARTS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Model:
        parts = np.load(io.BytesIO(raw))
        return cls(*(parts[k] for k in cls._PARTS))

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def vectors(self, n: int, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        v, w = np.zeros((n, self.projection.shape[1]), np.float32), tf * self.idf[term]
        for a in range(0, len(doc), 1 << 16):  # bounds the gathered rows
            d = doc[a : a + (1 << 16)]
            first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            v[d[first]] += np.add.reduceat(self.projection[term[a : a + (1 << 16)]] * w[a : a + (1 << 16), None], first)
        return self._unit(v)

    def scores(self, v: np.ndarray) -> np.ndarray:
        out = np.full(len(v), self.prior)
        k = min(NEIGHBOURS, len(self.known))
        for a in range(0, len(v) if k else 0, BLOCK_ROWS):
            s = v[a : a + BLOCK_ROWS] @ self.known.T
            near = np.argpartition(s, -k, axis=1)[:, -k:]
            w = np.maximum(np.take_along_axis(s, near, 1), 0).astype(float) ** POWER
            total = w.sum(1)
            some = total > 1e-12
            out[a : a + BLOCK_ROWS][some] = np.clip((w * self.labels[near]).sum(1)[some] / total[some], 0, 1)
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, folds: int, per_class: int) -> DataFrame:
    """``text, label, key`` of at most ``per_class`` training rows of either label, by hashed id; held-out ids (fold 0) never enter.

    An id that occurs in several rows gives one of them, the text with the smallest hash.
    """
    ok = labels.where(F.col(label).isin(0, 1) & (fold(F.col(id_col), folds) != 0)).select(F.col(id_col), F.col(label).cast("int").alias("label")).distinct()
    part = lambda y: ok.where(F.col("label") == y).orderBy(F.xxhash64(id_col), id_col).limit(per_class)
    found = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(part(0).union(part(1))), id_col)
    one = found.groupBy(id_col, "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.select("text", "label", F.xxhash64(id_col).alias("key"))


def _learn(batches):
    """The model of the rows of one task, as one row; no row without any."""
    tables = [b for b in batches if len(b)]
    n = sum(len(b) for b in tables)
    x, labels, at = np.zeros((n, TERMS), np.float32), np.zeros(n, np.float32), 0
    for b in tables:
        labels[at : at + len(b)] = b.column("label").to_numpy()
        terms, tf = b.column("terms"), b.column("tf")
        x[at + np.repeat(np.arange(len(b)), np.diff(terms.offsets.to_numpy())), terms.flatten().to_numpy()] = tf.flatten().to_numpy()
        at += len(b)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([Model.learn(labels, x).to_bytes()], pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> Model:
    """The model, learned in one task from a sample of bounded size; the driver gets its few megabytes only."""
    sample = labelled_sample(docs, labels, label, id_col, text_col, folds, PER_CLASS)
    terms = sample.mapInArrow(_term_rows, "key long, label int, terms array<int>, tf array<float>")
    found = terms.repartition(1).sortWithinPartitions("key", "label").mapInArrow(_learn, "model binary").collect()
    return Model.from_bytes(bytes(found[0].model)) if found else Model.learn(np.zeros(0, np.float32), np.zeros((0, TERMS), np.float32))


def _score(model: Model):
    def run(batches):
        for b in batches:
            out = [np.zeros(0)]
            out += [model.scores(model.vectors(n, doc, term, tf)) for _, n, doc, term, tf in _features(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "text"), pa.array(np.concatenate(out))], names=[*(c for c in b.schema.names if c != "text"), "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` (share of the vote for label 1), ``predicted``, and the text.

    Null and empty texts get the vote of the texts nearest to them in repetitiveness. Null labels and labels other than 0 and 1 are ignored; without
    any label the score is 0.5. A null id is not held out. Repeated rows get equal scores. Other columns are ignored.
    """
    model = fit(docs, labels, label, id_col, text_col, folds)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("given"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_score(model), f"given {kind}, score double")
    return out.select(F.col("given").alias(id_col), F.coalesce(fold(F.col("given"), folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold."""
    model = fit(docs, labels, label, id_col, text_col, folds)
    # the text travels under another name, so that the scorer can drop its own copy
    wide = docs.withColumns({"__kept": F.struct(*docs.columns)}).select("__kept", F.col(text_col).alias("text"))
    scored = wide.mapInArrow(_score(model), f"__kept {docs.schema.simpleString()}, score double")
    return scored.where(F.col("score") >= threshold).select("__kept.*")
