"""Substring deduplication with difference-cover anchors.

A window is 20 consecutive words. A word goes if some window that covers it has a word sequence
that also starts earlier: in a document with a smaller id, or earlier in the same one.

Hashes of 8-word anchors are taken only at positions whose residue modulo 13 lies in the difference
cover {0, 1, 3, 9}. For any two positions there is a shift below 13 that brings both to a cover
position, so two equal windows always share an aligned anchor inside them (12 + 8 = 20 words).
Anchors that occur once end the search there. Around the others, whole windows are hashed and
matched: those with an earlier equal one are removed. No pairs of documents are formed.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import maybe_broadcast, stored
from slotwise.llm.words import groups, text_buffers

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1


def _anchors(batches):
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    for b in batches:
        ids = b.column("id").to_numpy(zero_copy_only=False)
        for g in groups(b.column("text")):
            at, h = g.grams(ANCHOR)
            doc = g.docs()[at]
            pos = at - g.first[doc]
            keep = cover[pos % PERIOD]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[keep].view(np.int64)), pa.array(ids[g.lo + doc[keep]]), pa.array(pos[keep].astype(np.int32))], names=["h", "id", "pos"]
            )


def _ranges(pos: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged ranges [p - before, p + after) of sorted positions."""
    lo, hi = np.maximum(pos - before, 0), pos + after
    new = np.r_[True, lo[1:] > hi[:-1]]
    return lo[new], hi[np.r_[np.flatnonzero(new)[1:] - 1, len(pos) - 1]]


def _merged(before: int, after: int):
    def run(batches):
        for b in batches:
            lo, hi = [], []
            for p in b.column("at"):
                x, y = _ranges(np.unique(np.asarray(p.values)), before, after)
                lo.append(x.astype(np.int32))
                hi.append(y.astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "at"), pa.array(lo, kind), pa.array(hi, kind)], names=[c for c in b.schema.names if c != "at"] + ["lo", "hi"])

    return run


def _lists(col) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column; a null is an empty list."""
    lengths = np.array([0 if v is None else v for v in col.value_lengths().to_pylist()], np.int64)
    return np.r_[0, np.cumsum(lengths)], col.flatten().to_numpy(zero_copy_only=False)


def _covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.minimum(lo, n), 1)
    np.add.at(step, np.minimum(hi, n), -1)
    return np.cumsum(step[:-1]) > 0


def _windows(batches):
    for b in batches:
        ids, ver = b.column("id").to_numpy(zero_copy_only=False), b.column("ver").to_numpy(zero_copy_only=False)
        (off, lo), (_, hi) = _lists(b.column("lo")), _lists(b.column("hi"))
        for g in groups(b.column("text")):
            at, h = g.grams(WINDOW)
            spans = slice(off[g.lo], off[g.hi])
            base = np.repeat(g.first[:-1], np.diff(off[g.lo : g.hi + 1]))
            stop = np.repeat(g.first[1:], np.diff(off[g.lo : g.hi + 1]))
            keep = _covered(np.minimum(lo[spans] + base, stop), np.minimum(hi[spans] + base, stop), len(g.hashes))[at]
            at, h = at[keep], h[keep]
            doc = g.docs()[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(ids[g.lo + doc]), pa.array((at - g.first[doc]).astype(np.int32)), pa.array(ver[g.lo + doc])], names=["h", "id", "pos", "ver"]
            )


def _cut(batches):
    for b in batches:
        raw, toff = text_buffers(b.column("text"))
        (off, lo), (_, hi) = _lists(b.column("lo")), _lists(b.column("hi"))
        total, gone, kept = [], [], []
        for i in range(b.num_rows):
            words = raw[toff[i] : toff[i + 1]].tobytes().split()
            total.append(len(words))
            parts, at = [], 0
            for x, y in zip(lo[off[i] : off[i + 1]], hi[off[i] : off[i + 1]]):
                parts += words[at:x]
                at = y
            parts += words[at:]
            gone.append(len(words) - len(parts))
            kept.append(b" ".join(parts).decode())
        names = [c for c in b.schema.names if c not in ("lo", "hi", "text")]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "kept_text"])


def _repeated(df: DataFrame, condition: str) -> DataFrame:
    """Rows of ``df`` for which another row with the same hash meets ``condition``; both sides share one shuffle."""
    return df.alias("a").join(df.alias("b"), F.expr(f"a.h = b.h AND ({condition})"), "left_semi")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space).

    A null text has no words; a null id counts as the smallest. Rows that share an id are versions
    of one document: their windows are compared by start alone, and each row gets its own result
    (equal rows equal ones). Other columns of the input are ignored. An empty table gives an empty one.
    """
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(id_col).alias("given"), F.col(text_col).alias("text"))
    anchors = d.select("id", "text").mapInArrow(_anchors, "h long, id long, pos int")
    twice = _repeated(anchors, "a.id <> b.id OR a.pos <> b.pos")
    near = stored(twice.groupBy("id").agg(F.collect_list("pos").alias("at")).mapInArrow(_merged(WINDOW - ANCHOR, 1), "id long, lo array<int>, hi array<int>"), "anchors")
    width = F.lit(40) + 8 * F.size("lo")
    found = d.select("id", "text", F.xxhash64("text").alias("ver")).join(maybe_broadcast(near, width), "id")
    windows = found.select("id", "ver", "text", "lo", "hi").mapInArrow(_windows, "h long, id long, pos int, ver long")
    later = _repeated(windows, "b.id < a.id OR (b.id = a.id AND b.pos < a.pos)")
    gone = stored(later.groupBy("id", "ver").agg(F.collect_list("pos").alias("at")).mapInArrow(_merged(0, WINDOW), "id long, ver long, lo array<int>, hi array<int>"), "removed")
    whole = d.withColumn("ver", F.xxhash64("text")).join(maybe_broadcast(gone, width + 8), ["id", "ver"], "left")
    kind = docs.schema[id_col].dataType.simpleString()
    return whole.select("given", "text", "lo", "hi").mapInArrow(_cut, f"given {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("given", id_col)


def digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return result.select(id_col, "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
