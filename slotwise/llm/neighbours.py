"""Embedding near-duplicates by NN-descent.

Every distinct vector keeps a list of its nearest known neighbours. Lists start from buckets of random hyperplanes
and are refined by joining the neighbours of each vector with one another; a list whose last entry is still above the
threshold is saturated and enlarged. Edges that reach the threshold give components. A link never
leaves its component, so the links of each vector are then counted inside it, in blocks of exact cosine products: no cap
on neighbours reaches the result. An audit compares a bounded sample, another one each time, with all vectors; while it
finds a link between components, that link is kept and further buckets and rounds follow. The share of audited links
that the last audit found inside components is returned; below ``RECALL`` after ``ATTEMPTS`` audits the job fails.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import maybe_broadcast, stored
from slotwise.llm.graph import components

#: Entries of a list, of an enlarged one, rows compared at once, audited vectors, attempts, share of links a start must find, recall below which the result is refused.
LIST, ENLARGED, BLOCK, AUDIT, ATTEMPTS, START, RECALL = 6, 12, 512, 256, 12, 0.99, 0.95


def _matrix(col: pa.Array) -> np.ndarray:
    """Unit vectors, in double precision."""
    if not len(col):
        return np.zeros((0, 0))
    v = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # keeps squares finite
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _runs(batches, limit: int | None):
    """Consecutive rows of equal ``key`` as (names -> arrays); a run longer than ``limit`` comes in several pieces."""
    rest = None
    for b in batches:
        cols = {n: (_matrix(b.column(n)) if n == "vec" else b.column(n).to_numpy(zero_copy_only=False)) for n in b.schema.names}
        if not b.num_rows:
            continue
        if rest:
            cols = {n: np.concatenate([rest[n], c]) for n, c in cols.items()}
        key = cols["key"]
        cut = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
        for a, e in zip(cut[:-1], cut[1:]):
            yield {n: c[a:e] for n, c in cols.items()}
        rest = {n: c[cut[-1] :] for n, c in cols.items()}
        while limit and len(rest["key"]) >= 2 * limit:
            yield {n: c[:limit] for n, c in rest.items()}
            rest = {n: c[limit:] for n, c in rest.items()}
    if rest:
        yield rest


def _closest(keep: int):
    """Edges (c, d, cos) from each vector to its ``keep`` nearest ones of the same run."""

    def run(batches):
        out, rows = [], 0
        for r in _runs(batches, BLOCK):
            m = len(r["c"])
            if m < 2:
                continue
            s = r["vec"] @ r["vec"].T
            np.fill_diagonal(s, -2)
            k = min(keep, m - 1)
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            out.append((np.repeat(r["c"], k), r["c"][near].ravel(), np.take_along_axis(s, near, 1).ravel()))
            rows += m * k
            if rows > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["c", "d", "cos"])
                out, rows = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["c", "d", "cos"])

    return run


def _buckets(planes: np.ndarray, tables: int, bits: int, seed: int):
    def run(batches):
        weight = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            v = _matrix(b.column("vec"))
            if not len(v):
                continue
            for t in range(tables):
                sign = (v @ planes[:, t * bits : (t + 1) * bits] > 0) @ weight
                yield pa.RecordBatch.from_arrays([pa.array(sign * 4096 + t + seed), b.column("c"), b.column("vec")], names=["key", "c", "vec"])

    return run


def _start(base: DataFrame, dim: int, count: int, cos: float, attempt: int, vec: str) -> DataFrame:
    """Edges between vectors that share a bucket; buckets of more than ``BLOCK`` rows are split at random."""
    bits = min(40, max(2, math.ceil(math.log2(max(count, 2))) - 3))
    hit = (1 - math.acos(cos) / math.pi) ** bits
    tables = min(4000, math.ceil(math.log(1 - START) / math.log(1 - hit)) if hit < 1 else 1)
    planes = np.random.default_rng(100 + attempt).standard_normal((dim, tables * bits))
    rows = base.select("c", "vec").mapInArrow(_buckets(planes, tables, bits, 0), f"key long, c long, vec {vec}")
    full = stored(base.select("c", "vec").mapInArrow(_buckets(planes, tables, bits, 0), f"key long, c long, vec {vec}").groupBy("key").count().where(F.col("count") > BLOCK), "full")
    rows = rows.join(maybe_broadcast(full, 24), "key", "left")
    part = F.pmod(F.xxhash64("c", F.col("key") % 4096, F.lit(attempt)), F.ceil(F.coalesce("count", F.lit(1)) / BLOCK))
    rows = rows.select(F.when(F.col("count").isNull(), F.col("key")).otherwise(F.xxhash64("key", part)).alias("key"), "c", "vec")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_closest(LIST), "c long, d long, cos double")


def _best(edges: DataFrame, cos: float) -> DataFrame:
    """The ``LIST`` nearest of each list, or up to ``ENLARGED`` that reach the threshold."""
    w = Window.partitionBy("c").orderBy(F.desc("cos"), "d")
    edges = edges.repartition("c").dropDuplicates(["c", "d"])
    return edges.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= ENLARGED) & ((F.col("rank") <= LIST) | (F.col("cos") >= cos))).drop("rank")


def _round(lists: DataFrame, base: DataFrame, row_bytes: int, cos: float) -> DataFrame:
    back = lists.withColumn("rank", F.row_number().over(Window.partitionBy("d").orderBy(F.desc("cos"), "c"))).where(F.col("rank") <= LIST)
    member = lists.select(F.col("c").alias("key"), F.col("d").alias("c")).union(back.select(F.col("d").alias("key"), "c")).distinct()
    near = member.join(maybe_broadcast(base.select("c", "vec"), row_bytes), "c").select("key", "c", "vec")
    found = near.repartition("key").sortWithinPartitions("key").mapInArrow(_closest(LIST), "c long, d long, cos double")
    return stored(_best(lists.union(found), cos), "lists")


def _missed(sample, cos: float):
    """Links of the audited vectors: all of them, and as edges those that join different components."""

    def run(batches):
        c0, label0, v0 = sample
        for b in batches:
            v = _matrix(b.column("vec"))
            if not len(v):
                continue
            c, label = b.column("c").to_numpy(), b.column("label").to_numpy()
            hit = (v @ v0.T >= cos) & (c[:, None] != c0[None])
            i, j = np.nonzero(hit & (label[:, None] != label0[None]))
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[c[i], 0]), pa.array(np.r_[c0[j], 0]), pa.array(np.r_[np.zeros(len(i), np.int64), int(hit.sum())])], names=["a", "b", "links"])

    return run


def _linked_counts(cos: float):
    """For runs of one pair of blocks (``side`` 0, 1; or 2: a block with itself): how many rows each vector links with."""

    def run(batches):
        for r in _runs(batches, None):
            side, n = r["side"], r["n"]
            if side[0] == 2:
                s = r["vec"] @ r["vec"].T >= cos
                np.fill_diagonal(s, False)
                c, got = r["c"], s @ n
            else:
                x, y = side == 0, side == 1
                s = r["vec"][x] @ r["vec"][y].T >= cos
                c, got = np.r_[r["c"][x], r["c"][y]], np.r_[s @ n[y], n[x] @ s]
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(got.astype(np.int64))], names=["c", "links"])

    return run


def _count_links(inside: DataFrame, vec: str, cos: float) -> DataFrame:
    """``c, links`` for the vectors of ``inside`` (c, n, vec, label), counted within their component."""
    size = inside.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = inside.join(maybe_broadcast(size, 24), "label").withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    pair = F.struct(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("p", pair)
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") == F.col("p.x"), 0).otherwise(1)
    rows = rows.select(F.xxhash64("label", "p.x", "p.y").alias("key"), side.alias("side"), "c", "n", "vec")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_linked_counts(cos), "c long, links long").groupBy("c").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cos: float = 0.95) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` (smallest id reachable), ``kept``, ``audited_recall`` (one value, null without links in the sample).

    Null, empty and zero vectors and those with null or non-finite components link with nothing and are kept. Shorter
    vectors count as filled up with zeros. Equal vectors are one class inside and separate, linked rows
    in the result; rows that share an id count each. A component's id is its smallest that is not
    null; a null id alone is its own. Other columns are ignored; an empty table gives an empty one.
    """
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    vec = f"array<{kind}>"
    raw = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast(vec).alias("vec"))
    dim = raw.agg(F.max(F.size("vec"))).first()[0] or 0
    limit = F.lit(float("inf"))
    ok = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists("vec", lambda x: x != 0), F.lit(False))
    filled = F.when(F.size("vec") < dim, F.concat("vec", F.array_repeat(F.lit(0.0).cast(kind), F.lit(dim) - F.size("vec")))).otherwise(F.col("vec"))
    raw = raw.withColumn("ok", ok).withColumn("vec", F.when(F.col("ok"), filled)).withColumn("c", F.when(F.col("ok"), F.xxhash64("vec")))
    base = stored(raw.where("ok").groupBy("c").agg(F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("id").alias("least")), "vectors")
    count, row_bytes = base.count(), dim * (8 if kind == "double" else 4) + 40

    edges, extra, recall = None, [], None
    for attempt in range(ATTEMPTS):
        found = _start(base, dim, count, cos, attempt, vec)
        edges = stored(_best(found if edges is None else edges.union(found), cos), "lists")
        reached = -1
        while True:
            now = edges.where(F.col("cos") >= cos).count()
            if now <= reached * 1.01:
                break
            reached, edges = now, _round(edges, base, row_bytes, cos)
        links = edges.where(F.col("cos") >= cos).select(F.col("c").alias("a"), F.col("d").alias("b"))
        for e in extra:
            links = links.union(e)
        label = stored(components(links, "a", "b"), "labels")
        named = base.join(maybe_broadcast(label.withColumnRenamed("node", "c"), 32), "c", "left").withColumn("label", F.coalesce("label", "c"))
        picked = named.orderBy(F.xxhash64("c", F.lit(attempt))).limit(AUDIT).select("c", "label", "vec").toArrow()
        if not picked.num_rows:
            break
        sample = (picked.column("c").to_numpy(), picked.column("label").to_numpy(), _matrix(picked.column("vec").combine_chunks()))
        audit = stored(named.select("c", "label", "vec").mapInArrow(_missed(sample, cos), "a long, b long, links long"), "audit")
        missing = audit.where("a <> b").select("a", "b")
        seen, lost = audit.agg(F.sum("links"), F.count_if(F.col("a") != F.col("b"))).first()
        recall = 1 - lost / seen if seen else None
        if not lost:
            break
        extra.append(missing)
    else:
        if recall < RECALL:
            raise RuntimeError(f"links found: {recall:.3f} of those audited after {ATTEMPTS} attempts")
        for e in extra[-1:]:
            links = links.union(e)
        label = stored(components(links, "a", "b"), "labels")

    inside = base.join(maybe_broadcast(label.withColumnRenamed("node", "c"), 32), "c")
    links = _count_links(inside.select("c", "n", "vec", "label"), vec, cos)
    least = inside.groupBy("label").agg(F.min("least").alias("component"))
    per = inside.select("c", "n", "label").join(least, "label").join(links, "c", "left").select("c", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    alone = base.join(label.select(F.col("node").alias("c")), "c", "left_anti").select("c", F.col("least").alias("component"), (F.col("n") - 1).alias("links"))
    result = stored(per.union(alone), "classes")
    out = raw.select("id", "c").join(maybe_broadcast(result, 32), "c", "left")
    comp = F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component")).cast("long")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"), F.lit(recall).cast("double").alias("audited_recall"))
