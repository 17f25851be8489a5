"""Whitened embeddings: distinct vectors are counted, fitted and projected once, and joined back to their rows.

Entries are put on a grid (floor of ``scale`` times the entry), and equal grid vectors x are grouped. The fit
list is each distinct vector with weight one, or with its count. Sums per dimension are exact; the covariance
is the sum of weighted products of centred blocks, one matrix per task, added up cell by cell in Spark. Its
eigenvectors, a matrix of the size of one vector squared, are found on the driver. Vectors of different
lengths have nothing in common: each length is a list of its own.
"""
from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import stored

#: A vector that holds more than one row in this many is joined back apart from the others.
HOT_SHARE = 1000
#: Entries of vectors handled at a time.
BLOCK = 1 << 20


def _grid(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """Id and grid vector of the rows whose entries are all finite numbers (and, times ``scale``, fit a long)."""
    fits = lambda c: F.coalesce(F.abs(c.cast("double") * F.lit(float(scale))) < F.lit(2.0**63), F.lit(False))
    ok = vectors.where(F.col(vec_col).isNotNull() & F.forall(vec_col, fits) & (F.size(vec_col) > 0))
    return ok.select(F.col(id_col).alias("given"), F.transform(vec_col, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long")).alias("x"))


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of equal length, at most ``BLOCK`` entries at a time."""
    x = b.column("x")
    start = x.offsets.to_numpy()
    flat, size = x.values.to_numpy(), np.diff(start)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        for i in range(0, len(at), max(1, BLOCK // d)):
            part = at[i : i + max(1, BLOCK // d)]
            yield part, flat[start[part][:, None] + np.arange(d)]


def _weights(b: pa.RecordBatch, part: np.ndarray, counted: bool) -> np.ndarray:
    return b.column("copies").to_numpy()[part] if counted else np.ones(len(part), np.int64)


def _sums(counted: bool):
    """Per length: weights and weighted sums by dimension (dimension -1: the weights alone)."""

    def run(batches):
        acc: dict[int, list[int]] = {}
        for b in batches:
            for part, x in _blocks(b):
                w, total = _weights(b, part, counted), acc.setdefault(x.shape[1], [0] * (x.shape[1] + 1))
                if counted:  # products may leave 64 bits
                    new = [int(w.sum()), *(x.astype(object) * w[:, None].astype(object)).sum(0)]
                else:  # two halves, each far from 64 bits
                    high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
                    new = [len(x), *(int(h) * (1 << 32) + int(v) for h, v in zip(high, low))]
                for i, v in enumerate(new):
                    total[i] += v
        for d, total in acc.items():
            sums = pa.array([Decimal(v) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, d, np.int32)), pa.array(np.arange(-1, d, dtype=np.int32)), sums], names=["d", "i", "s"])

    return run


class Model:
    """Of the vectors of one length: weight n, exact sums, means, and after ``solve`` the projection."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.mean = np.array([float(Fraction(s, n)) for s in sums])

    def solve(self, covariance: np.ndarray, components: int) -> None:
        values, basis = np.linalg.eigh(covariance)
        values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
        basis = basis * np.where(np.take_along_axis(basis, np.abs(basis).argmax(0)[None], 0) < 0, -1.0, 1.0)
        trace = float(np.trace(covariance))
        self.explained = [max(float(v), 0.0) / trace if trace > 0 else None for v in values]
        flat = values <= len(covariance) * np.finfo(float).eps * max(float(values[0]), 0.0)
        self.projection = basis / np.sqrt(np.where(flat, np.nan, values))

    def deviations(self, x: np.ndarray) -> list[Decimal] | np.ndarray:
        """Sums over dimensions of (n x - S) squared, exact."""
        far = self.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, self.sums))
        if far * far * len(self.sums) < 1 << 62:
            y = self.n * x - np.array(self.sums, np.int64)
            return pa.array((y * y).sum(1)).cast(pa.decimal128(38, 0))
        y = x.astype(object) * self.n - np.array(self.sums, object)
        return pa.array([Decimal(int(v)) for v in (y * y).sum(1)], pa.decimal128(38, 0))


def _products(models: dict[int, Model], counted: bool):
    """Cells of the summed products of centred vectors, upper triangle, once per task."""

    def run(batches):
        acc = {}
        for b in batches:
            for part, x in _blocks(b):
                d = x.shape[1]
                c = x - models[d].mean
                new = (c * _weights(b, part, counted)[:, None]).T @ c if counted else c.T @ c
                acc[d] = acc[d] + new if d in acc else new
        for d, m in acc.items():
            i, j = np.triu_indices(d)
            cells = [np.full(len(i), d, np.int32), i.astype(np.int32), j.astype(np.int32), m[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in cells], names=["d", "i", "j", "v"])

    return run


def _project(models: dict[int, Model]):
    def run(batches):
        for b in batches:
            for part, x in _blocks(b):
                m = models[x.shape[1]]
                w = (x - m.mean) @ m.projection
                flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([b.column("x").take(pa.array(part)), b.column("copies").take(pa.array(part)), m.deviations(x), lists], names=["x", "copies", "deviation", "w"])

    return run


def _identity_errors(white: DataFrame, models: dict[int, Model], counted: bool) -> dict[int, float | None]:
    """Largest difference between the covariance of the whitened fit list, measured, and the identity."""
    if not models:
        return {}
    w, k = F.col("copies").cast("double") if counted else F.lit(1.0), max(len(m.explained) for m in models.values())
    at = lambda i: F.get("w", F.lit(i))
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    rows = white.groupBy(F.size("x").alias("d")).agg(
        F.sum(w).alias("n"), *[F.sum(w * at(i)).alias(f"s{i}") for i in range(k)], *[F.sum(w * at(i) * at(j)).alias(f"p{i}_{j}") for i, j in cells]
    )
    out = {}
    for r in rows.collect():
        off = [abs(r[f"p{i}_{j}"] / r.n - r[f"s{i}"] / r.n * r[f"s{j}"] / r.n - (i == j)) for i, j in cells if r[f"p{i}_{j}"] is not None]
        out[r.d] = max(off, default=None)
    return out


def _by_length(values: dict[int, object], kind: str) -> Column:
    """Value of the row's vector length."""
    if len(values) == 1:
        return F.lit(next(iter(values.values()))).cast(kind)
    pairs = [c for d, v in values.items() for c in (F.lit(d), F.lit(v).cast(kind))]
    return F.element_at(F.create_map(*pairs), F.size("x")) if pairs else F.lit(None).cast(kind)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256, components: int = 4, weights: str = "one") -> DataFrame:
    """One row per usable row of ``vectors`` and component: id, ``component`` from 1, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Null vectors, vectors with null or non-finite entries and empty ones are left out. With ``weights="one"`` each
    distinct grid vector counts once, with ``"count"`` as often as it occurs. ``deviation`` is exact as
    decimal(38, 0). A vector shorter than ``components`` has as many components as entries. Components
    without variance have null as ``whitened`` (and no part in ``identity_error``); if all vectors of a length are
    equal, ``explained`` is null too. Null and repeated ids are kept, other columns are ignored, an empty table
    gives no rows.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights: one or count")
    counted = weights == "count"
    rows = _grid(vectors, id_col, vec_col, scale)
    distinct = stored(rows.groupBy("x").agg(F.count("*").alias("copies")), "vectors")
    sums = distinct.mapInArrow(_sums(counted), "d int, i int, s decimal(38,0)").groupBy("d", "i").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
    found = sums.toArrow().to_pylist()
    models = {}
    for d in sorted({r["d"] for r in found}):
        s = {r["i"]: int(r["s"]) for r in found if r["d"] == d}
        models[d] = Model(s[-1], [s[i] for i in range(d)])
    cells = distinct.mapInArrow(_products(models, counted), "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    of = cells.column("d").to_numpy()
    for d, m in models.items():
        part = cells.filter(pa.array(of == d))
        c = np.zeros((d, d))
        i, j = part.column("i").to_numpy(), part.column("j").to_numpy()
        c[i, j] = c[j, i] = part.column("v").to_numpy() / m.n
        m.solve(c, components)
    white = stored(distinct.mapInArrow(_project(models), "x array<long>, copies long, deviation decimal(38,0), w array<double>"), "whitened")
    errors = _identity_errors(white, models, counted)
    joined = _join_back(rows, white).select("given", "x", "deviation", F.posexplode("w").alias("k", "whitened"))
    return joined.select(
        F.col("given").alias(id_col), (F.col("k") + 1).cast("int").alias("component"), _by_length({d: m.n for d, m in models.items()}, "long").alias("n"), "deviation", "whitened",
        F.get(_by_length({d: m.explained for d, m in models.items()}, "array<double>"), F.col("k")).alias("explained"), _by_length(errors, "double").alias("identity_error"),
    )


def _join_back(rows: DataFrame, white: DataFrame) -> DataFrame:
    """Rows with what their vector has; vectors of many rows, at most ``HOT_SHARE`` of them, are shipped instead of shuffled."""
    total = white.agg(F.sum("copies")).first()[0] or 0
    limit = max(2, -(-total // HOT_SHARE))
    hot = white.where(F.col("copies") >= limit)
    if hot.isEmpty():
        return rows.join(white, "x")
    few = F.broadcast(hot)
    return rows.join(few, "x").unionByName(rows.join(F.broadcast(hot.select("x")), "x", "left_anti").join(white.where(F.col("copies") < limit), "x"))


def digest(rows: DataFrame) -> DataFrame:
    """``deviation`` as long (a value beyond that range is an error, not another number)."""
    return rows.withColumn("deviation", F.col("deviation").cast("long"))
