"""Exact order statistics whose state does not grow with the group.

``percentile``/``median`` keep every distinct value of a group in one buffer. Here values are counted in bins
of a histogram first: a value's bin is the value rounded to a number of leading bits, so bins are in
the order of the values and as fine for small values as for large ones. Only bins that hold a wanted
rank are looked into, in a second, finer histogram and at last value by value. Rounding to 12, then 33
of the 53 bits, no window ever orders more than 2**21 rows of one bin, however many rows a group has.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.columns import as_list, attach

#: Leading bits kept by the coarse and by the fine bins.
_COARSE, _FINE = 12, 33


def leading_bits(v: Column, bits: int) -> Column:
    """A double rounded to its first ``bits`` significant bits; never decreasing in ``v``.

    The classic split by a multiplication: c = v (2**(53 - bits) + 1), then c - (c - v). Infinities and NaN stay.
    """
    large = F.abs(v) > 1e280
    w = F.when(large, v * 2.0**-64).otherwise(v)  # keeps the product finite
    c = w * float(2 ** (53 - bits) + 1)
    head = c - (c - w)
    return F.when(F.abs(v) < float("inf"), F.when(large, head * 2.0**64).otherwise(head)).otherwise(v)


def _before(keys: Sequence[str], order: str) -> Column:
    """Number of values (column ``_c``) in the rows before, within ``keys``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_c").over(w), F.lit(0))


def exact_quantiles(
    df: DataFrame, keys: str | Sequence[str], col: str, probs: dict[str, float], drop_n: bool = True
) -> DataFrame:
    """Linear-interpolated quantiles per key: ``probs`` maps output column to probability."""
    keys = as_list(keys)
    k = keys or ["_all"]
    d = df if keys else df.withColumn("_all", F.lit(1))
    d = d.where(F.col(col).isNotNull()).select(*k, (F.col(col).cast("double") + 0.0).alias("_v"))
    d = d.withColumn("_b", leading_bits(F.col("_v"), _COARSE))

    low = lambda p: F.floor(F.lit(float(p)) * (F.col("_n") - 1))
    high = lambda p: F.ceil(F.lit(float(p)) * (F.col("_n") - 1))
    ranks = F.array_distinct(F.array(*[f(p) for p in probs.values() for f in (low, high)]))

    def holding(bins: DataFrame) -> DataFrame:
        """Bins that hold some of the wanted ranks, and those ranks."""
        held = F.filter(ranks, lambda r: (r >= F.col("_base")) & (r < F.col("_base") + F.col("_c")))
        return bins.withColumn("_r", held).where(F.size("_r") > 0)

    coarse = d.groupBy(*k, "_b").agg(F.count(F.lit(1)).alias("_c"))
    coarse = holding(coarse.withColumns({"_base": _before(k, "_b"), "_n": F.sum("_c").over(Window.partitionBy(*k))}))

    near = attach(d, coarse.select(*k, "_b", "_base", "_n"), [*k, "_b"], "inner").withColumn("_s", leading_bits(F.col("_v"), _FINE))
    near = near.groupBy(*k, "_b", "_s", "_v").agg(F.count(F.lit(1)).alias("_c"), F.max("_base").alias("_base"), F.max("_n").alias("_n"))
    near = near.repartition(*k, "_b", "_s")  # counted rows; one shuffle for the fine bins and for the values in them
    fine = near.groupBy(*k, "_b", "_s").agg(F.sum("_c").alias("_c"), F.max("_base").alias("_base"), F.max("_n").alias("_n"))
    fine = holding(fine.withColumn("_base", F.col("_base") + _before([*k, "_b"], "_s")))

    last = attach(near.drop("_base", "_n"), fine.select(*k, "_b", "_s", "_base", "_n"), [*k, "_b", "_s"], "inner")
    last = holding(last.withColumn("_base", F.col("_base") + _before([*k, "_b", "_s"], "_v")))
    found = last.select(*k, "_n", "_v", F.explode("_r").alias("_rank"))
    at = lambda rank: F.max(F.when(F.col("_rank") == rank, F.col("_v")))
    part = lambda p: F.max(F.lit(float(p)) * (F.col("_n") - 1) - low(p))
    between = lambda a, z, p: F.when(a == z, a).otherwise(a + (z - a) * part(p))
    out = found.groupBy(*k).agg(*[between(at(low(p)), at(high(p)), p).alias(n) for n, p in probs.items()], F.max("_n").alias("n_values"))
    if drop_n:
        out = out.drop("n_values")
    return out if keys else out.drop("_all")


def exact_quantiles_of(
    df: DataFrame, keys: str | Sequence[str], cols: dict[str, dict[str, float]]
) -> DataFrame:
    """Quantiles of several columns from one pass: column -> {output: probability}.

    The columns become rows first; all must ask for the same probabilities.
    """
    keys = as_list(keys)
    probs = {f"_p{i}": p for i, p in enumerate(next(iter(cols.values())).values())}
    if any(list(q.values()) != list(probs.values()) for q in cols.values()):
        raise ValueError("same probabilities needed for all columns")
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(keys, list(cols), "_col", "_val")
    q = exact_quantiles(long, [*keys, "_col"], "_val", probs)
    outs = [
        F.max(F.when(F.col("_col") == c, F.col(f"_p{i}"))).alias(o) for c, names in cols.items() for i, o in enumerate(names)
    ]
    return q.groupBy(*keys).agg(*outs)


def rank_table(df: DataFrame, keys: str | Sequence[str], col: str, out: str) -> DataFrame:
    """Percentile rank of every distinct value per key, ties averaged: (mean rank) / n.

    Distinct values are counted first; what comes before a value is the sum of three cumulative counts, over the
    coarse bins of its key, the fine bins of its coarse bin and the values of its fine bin.
    """
    k = as_list(keys)
    vc = df.where(F.col(col).isNotNull()).groupBy(*k, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    v = F.col("_v").cast("double") + 0.0
    vc = vc.withColumns({"_b": leading_bits(v, _COARSE), "_s": leading_bits(v, _FINE)}).repartition(*k, "_b", "_s")
    fine = vc.groupBy(*k, "_b", "_s").agg(F.sum("_c").alias("_c"))
    coarse = fine.groupBy(*k, "_b").agg(F.sum("_c").alias("_c"))
    coarse = coarse.select(*k, "_b", _before(k, "_b").alias("_base"), F.sum("_c").over(Window.partitionBy(*k)).alias("_n"))
    fine = attach(fine.withColumn("_off", _before([*k, "_b"], "_s")), coarse, [*k, "_b"])
    fine = fine.select(*k, "_b", "_s", (F.col("_off") + F.col("_base")).alias("_off"), "_n")
    vc = attach(vc.withColumn("_before", _before([*k, "_b", "_s"], "_v")), fine, [*k, "_b", "_s"])
    rank = F.col("_off") + F.col("_before") + (F.col("_c") + 1) / 2
    return vc.select(*k, F.col("_v").alias(col), (rank / F.col("_n")).alias(out))


def average_rank(df: DataFrame, ranks: Sequence[tuple[Sequence[str], str, str]]) -> DataFrame:
    """Several percentile ranks (keys, column, output), each built from ``df`` itself."""
    d = df
    for keys, col, out in ranks:
        d = attach(d, rank_table(df, keys, col, out), [*keys, col])
    return d
