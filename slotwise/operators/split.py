"""Time splits as a column: rows have no position in Spark."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.columns import as_list
from slotwise.operators.scans import day_chunk, row_index


def by_boundaries(df: DataFrame, ts: str, val_from: str, test_from: str, out: str = "split") -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    e = F.when(F.col(ts) < at(val_from), "train").when(F.col(ts) < at(test_from), "val").otherwise("test")
    return df.withColumn(out, e)


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    n = df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy())
    return n.withColumn("pct", F.col("n_rows") * 100.0 / total)


def chronological(df: DataFrame, keys: str | Sequence[str], ts: str, share: float = 0.8, out: str = "split") -> DataFrame:
    """The first ``share`` of each key's rows by time is train, the rest test."""
    d = row_index(df, keys, ts, day_chunk(ts), "_i", total="_n")
    e = F.when(F.col("_i") < F.floor(F.col("_n") * share), "train").otherwise("test")
    return d.withColumn(out, e).drop("_i", "_n")


def tiles(df: DataFrame, keys: str | Sequence[str], ts: str, n: int, out: str = "tile") -> DataFrame:
    """1-based equal tiles by time; the first ``rows mod n`` tiles hold one row more."""
    d = row_index(df, keys, ts, day_chunk(ts), "_i", total="_n")
    base, extra = F.floor(F.col("_n") / n), F.col("_n") % n
    long_part = extra * (base + 1)
    tile = F.when(F.col("_i") < long_part, F.floor(F.try_divide(F.col("_i"), base + 1))).otherwise(
        extra + F.floor(F.try_divide(F.col("_i") - long_part, base))
    )
    return d.withColumn(out, (tile + 1).cast("int")).drop("_i", "_n")


def expanding_folds(df: DataFrame, keys: str | Sequence[str], ts: str, folds: int = 5) -> DataFrame:
    """Fold k trains on tiles 1..k and tests on tile k+1: one row per (row, fold it is in)."""
    d = tiles(df, keys, ts, folds + 1)
    roles = F.explode(F.sequence(F.greatest(F.col("tile") - 1, F.lit(1)), F.lit(folds)))
    return d.withColumn("fold", roles).withColumn(
        "role", F.when(F.col("tile") == F.col("fold") + 1, "test").otherwise("train")
    )


def size_gate(df: DataFrame, key: str, minimum: dict[str, int], split: str = "split") -> DataFrame:
    """Keys whose every split holds at least its minimum number of rows."""
    n = df.groupBy(key).agg(*[F.count_if(F.col(split) == s).alias(f"n_{s}") for s in minimum])
    ok: Column = F.lit(True)
    for s, m in minimum.items():
        ok = ok & (F.col(f"n_{s}") >= m)
    return df.join(n.where(ok).select(key), as_list(key), "left_semi")
