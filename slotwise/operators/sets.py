"""Unions, differences, ranking and previews."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.columns import as_list


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """By name; columns of one side only are NULL on the other."""
    return a.unionByName(b, allowMissingColumns=True)


def merge_history(history: DataFrame, predictions: DataFrame, keys: Sequence[str], source: str = "source") -> DataFrame:
    """Readings and earlier predictions; a reading wins on equal keys, the origin is kept."""
    u = union_all(
        history.withColumn(source, F.lit("history")), predictions.withColumn(source, F.lit("prediction"))
    )
    rest = [x for x in u.columns if x not in keys]
    g = u.groupBy(*keys).agg(F.min_by(F.struct(*rest), source).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{x}").alias(x) for x in rest])


def top_n(df: DataFrame, by: str, n: int, ties: Sequence[str] = (), largest: bool = True) -> DataFrame:
    first = F.col(by).desc_nulls_last() if largest else F.col(by).asc_nulls_last()
    return df.orderBy(first, *ties).limit(n)


def picks_per_group(df: DataFrame, group: str, quota: dict[str, int], order: Sequence[str | Column]) -> DataFrame:
    """The first rows of each group up to the group's quota."""
    top = max(quota.values())
    w = Window.partitionBy(group).orderBy(*order)
    limit = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    d = df.where(F.col(group).isin(list(quota))).withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= top)
    return d.where(F.col("pick") <= F.element_at(limit, F.col(group)))


def next_rows(df: DataFrame, ts: str, after: Column, n: int) -> DataFrame:
    return df.where(F.col(ts) > after).orderBy(ts).limit(n)


def preview(df: DataFrame, keys: str | Sequence[str], order: Sequence[str], n: int = 5) -> DataFrame:
    """First and last ``n`` rows per key."""
    ks = as_list(keys)
    up = Window.partitionBy(*ks).orderBy(*[F.col(o).asc() for o in order])
    down = Window.partitionBy(*ks).orderBy(*[F.col(o).desc() for o in order])
    head = df.withColumn("rank", F.row_number().over(up)).where(F.col("rank") <= n).withColumn("part", F.lit("head"))
    tail = df.withColumn("rank", F.row_number().over(down)).where(F.col("rank") <= n).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)
