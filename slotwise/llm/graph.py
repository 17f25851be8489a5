"""Connected components of a link table, as alternating large-star and small-star joins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import stored


def _toward(pairs: DataFrame) -> DataFrame:
    """Links as (hi, lo), each once and without loops."""
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, label`` for every node of ``links``; the label is the smallest node reachable.

    Each round joins links with the smallest neighbour of a node, which partial aggregates find,
    so that no neighbour list is gathered, and writes the new links to the shared folder. The
    number of rounds grows with the logarithm of the longest chain. No links, no rows.
    """
    e = stored(_toward(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links")
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _toward(both.where("v > u").join(least, "u").select("v", F.col("m")).toDF("u", "v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select("v", "m").toDF("u", "v").union(lowest.select("u", F.col("m").alias("v")))
        e = stored(_toward(small), "links")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
