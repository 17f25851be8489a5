"""Tables, intermediate results and size checks shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.session import shared_folder

#: A side is broadcast up to this many bytes (measured, see ``fits``); beyond it Spark's sort-merge join is used.
BROADCAST_BYTES = 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder of the session and read back.

    The files survive lost executors, give the planner exact sizes and keep later branches
    from computing ``df`` again.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df``, ``row_bytes`` each, are small enough for a broadcast (one aggregate)."""
    size = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= limit


def maybe_broadcast(df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size allows one, else as it is."""
    return F.broadcast(df) if fits(df, row_bytes, limit) else df


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
