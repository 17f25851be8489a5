"""Stored slot tables on plain parquet: write, keyed upsert, retention, range reads.

A store is a folder of parquet files below ``date=/writer=/batch_id=/written=``. A batch is known by its
writer (one per run of a job) and its number; ``written`` is the clock of the first attempt in microseconds.
The newest batch that holds a (key, time) is the valid one: by ``written``, then number, then writer. Files
are only ever added, except that a repeated batch replaces its own and retention drops old days.
"""
from __future__ import annotations

import re
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.columns import as_list
from slotwise.functions.text import service_key

#: Partition columns of a store, in the order of its folders.
LAYOUT = ("date", "writer", "batch_id", "written")


def write_table(df: DataFrame, path: str, partition_by: str | Sequence[str] = ()) -> None:
    """Parquet; AQE balances the files of each partition and splits hot ones."""
    cols = as_list(partition_by)
    d = df.hint("rebalance", *cols) if cols else df
    d.write.mode("overwrite").partitionBy(*cols).parquet(path)


def write_per_key(df: DataFrame, key: str, path: str, out: str = "ride") -> None:
    """One folder per key, named by the normalised key."""
    write_table(df.withColumn(out, service_key(key)), path, out)


def write_report(df: DataFrame, path: str, fmt: str = "csv", sep: str = ",") -> None:
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("sep", sep).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(f"unknown report format {fmt}")


def newest(df: DataFrame, keys: Sequence[str], version: str | Column, keep: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the one with the greatest version; reduced before the shuffle."""
    rest = list(keep) if keep is not None else [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def _folders(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Partition folders of a store that match a pattern of names, relative to its root."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    depth = pattern.count("/") + 1
    return ["/".join(s.getPath().toString().split("/")[-depth:]) for s in found or []]


def _drop(spark: SparkSession, root: str, folders: Sequence[str]) -> None:
    for f in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{f}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _append(d: DataFrame, root: str, key: str, ts: str) -> None:
    """Rows with the layout columns; partitions that are written again are replaced."""
    w = d.hint("rebalance", "date").sortWithinPartitions(key, ts).write.mode("overwrite")
    w.option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(root)


def upsert(batch: DataFrame, root: str, key: str, ts: str, batch_id: int, version: str | None = None, writer: str = "main", keep_order: bool = True) -> None:
    """Write a batch under its writer and number; for equal (key, ts) the newest batch is the valid one.

    A repeated batch replaces all that its earlier attempts wrote, also on dates it no longer has, and keeps
    their place in the order (a new place with ``keep_order=False``, for rows derived from the present state of
    another store). Other batches are not touched. Several rows of one key in the batch are ordered by
    ``version`` when written, else (as ties are) by their values when read, so that a retry keeps the same one.
    """
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_.-]*", writer) or writer in ("NaN", "Infinity"):  # folders must read back as text
        raise ValueError(f"writer {writer!r}: a letter, then letters, digits, dots, dashes and underscores")
    spark = batch.sparkSession
    old = _folders(spark, root, f"date=*/writer={writer}/batch_id={int(batch_id)}/written=*")
    stamps = sorted({int(f.rsplit("=", 1)[1]) for f in old})
    written = stamps[0] if stamps and keep_order else time.time_ns() // 1000
    rest = [c for c in batch.columns if c not in (key, ts, *LAYOUT)]
    d = newest(batch, [key, ts], F.struct(version, *rest), rest) if version else batch.select(key, ts, *rest)
    d = d.withColumns({"date": F.to_date(ts), "writer": F.lit(writer), "batch_id": F.lit(int(batch_id)).cast("bigint"), "written": F.lit(written).cast("bigint")})
    _append(d, root, key, ts)
    if old:
        dates = {"date=" + ("__HIVE_DEFAULT_PARTITION__" if r.date is None else str(r.date)) for r in d.select("date").distinct().collect()}
        _drop(spark, root, [f for f in old if f.split("/")[0] not in dates or not f.endswith(f"={written}")])


def _valid(d: DataFrame, keys: Sequence[str], key: str, ts: str) -> DataFrame:
    rest = [c for c in d.columns if c not in (key, ts, *LAYOUT)]
    return newest(d, keys, F.struct("written", "batch_id", "writer", *rest), rest)


def read_store(spark: SparkSession, root: str, key: str, ts: str, first_date: str | None = None, last_date: str | None = None, dates: Sequence | None = None) -> DataFrame:
    """Valid rows of a store; the date range prunes partitions before batches are compared, and of a list of ``dates`` only those folders are listed."""
    wanted = None if dates is None else [f"{root}/{f}" for f in _folders(spark, root, "date=*") if f[5:] in {str(d) for d in dates}]
    d = spark.read.option("basePath", root).parquet(*wanted) if wanted else spark.read.parquet(root)
    if wanted == []:
        d = d.where("false")
    if first_date:
        d = d.where(F.col("date") >= F.lit(first_date).cast("date"))
    if last_date:
        d = d.where(F.col("date") <= F.lit(last_date).cast("date"))
    return _valid(d, [key, ts, "date"], key, ts)


def retain(spark: SparkSession, root: str, key: str, ts: str, cutoff: str) -> None:
    """Drop everything older than ``cutoff`` in place: whole days by their folders, the day of the cutoff by writing it anew.

    Files of later days are neither read nor written. Safe to repeat after an interruption.
    """
    day = str(cutoff)[:10]
    _drop(spark, root, [f for f in _folders(spark, root, "date=*") if f < f"date={day}"])
    batches = _folders(spark, root, f"date={day}/writer=*/batch_id=*/written=*")
    if not batches:
        return
    d = expire(spark.read.parquet(root).where(F.col("date") == F.lit(day).cast("date")), ts, cutoff)
    left = {f"date={r.date}/writer={r.writer}/batch_id={r.batch_id}/written={r.written}" for r in d.select(*LAYOUT).distinct().collect()}
    _append(d, root, key, ts)
    _drop(spark, root, [f for f in batches if f not in left])


def compact(spark: SparkSession, root: str, new_root: str, key: str, ts: str, cutoff: str | None = None) -> None:
    """Valid rows as a new store of one batch, optionally without rows older than ``cutoff``."""
    d = read_store(spark, root, key, ts, first_date=cutoff[:10] if cutoff else None)
    if cutoff:
        d = expire(d, ts, cutoff)
    upsert(d.drop("date"), new_root, key, ts, 0, writer="compact")


def expire(df: DataFrame, ts: str, cutoff: str) -> DataFrame:
    """Rows not older than the cutoff."""
    return df.where(F.col(ts) >= F.lit(cutoff).cast("timestamp_ntz"))


def read_span(spark: SparkSession, root: str, key: str, ts: str, value: str, start: str, hours: int) -> DataFrame:
    """Rows of one key in [start, start + hours), read from the days they lie in."""
    lo = F.lit(start).cast("timestamp_ntz")
    hi = lo + F.make_dt_interval(hours=F.lit(hours))
    d = spark.read.parquet(root).where((F.col("date") >= F.to_date(lo)) & (F.col("date") <= F.to_date(hi)))
    d = d.where((F.col(key) == value) & (F.col(ts) >= lo) & (F.col(ts) < hi))
    return _valid(d, [key, ts], key, ts) if "written" in d.columns else d.drop("date")
