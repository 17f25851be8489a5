"""Shards that all match the mixture of sources: proportional stratified interleaving.

The rows of a source are shuffled by a seeded hash of their id and ranked; row r (from 0) of a source of n rows
gets the fraction (r + phase) / n, where the phase of a source, between 0 and 1, is hashed as well. Sorted by
fraction, every stretch of rows holds each source in proportion, to within about one row, and small
sources are spread evenly. The sorted rows are cut into shards of equal row counts.

No task ranks a whole source or the whole table: both ranks are taken in two levels, inside buckets of the
ordering key (about the square root of the row count) and, from the bucket counts, before them.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, VariantType

from slotwise.llm.common import stored

_NEW = ("size", "text_crc32", "law", "shard", "slot")


def _hashable(kind: DataType) -> bool:
    text = kind.simpleString()
    return not isinstance(kind, (MapType, VariantType)) and "map<" not in text and "variant" not in text


def _unit(c: Column) -> Column:
    """First 32 bits of a hex digest, as a long."""
    return F.conv(F.substring(c, 1, 8), 16, 10).cast("long")


def interleave(docs: DataFrame, shards: int = 8, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: int = 11, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns or the ``columns`` named, with ``size`` (UTF-8 bytes and one), ``text_crc32``, ``law`` (``rows``), ``shard`` from 0 and ``slot`` (place in the shard, gapless from 0).

    Shards differ by one row at most. Null texts are empty; null sources form a source of their own; null and
    repeated ids are rows like any others (ties are broken by a hash of the whole row; only equal rows
    change places). A column named like a new one is replaced by it. Fewer rows than shards leave some shards
    empty; an empty table gives no rows. Columns that are not named travel no further than the first read (texts need
    not be shuffled to be placed). ``docs`` is read twice and must give the same rows each time (store the
    result of a ``limit`` or of a random sample first).
    """
    total = docs.count()
    level = max(1, math.isqrt(total))
    names = docs.columns
    kinds = [f.dataType for f in docs.schema.fields]
    hidden = [f"__{i}" for i in range(len(names))]
    col = {n: F.col(h) for n, h in zip(names, hidden)}
    rows = docs.toDF(*hidden)
    text = F.coalesce(col[text_col], F.lit(""))
    ident = F.coalesce(col[id_col].cast("string"), F.lit(""))
    source = F.coalesce(F.concat(F.lit("="), col[source_col].cast("string")), F.lit(""))
    keyed = rows.withColumns({"__s": source, "__h": F.md5(F.concat(F.lit(f"{seed}:"), ident).cast("binary"))})
    keyed = keyed.withColumn("__b", F.shiftright(_unit(F.col("__h")) * level, 32))
    counts = keyed.groupBy("__s", "__b").agg(F.count("*").alias("__k"))
    by = Window.partitionBy("__s")
    phase = (_unit(F.md5(F.concat(F.lit(f"{seed}:"), F.expr("substring(__s, 2)")).cast("binary"))) + 0.5) / float(1 << 32)
    counts = counts.select(
        "__s", "__b", F.coalesce(F.sum("__k").over(by.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__k").over(by).alias("__n"), phase.alias("__phase")
    )
    measured = keyed.withColumns(
        {
            "__size": F.octet_length(text).cast("long") + 1,
            "__crc": F.crc32(text.cast("binary")),
            "__tie": F.xxhash64(*[F.col(h) for h, k in zip(hidden, kinds) if _hashable(k)]),
        }
    )
    rank = F.row_number().over(Window.partitionBy("__s", "__b").orderBy("__h", "__crc", "__size", "__tie"))
    ranked = measured.join(counts, ["__s", "__b"]).withColumn("__r", F.col("__before") + rank - 1)
    fraction = (F.col("__r") + F.col("__phase")) / F.col("__n")
    ranked = ranked.withColumn("__f", fraction).withColumn("__c", F.least(F.floor(F.col("__f") * level), F.lit(level - 1)))
    carried = {h: n for h, n in zip(hidden, names) if n not in _NEW and (columns is None or n in columns)}
    return _cut(ranked, carried, total, level, shards)


def _cut(ranked: DataFrame, carried: dict[str, str], total: int, level: int, shards: int) -> DataFrame:
    """Rows in the order of their fractions, in shards of equal counts; ``carried`` columns under their own names."""
    kept = stored(ranked.select(*carried, "__s", "__size", "__crc", "__r", "__f", "__c"), "ranked")
    cells = kept.groupBy("__c").agg(F.count("*").alias("__k"))
    # one row per bucket: the square root of the row count
    cells = cells.select("__c", F.coalesce(F.sum("__k").over(Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__c").orderBy("__f", "__s", "__r"))
    out = kept.join(cells, "__c").withColumn("__g", F.col("__before") + place - 1)
    out = out.withColumn("__shard", F.expr(f"int(__g * {shards} div {max(total, 1)})"))
    slot = F.expr(f"__g - (__shard * bigint({total}) + {shards - 1}) div {shards}")
    old = [F.col(h).alias(n) for h, n in carried.items()]
    return out.select(*old, F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("__shard").alias("shard"), slot.alias("slot"))


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1 << 20) -> None:
    """One folder per shard (``shard=0``, ...) of Parquet files, each in the order of its slots."""
    part = F.floor(F.col("slot") / rows_per_file)
    files = sharded.withColumn("__part", part).repartition("shard", "__part").sortWithinPartitions("shard", "slot").drop("__part")
    files.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)
