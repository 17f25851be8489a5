"""File sources with explicit schemas."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBSERVATION = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("ride_name", T.StringType()),
        T.StructField("wait_time", T.DoubleType()),
    ]
)
DIMENSION_ITEM = (
    "name string, attraction_type string, category string, max_height double, track_length double, max_speed double, "
    "g_force double, min_age int, min_height double, capacity_per_hour int"
)


def read_observations(spark: SparkSession, path: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Observations as (timestamp, ride_name, wait_time); ``mapping`` names the source columns.

    Only the mapped columns are read.
    """
    m = mapping or {f.name: f.name for f in OBSERVATION}
    schema = T.StructType([T.StructField(m[f.name], f.dataType) for f in OBSERVATION])
    df = spark.read.schema(schema).parquet(path)
    return df.select(*[F.col(m[f.name]).alias(f.name) for f in OBSERVATION])


def read_checkpoints(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All checkpoint files as one scan; files may lack columns, empty files add nothing."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.option("mergeSchema", True).parquet(*paths)


def read_dimension_json(
    spark: SparkSession, path: str, array_col: str, item: str = DIMENSION_ITEM, multi_line: bool = True
) -> DataFrame:
    """One row per object of the array held by each document."""
    df = spark.read.schema(f"`{array_col}` array<struct<{_as_struct(item)}>>").option("multiLine", multi_line).json(path)
    return df.select(F.explode(array_col).alias("x")).select("x.*")


def _as_struct(ddl: str) -> str:
    return ", ".join(f"{n}:{t}" for n, t in (p.split() for p in ddl.split(",")))
