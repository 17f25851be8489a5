"""JSON payloads to rows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed formats of the incoming payloads.
CHART_STAMP = "MM/dd/yy HH:mm:ss"
HOURLY_SCHEMA = "hourly struct<time:array<string>, temperature_2m:array<double>, rain:array<double>>"
RIDE = "struct<id:bigint, name:string, is_open:boolean, wait_time:double, last_updated:string>"
WRAPPER_SCHEMA = "status struct<http_code:int>, contents string"
CONTENTS_SCHEMA = f"lands array<struct<name:string, rides:array<{RIDE}>>>, rides array<{RIDE}>"


def parse_chart_points(df: DataFrame, col: str, ts: str = "timestamp", value: str = "wait_time") -> DataFrame:
    """``[["m/d/y H:M:S", v], ...]`` to one row per point; points with a bad stamp are dropped."""
    rest = [c for c in df.columns if c != col]
    d = df.select(*rest, F.explode(F.from_json(col, "array<array<string>>")).alias("p"))
    stamp = F.try_to_timestamp(F.col("p")[0], F.lit(CHART_STAMP)).cast("timestamp_ntz")
    return d.select(*rest, stamp.alias(ts), F.expr("try_cast(p[1] AS double)").alias(value)).where(F.col(ts).isNotNull())


def zip_series(df: DataFrame, cols: list[str]) -> DataFrame:
    """Parallel arrays to rows by position, up to the shortest; nothing if one is empty."""
    rest = [c for c in df.columns if c not in cols]
    n = F.least(*[F.size(c) for c in cols])
    cut = [F.slice(F.col(c), F.lit(1), n).alias(c) for c in cols]
    d = df.where(n > 0).select(*rest, *cut).select(*rest, F.posexplode(F.arrays_zip(*cols)).alias("pos", "z"))
    return d.select(*rest, "pos", *[F.col(f"z.{c}").alias(c) for c in cols])


def parse_hourly_payload(df: DataFrame, col: str) -> DataFrame:
    """Hourly weather document to rows (timestamp, temperature_C, rain_mm)."""
    h = df.select(F.from_json(col, HOURLY_SCHEMA).alias("j")).select("j.hourly.*")
    z = zip_series(h, ["time", "temperature_2m", "rain"])
    return z.select(
        F.try_to_timestamp("time").cast("timestamp_ntz").alias("timestamp"),
        F.col("temperature_2m").alias("temperature_C"), F.col("rain").alias("rain_mm"),
    )


def flatten_snapshot(df: DataFrame) -> DataFrame:
    """Live snapshot (wrapper with a JSON string inside) to one row per ride.

    Rides sit below lands or at the top level; the latter have no land name. Works on batch
    and streaming frames.
    """
    ok = df.where(F.col("status.http_code") == 200)
    c = ok.select(F.from_json("contents", CONTENTS_SCHEMA).alias("c"))
    none = F.array().cast(f"array<struct<land:string, ride:{RIDE}>>")
    nested = F.flatten(
        F.transform("c.lands", lambda l: F.transform(l["rides"], lambda r: F.struct(l["name"].alias("land"), r.alias("ride"))))
    )
    top = F.transform("c.rides", lambda r: F.struct(F.lit(None).cast("string").alias("land"), r.alias("ride")))
    rides = F.concat(F.coalesce(nested, none), F.coalesce(top, none))
    d = c.select(F.explode(rides).alias("x"))
    return d.select(
        F.col("x.land").alias("land"), F.col("x.ride.id").alias("id"), F.col("x.ride.name").alias("ride_name"),
        F.col("x.ride.is_open").alias("is_open"), F.col("x.ride.wait_time").alias("wait_time"),
        F.try_to_timestamp("x.ride.last_updated").cast("timestamp_ntz").alias("timestamp"),
    )
