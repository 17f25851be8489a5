"""Names of the standard columns and checks on them."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "ride_name"
TS = "timestamp"
WAIT = "wait_time"


def as_list(x: str | Sequence[str] | None) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def micros(stamp: str | Column) -> Column:
    """Microseconds of a TIMESTAMP_NTZ since 1970, from a difference of stamps, so that no time zone takes part."""
    at = F.col(stamp) if isinstance(stamp, str) else stamp
    span = at - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (span.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")


def instant(stamp: str | Column) -> Column:
    """TIMESTAMP of a TIMESTAMP_NTZ read as UTC, whatever the session's time zone."""
    return F.timestamp_micros(micros(stamp))


def wall_clock(at: Column) -> Column:
    """TIMESTAMP_NTZ in UTC of a TIMESTAMP, whatever the session's time zone."""
    return from_micros(F.unix_micros(at))


def from_micros(us: Column) -> Column:
    """TIMESTAMP_NTZ from microseconds since 1970."""
    seconds = (us.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def require(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Null-safe equality of all keys between two aliased frames."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def attach(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join the non-key columns of ``other`` on null-safe key equality.

    Grouping treats NULL as a value, so joining a per-group result back must do so too.
    """
    keys = list(keys)
    extra = [c for c in other.columns if c not in keys]
    if not keys:  # one row of overall statistics: a scalar subquery, not a join
        d = df.withColumn("_one", other.select(F.struct(*extra)).scalar())
        return d.select(*df.columns, *[F.col("_one")[c].alias(c) for c in extra])
    j = df.alias("l").join(other.alias("r"), same_keys("l", "r", keys), how)
    return j.select("l.*", *[F.col(f"r.{c}").alias(c) for c in extra])
