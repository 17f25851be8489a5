"""Joins that add columns: attributes, flags, statistics, forecasts, nearest readings."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.columns import attach
from slotwise.functions.weather import DEFAULT_RAIN, DEFAULT_TEMPERATURE, rain_indicator
from slotwise.operators.baselines import nearest_in_time
from slotwise.operators.scans import as_of  # noqa: F401  (part of this module's interface)
from slotwise.session import stored


def add_attributes(df: DataFrame, dim: DataFrame, key: str, dim_key: str, cols: Sequence[str], prefix: str = "feature_") -> DataFrame:
    """Attributes of the entity; Spark broadcasts the dimension while its size allows."""
    d = dim.select(F.col(dim_key).alias(key), *[F.col(x).alias(f"{prefix}{x}") for x in cols])
    return df.join(d, key, "left")


def add_weather(df: DataFrame, weather: DataFrame, ts: str, cols: Sequence[str]) -> DataFrame:
    return df.join(weather.select(ts, *cols), ts, "left")


# Country codes and the flags they feed.
COUNTRY_FLAGS = {"DE": "is_german_holiday", "CH": "is_swiss_holiday", "FR": "is_french_holiday"}


def add_holiday_flags(df: DataFrame, holidays: DataFrame, ts: str, flags: dict[str, str] | None = None) -> DataFrame:
    """One boolean per country from a (date, country) table."""
    flags = flags or COUNTRY_FLAGS
    per_day = holidays.groupBy(F.col("date").alias("_d")).agg(*[F.max(F.col("country") == k).alias(n) for k, n in flags.items()])
    j = df.withColumn("_d", F.to_date(ts)).join(per_day, "_d", "left")
    return j.select(*df.columns, *[F.coalesce(n, F.lit(False)).alias(n) for n in flags.values()])


def holiday_combinations(flags: Sequence[str], weekend: Column) -> dict[str, Column]:
    any_h = F.greatest(*[F.col(f).cast("int") for f in flags], F.lit(0))
    return {"is_any_holiday": any_h, "holiday_weekend": any_h * weekend}


def add_group_stat(df: DataFrame, keys: Sequence[str], stats: dict[str, Column], suffix: str = "") -> DataFrame:
    """Grouped statistics joined back; partial sums before the shuffle instead of a window.

    The statistics are stored before the join is planned: while they are small, no row of ``df`` is shuffled.
    """
    g = df.groupBy(*keys).agg(*[e.alias(f"{n}{suffix}") for n, e in stats.items()])
    return attach(df, stored(g, "stats"), keys)


def join_forecast(actual: DataFrame, forecast: DataFrame, on: Sequence[str], y: str, pred: str, out: str = "residual") -> DataFrame:
    j = actual.join(forecast.select(*on, pred), list(on), "left")
    return j.withColumn(out, F.col(y) - F.col(pred))


def merge_predictions(actual: DataFrame, forecast: DataFrame, on: Sequence[str]) -> DataFrame:
    """All stamps of both sides."""
    return actual.join(forecast, list(on), "full")


def lag_join(df: DataFrame, keys: Sequence[str], ts: str, col: str, days: int, out: str) -> DataFrame:
    """Value of exactly ``days`` earlier, by an equi-join on the shifted stamp."""
    past = df.select(*keys, (F.col(ts) + F.make_dt_interval(days=F.lit(days))).alias(ts), F.col(col).alias(out))
    return df.join(past, [*keys, ts], "left")


def nearest_weather(df: DataFrame, weather: DataFrame, ts: str, temp: str = "temperature", rain: str = "rain", max_days: int = 7) -> DataFrame:
    """Reading of the row's full hour, else the nearest one; constants where there is none."""
    site = F.lit("site").alias("_site")
    hour = F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")
    d = df.withColumn("_hour", hour)
    targets = d.select(site, "_hour").distinct()
    hist = weather.select(site, F.col(ts), F.struct(F.col(temp).alias("t"), F.col(rain).alias("r")).alias("_w"))
    hit = nearest_in_time(targets, hist, "_site", "_hour", ts, "_w", "_w", max_days, weekday_bias_hours=0).drop("_site")
    j = d.join(hit, "_hour", "left")
    mm = F.coalesce(F.col("_w.r"), F.lit(DEFAULT_RAIN))
    return j.select(
        *df.columns, F.coalesce(F.col("_w.t"), F.lit(DEFAULT_TEMPERATURE)).alias(temp), rain_indicator(mm).alias(rain), mm.alias(f"{rain}_mm")
    )


def match_names(left: DataFrame, right: DataFrame, left_name: str, right_name: str, key, right_id: str) -> DataFrame:
    """Left names with the id they match on a normalised key; unmatched ones keep NULL.

    Several right names with one key count as one, the smallest id wins.
    """
    r = right.select(key(right_name).alias("_k"), F.col(right_id)).groupBy("_k").agg(F.min(right_id).alias(right_id))
    return left.withColumn("_k", key(left_name)).join(r, "_k", "left").withColumnRenamed("_k", "match_key")
