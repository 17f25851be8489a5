"""Lag, rolling and rank features.

Frames inside one day are plain windows over (keys, day). Longer frames run in blocks.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.columns import as_list, attach
from slotwise.functions.calendar import flag
from slotwise.functions.order_stats import average_rank
from slotwise.operators.scans import day_chunk, over_previous_rows, trailing_time_mean

# Columns whose value depends on the target itself or on later rows of the day.
LEAKY = (
    "wait_trend_1h", "wait_acceleration", "wait_vs_hourly_expected", "is_daily_peak_so_far", "is_local_peak", "morning_avg_wait",
)


def day_features(df: DataFrame, keys: str | Sequence[str], ts: str, y: str, leaky: bool = False, fill: bool = True) -> DataFrame:
    """Within-day lags, trailing statistics, trend, opening distance; ``leaky`` adds LEAKY.

    One window order serves all of them, so each partition is sorted once. The running-peak
    flag is true on equality with the earlier maximum only.
    """
    ks = as_list(keys)
    d = df.withColumn("_day", F.to_date(ts)).withColumn("_hour", F.hour(ts))
    day = Window.partitionBy(*ks, "_day")
    w = day.orderBy(ts)
    past = lambda n: w.rowsBetween(-n, -1)
    v = F.col(y)
    lag1 = F.lag(v, 1).over(w)
    cols: dict[str, Column] = {
        "wait_time_lag_1h": lag1,
        "wait_time_lag_2h": F.lag(v, 2).over(w),
        "wait_time_lag_3h": F.lag(v, 3).over(w),
        "rolling_avg_2h": F.avg(v).over(past(2)),
        "rolling_avg_3h": F.avg(v).over(past(3)),
        "rolling_max_3h": F.max(v).over(past(3)),
        "wait_trend_2h": F.avg(v).over(past(2)) - F.lag(v, 2).over(w),
        "hours_since_opening": F.col("_hour") - F.min("_hour").over(day),
    }
    if leaky:
        cols |= {
            "wait_trend_1h": v - lag1,
            "wait_acceleration": (v - lag1) - (lag1 - F.lag(v, 2).over(w)),
            "is_daily_peak_so_far": flag(v == F.max(v).over(w.rowsBetween(Window.unboundedPreceding, -1))),
            "is_local_peak": flag((v > lag1) & (v > F.lead(v, 1).over(w))),
            "wait_vs_hourly_expected": F.when(F.count(F.lit(1)).over(day) > 1, v - F.avg(v).over(Window.partitionBy(*ks, "_day", "_hour"))),
        }
    d = d.withColumns(cols)
    if leaky:
        d = d.withColumn("morning_avg_wait", F.avg(F.when(F.col("hours_since_opening") <= 3, v)).over(day))
        cols["morning_avg_wait"] = F.lit(None)
    if fill:
        floats = [c for c, t in d.dtypes if c in cols and t == "double"]
        d = d.fillna(0.0, subset=floats)
    return d.drop("_day", "_hour")


def attendance_score(df: DataFrame, keys: str | Sequence[str], ts: str, y: str, recent: str = "rolling_avg_2h") -> DataFrame:
    """0-100 busyness: percentile rank of the wait, blended with that of the recent mean, and
    with the rank inside the hour where the hour has more than ten varied rows."""
    ks = as_list(keys)
    d = df.withColumn("_h", F.hour(ts)).withColumn("_lw", F.log1p(y)).withColumn("_lr", F.log1p(recent))
    d = average_rank(d, [(ks, "_lw", "_p1"), (ks, "_lr", "_p2"), ([*ks, "_h"], y, "_p3")])
    size = df.groupBy(*ks, F.hour(ts).alias("_h")).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp(y).alias("_sd"))
    d = attach(d, size, [*ks, "_h"])
    blend = 0.7 * F.col("_p1") * 100 + 0.3 * F.col("_p2") * 100
    score = F.when((F.col("_n") > 10) & (F.col("_sd") > 0), 0.8 * blend + 0.2 * F.col("_p3") * 100).otherwise(blend)
    out = d.withColumn("attendance_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
    return out.drop("_h", "_lw", "_lr", "_p1", "_p2", "_p3", "_n", "_sd")


def long_lags(df: DataFrame, keys: str | Sequence[str], ts: str, cols: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """``<col>_lag_<n>`` over rows of the key, also across days."""
    exprs = lambda w: {f"{c}_lag_{n}": F.lag(c, n).over(w) for c in cols for n in lags}
    return over_previous_rows(df, keys, ts, max(lags), exprs, day_chunk(ts)).drop("row_idx")


def trailing_mean(df: DataFrame, keys: str | Sequence[str], ts: str, y: str, n: int, out: str) -> DataFrame:
    """Mean of the row and its ``n - 1`` predecessors."""
    exprs = lambda w: {out: F.avg(y).over(w.rowsBetween(-(n - 1), 0))}
    return over_previous_rows(df, keys, ts, n, exprs, day_chunk(ts)).drop("row_idx")


def lag_sequence(
    df: DataFrame, keys: str | Sequence[str], ts: str, cols: Sequence[str], n: int = 48, out: str = "history", complete: bool = True
) -> DataFrame:
    """The previous ``n`` rows as an array of structs with their stamp, oldest first."""
    item = F.struct(F.col(ts).alias("at"), *[F.col(c) for c in cols])
    exprs = lambda w: {out: F.collect_list(item).over(w.rowsBetween(-n, -1))}
    d = over_previous_rows(df, keys, ts, n, exprs, day_chunk(ts))
    return d.where(F.size(out) == n) if complete else d


def same_day_mask(history: str, ts: str, opening_hour: int) -> Column:
    """Per history element: is it of the target's day, at or after opening?"""
    day = F.to_date(ts)
    return F.transform(history, lambda x: (x["at"].cast("date") == day) & (F.hour(x["at"]) >= opening_hour))


def valid_targets(df: DataFrame, ts: str, n: int = 48, lo: int = 11, hi: int = 17) -> DataFrame:
    """Rows with a full history inside the prediction hours."""
    return df.where((F.col("row_idx") >= n) & F.hour(ts).between(lo, hi))


def rolling_time_mean(df: DataFrame, keys: str | Sequence[str], ts: str, y: str, hours: int, out: str) -> DataFrame:
    """Mean over (t - hours, t]."""
    return trailing_time_mean(df, keys, ts, y, hours * 3600, out)


def template_row(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """First row of each group by time."""
    g = df.groupBy(*keys).agg(F.min_by(F.struct(ts, *cols), ts).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in (ts, *cols)])
