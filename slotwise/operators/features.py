"""Feature matrices."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.columns import as_list, attach
from slotwise.functions import calendar as cal
from slotwise.functions import weather as wx
from slotwise.functions.arrays import one_hot
from slotwise.functions.order_stats import exact_quantiles
from slotwise.operators.windows import long_lags
from slotwise.session import cut_lineage, stored

# The service's default scaler.
FIXED_SCALER = {"temperature": (15.0, 8.0), "rain": (0.15, 0.36)}
PARTS = ["afternoon", "evening", "morning", "night"]
SEASON_NAMES = ["fall", "spring", "summer", "winter"]


def decompose(df: DataFrame, ts: str, open_t: str = "09:00", close_t: str = "21:00", closed: str = "closed") -> DataFrame:
    """Calendar parts, bands, cyclic encodings; closed is forced to 1 outside [open, close)."""
    parts = cal.date_parts(ts)
    cyc = cal.cyclic_features(ts)
    shut = ~((cal.time_key(ts) >= cal.hhmm_minutes(open_t)) & (cal.time_key(ts) < cal.hhmm_minutes(close_t)))
    was = F.coalesce(wx.truth_int(closed), F.lit(0)) if closed in df.columns else F.lit(0)
    return df.withColumns(
        {
            **{n: parts[n] for n in ("year", "month", "day", "weekday", "hour", "minute")},
            "is_weekend": cal.day_flags(ts)["is_weekend"],
            "part_of_day": cal.part_of_day(ts), "season": cal.season(ts),
            **{n: e for n, e in cyc.items() if not n.startswith("doy")},
            closed: F.when(shut, 1).otherwise(was),
        }
    )


def standardise(df: DataFrame, keys: str | Sequence[str], cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / sample deviation per key, raw values kept as ``<col>_unscaled``.

    No deviation gives 0. Statistics are one partial aggregation, stored before the join back is planned: while
    they are small, no row of ``df`` is shuffled.
    """
    ks = as_list(keys)
    ref = fit_on if fit_on is not None else df
    st = ref.groupBy(*ks).agg(*[e for x in cols for e in (F.avg(x).alias(f"_m_{x}"), F.stddev_samp(x).alias(f"_s_{x}"))])
    d = attach(df, stored(st, "stats"), ks)
    new: dict[str, Column] = {}
    for x in cols:
        new[f"{x}_unscaled"] = F.col(x)
        z = F.try_divide(F.col(x) - F.col(f"_m_{x}"), F.col(f"_s_{x}"))
        new[x] = F.when(F.col(x).isNotNull(), F.coalesce(z, F.lit(0.0)))
    return d.withColumns(new).drop(*[f"_{p}_{x}" for x in cols for p in "ms"])


def scale_fixed(df: DataFrame, params: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    params = params or FIXED_SCALER
    return df.withColumns({f"{x}_unscaled": F.col(x) for x in params} | {x: (F.col(x) - m) / s for x, (m, s) in params.items()})


def recent_scaler(df: DataFrame, keys: str | Sequence[str], cols: Sequence[str], min_rows: int = 10, min_valid: int = 5) -> DataFrame:
    """Mean and population deviation per key after cutting values beyond 1.5 IQR, column by
    column; the fixed scaler for keys with too little data."""
    ks = as_list(keys)
    sizes = df.groupBy(*ks).agg(F.count(F.lit(1)).alias("_rows"))
    d = df.select(*ks, *cols)
    for i, x in enumerate(cols):
        if i:  # the next column is trimmed on what this one left
            d = cut_lineage(d)
        q = exact_quantiles(d, ks, x, {"_q1": 0.25, "_q3": 0.75})
        iqr = F.col("_q3") - F.col("_q1")
        d = attach(d, q, ks).where(F.col(x).between(F.col("_q1") - 1.5 * iqr, F.col("_q3") + 1.5 * iqr)).drop("_q1", "_q3")
    st = d.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("_valid"),
        *[e for x in cols for e in (F.avg(x).alias(f"_m_{x}"), F.stddev_pop(x).alias(f"_s_{x}"))],
    )
    j = attach(sizes, st, ks)
    ok = (F.col("_rows") >= min_rows) & (F.coalesce("_valid", F.lit(0)) >= min_valid)
    out = []
    for x in cols:
        m, s = FIXED_SCALER.get(x, (0.0, 1.0))
        out.append(F.when(ok, F.col(f"_m_{x}")).otherwise(m).alias(f"{x}_mean"))
        out.append(F.when(ok, F.when(F.col(f"_s_{x}") == 0, 1.0).otherwise(F.col(f"_s_{x}"))).otherwise(s).alias(f"{x}_scale"))
    return j.select(*ks, *out, ok.alias("fitted"))


def categories(df: DataFrame, col: str, most: int = 1000) -> list[str]:
    """Sorted distinct values, as they become column names; more than ``most`` are an error (``one_hot_vector`` takes any number)."""
    found = [str(r[0]) for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} values: name the ones wanted, or use one_hot_vector")
    return sorted(found)


def one_hot_vector(df: DataFrame, col: str, out: str, fit_on: DataFrame | None = None) -> DataFrame:
    """One sparse vector per row for any number of categories; NULL and unseen values share the last place."""
    named = lambda d: d.withColumn("_c", F.col(col).cast("string"))
    steps = [
        StringIndexer(inputCol="_c", outputCol="_i", stringOrderType="alphabetAsc", handleInvalid="keep"),
        OneHotEncoder(inputCol="_i", outputCol=out, dropLast=False),
    ]
    model = Pipeline(stages=steps).fit(named(fit_on if fit_on is not None else df))
    return model.transform(named(df)).drop("_c", "_i")


def hot_place(vector: str) -> Column:
    """0-based place of the one in a sparse one-hot vector, read from its stored index, so the cost does not grow with its size."""
    return F.get(F.unwrap_udt(vector)["indices"], 0)


def vector_size(vector: str) -> Column:
    """Number of places of a sparse vector."""
    return F.unwrap_udt(vector)["size"]


def one_hot_columns(df: DataFrame, col: str, values: Sequence[str] | None = None, prefix: str | None = None) -> DataFrame:
    """0/1 columns over the global categories; unknown values are 0 everywhere."""
    values = list(values) if values is not None else categories(df, col)
    return df.withColumns(one_hot(col, values, prefix or f"{col}_"))


def polynomial(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Squares and pairwise products next to the columns (degree two, no bias)."""
    new = {}
    for i, a in enumerate(cols):
        for b in cols[i:]:
            new[f"{a}^2" if a == b else f"{a} {b}"] = F.col(a) * F.col(b)
    return df.withColumns(new)


def seasonal_frame(df: DataFrame, ts: str, y: str, temp: str = "temperature", rain: str = "rain", include_y: bool = True) -> DataFrame:
    """ds, y and the regressors of the seasonal model."""
    wk = cal.day_flags(ts)["is_weekend"]
    f = wx.weather_flags(temp, rain)
    i = wx.interactions(temp, rain, wk, F.hour(ts), F.lit(0), F.lit(0))
    cols = [
        F.col(ts).alias("ds"), *([F.col(y).alias("y")] if include_y else []), F.col(temp).alias("temperature"), F.col(rain).alias("rain"),
        wk.alias("is_weekend"), f["temp_squared"].alias("temp_squared"), f["high_temp"].alias("high_temp"), f["any_rain"].alias("any_rain"),
        i["temp_weekend"].alias("temp_weekend"), i["rain_weekend"].alias("rain_weekend"),
        *[e.alias(n) for n, e in cal.era_flags(ts).items()],
    ]
    return df.select(*[x for x in df.columns if x not in (ts, y, temp, rain)], *cols)


def boosted_frame(
    df: DataFrame, keys: str | Sequence[str], ts: str, y: str, temp: str, rain: str, lag_cols: Sequence[str] = (), lags: Sequence[int] = (48, 96, 336, 672)
) -> DataFrame:
    """Rush flags, weather bands, interactions, shifted seasons and long lags."""
    fl = cal.day_flags(ts)
    d = long_lags(df, keys, ts, lag_cols, lags) if lag_cols else df
    i = wx.interactions(temp, rain, fl["is_weekend"], F.hour(ts), fl["morning_rush"], fl["afternoon_rush"])
    return d.withColumns(
        {
            "hour": F.hour(ts), "minute": F.minute(ts), "day_of_week": F.weekday(ts), "month": F.month(ts), "day_of_month": F.dayofmonth(ts),
            **{n: fl[n] for n in ("is_weekend", "morning_rush", "lunch_time", "afternoon_rush", "evening")},
            **{n: e for n, e in wx.weather_flags(temp, rain).items() if n != "has_rain"},
            **{n: e for n, e in i.items() if n != "weekend_hour"},
            **cal.shifted_season_flags(ts),
        }
    )
