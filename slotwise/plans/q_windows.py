"""Window features, feature matrices, splits."""
from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.operators import evaluate, features, grid, split, windows
from slotwise.operators.baselines import Baselines
from slotwise.plans.registry import query
from slotwise.session import cut_lineage

R = lambda c, n=8: F.round(c, n)
K, T, W = "ride_name", "timestamp", "wait_time"
DAY = "PARTITION BY ride_name, CAST(timestamp AS DATE)"


def rounded(df, *cols, n=8):
    return df.withColumns({c: R(c, n) for c in cols})


def day(t, leaky=False, fill=False):
    return windows.day_features(t.hourly, K, T, W, leaky=leaky, fill=fill)


@query("win1_lags", f"SELECT ride_name, timestamp, round(lag(wait_time,1) OVER w, 8) AS wait_time_lag_1h, round(lag(wait_time,2) OVER w, 8) AS wait_time_lag_2h, round(lag(wait_time,3) OVER w, 8) AS wait_time_lag_3h FROM v_hourly WINDOW w AS ({DAY} ORDER BY timestamp)")
def win1(t):
    c = [f"wait_time_lag_{i}h" for i in (1, 2, 3)]
    return rounded(day(t).select(K, T, *c), *c)


@query("win2_trailing_mean", f"SELECT ride_name, timestamp, round(avg(wait_time) OVER ({DAY} ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 7) AS rolling_avg_2h, round(avg(wait_time) OVER ({DAY} ORDER BY timestamp ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 7) AS rolling_avg_3h FROM v_hourly")
def win2(t):
    return rounded(day(t).select(K, T, "rolling_avg_2h", "rolling_avg_3h"), "rolling_avg_2h", "rolling_avg_3h", n=7)


@query("win3_trailing_max", f"SELECT ride_name, timestamp, round(max(wait_time) OVER ({DAY} ORDER BY timestamp ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 8) AS rolling_max_3h FROM v_hourly")
def win3(t):
    return rounded(day(t).select(K, T, "rolling_max_3h"), "rolling_max_3h")


@query(
    "win4_trend",
    f"""SELECT ride_name, timestamp, round(wait_time - lag(wait_time,1) OVER w, 7) AS wait_trend_1h, round(avg(wait_time) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) - lag(wait_time,2) OVER w, 7) AS wait_trend_2h,
    round((wait_time - lag(wait_time,1) OVER w) - (lag(wait_time,1) OVER w - lag(wait_time,2) OVER w), 7) AS wait_acceleration FROM v_hourly WINDOW w AS ({DAY} ORDER BY timestamp)""",
)
def win4(t):
    c = ["wait_trend_1h", "wait_trend_2h", "wait_acceleration"]
    return rounded(day(t, True).select(K, T, *c), *c, n=7)


@query("win5_since_opening", f"SELECT ride_name, timestamp, CAST(hour(timestamp) - min(hour(timestamp)) OVER ({DAY}) AS INT) AS hours_since_opening FROM v_hourly")
def win5(t):
    return day(t).select(K, T, "hours_since_opening")


@query(
    "win6_morning_average",
    f"SELECT ride_name, timestamp, round(avg(CASE WHEN s <= 3 THEN wait_time END) OVER ({DAY}), 7) AS morning_avg_wait FROM (SELECT *, hour(timestamp) - min(hour(timestamp)) OVER ({DAY}) AS s FROM v_hourly)",
)
def win6(t):
    return rounded(day(t, True).select(K, T, "morning_avg_wait"), "morning_avg_wait", n=7)


@query(
    "win7_peaks",
    f"""SELECT ride_name, timestamp, CASE WHEN wait_time = max(wait_time) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS is_daily_peak_so_far,
    CASE WHEN wait_time > lag(wait_time) OVER w AND wait_time > lead(wait_time) OVER w THEN 1 ELSE 0 END AS is_local_peak FROM v_hourly WINDOW w AS ({DAY} ORDER BY timestamp)""",
)
def win7(t):
    return day(t, True).select(K, T, "is_daily_peak_so_far", "is_local_peak")


@query(
    "win8_hourly_deviation",
    "SELECT ride_name, timestamp, round(CASE WHEN count(*) OVER (PARTITION BY ride_name, CAST(timestamp AS DATE)) > 1 THEN wait_time - avg(wait_time) OVER (PARTITION BY ride_name, date_trunc('hour', timestamp)) END, 7) AS wait_vs_hourly_expected FROM v_half",
)
def win8(t):
    d = windows.day_features(t.half, K, T, W, leaky=True, fill=False)
    return rounded(d.select(K, T, "wait_vs_hourly_expected"), "wait_vs_hourly_expected", n=7)


@query(
    "win9_attendance_score",
    f"""WITH f AS (SELECT *, hour(timestamp) AS h, coalesce(avg(wait_time) OVER ({DAY} ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS r FROM (SELECT ride_name, timestamp, round(wait_time, 9) AS wait_time FROM v_hourly)),
    p AS (SELECT *, (rank() OVER (PARTITION BY ride_name ORDER BY ln(1+wait_time)) + (count(*) OVER (PARTITION BY ride_name, ln(1+wait_time)) - 1) / 2) / count(*) OVER (PARTITION BY ride_name) AS p1,
      (rank() OVER (PARTITION BY ride_name ORDER BY ln(1+r)) + (count(*) OVER (PARTITION BY ride_name, ln(1+r)) - 1) / 2) / count(*) OVER (PARTITION BY ride_name) AS p2,
      (rank() OVER (PARTITION BY ride_name, h ORDER BY wait_time) + (count(*) OVER (PARTITION BY ride_name, h, wait_time) - 1) / 2) / count(*) OVER (PARTITION BY ride_name, h) AS p3,
      count(*) OVER (PARTITION BY ride_name, h) AS n, stddev_samp(wait_time) OVER (PARTITION BY ride_name, h) AS sd FROM f)
    SELECT ride_name, timestamp, round(greatest(0, least(100, CASE WHEN n > 10 AND sd > 0 THEN 0.8*(0.7*p1*100+0.3*p2*100)+0.2*p3*100 ELSE 0.7*p1*100+0.3*p2*100 END)), 6) AS attendance_score FROM p""",
)
def win9(t):
    # ranks ask for equality, so the last bits of the slot averages must not matter
    d = cut_lineage(windows.day_features(rounded(t.hourly, W, n=9), K, T, W))
    return rounded(windows.attendance_score(d, K, T, W).select(K, T, "attendance_score"), "attendance_score", n=6)


@query(
    "win10_long_lags",
    "SELECT ride_name, timestamp, " + ", ".join(f"round(lag(wait_time,{n}) OVER w, 8) AS wait_time_lag_{n}" for n in (48, 96, 336, 672)) + " FROM v_half WINDOW w AS (PARTITION BY ride_name ORDER BY timestamp)",
)
def win10(t):
    d = windows.long_lags(t.half, K, T, [W], [48, 96, 336, 672])
    c = [f"wait_time_lag_{n}" for n in (48, 96, 336, 672)]
    return rounded(d.select(K, T, *c), *c)


@query(
    "win11_last_matches",
    """WITH r AS (SELECT *, (isodow(timestamp)-1)*1440+hour(timestamp)*60 AS dtk, row_number() OVER (PARTITION BY ride_name, isodow(timestamp), hour(timestamp) ORDER BY timestamp DESC) AS rn FROM v_hsplit WHERE split='train'),
    m AS (SELECT ride_name, dtk, avg(wait_time) AS s FROM r WHERE rn <= 4 GROUP BY 1, 2)
    SELECT f.ride_name, f.timestamp, round(coalesce(m.s, (SELECT avg(wait_time) FROM v_hsplit g WHERE split='train' AND g.ride_name=f.ride_name)), 7) AS yhat FROM v_hsplit f
    LEFT JOIN m ON m.ride_name=f.ride_name AND m.dtk=(isodow(f.timestamp)-1)*1440+hour(f.timestamp)*60 WHERE f.split='val'""",
)
def win11(t):
    s = t.hourly_split
    d = Baselines().seasonal_weekly(s.where("split='train'"), s.where("split='val'"))
    return rounded(d.select(K, T, "yhat"), "yhat", n=7)


@query("win12_trailing_48", "SELECT ride_name, timestamp, round(avg(wait_time) OVER (PARTITION BY ride_name ORDER BY timestamp ROWS BETWEEN 47 PRECEDING AND CURRENT ROW), 9) AS ma FROM v_hsplit WHERE split='train'")
def win12(t):
    d = windows.trailing_mean(t.hourly_split.where("split='train'"), K, T, W, 48, "ma")
    return rounded(d.select(K, T, "ma"), "ma", n=9)


RESID = "SELECT ride_name, timestamp, wait_time, wait_time - avg(wait_time) OVER (PARTITION BY ride_name) AS residual, row_number() OVER (PARTITION BY ride_name ORDER BY timestamp) - 1 AS i FROM v_half"


def with_residual(t):
    m = t.half.groupBy(K).agg(F.avg(W).alias("m"))
    return t.half.join(m, K).select(K, T, W, (F.col(W) - F.col("m")).alias("residual"))


@query(
    "win13_lag_sequence",
    f"""WITH d AS ({RESID}) SELECT ride_name, timestamp, round(sum(wait_time) OVER w, 6) AS sum_wait, round(sum(residual) OVER w, 6) AS sum_residual, round(lag(wait_time, 48) OVER (PARTITION BY ride_name ORDER BY timestamp), 8) AS oldest,
    round(lag(wait_time, 1) OVER (PARTITION BY ride_name ORDER BY timestamp), 8) AS newest FROM d WINDOW w AS (PARTITION BY ride_name ORDER BY timestamp ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) QUALIFY i >= 48""",
)
def win13(t):
    d = windows.lag_sequence(with_residual(t), K, T, [W, "residual"], 48)
    total = lambda f: F.aggregate("history", F.lit(0.0), lambda a, x: a + x[f])
    return d.select(
        K, T, R(total(W), 6).alias("sum_wait"), R(total("residual"), 6).alias("sum_residual"),
        R(F.element_at("history", 1)[W]).alias("oldest"), R(F.element_at("history", -1)[W]).alias("newest"),
    )


@query(
    "win14_same_day_mask",
    """WITH d AS (SELECT *, row_number() OVER (PARTITION BY ride_name ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY ride_name, CAST(timestamp AS DATE), hour(timestamp) >= 11 ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM v_half)
    SELECT ride_name, timestamp, CAST(c AS INT) AS n_same_day FROM d WHERE i >= 48 AND hour(timestamp) BETWEEN 11 AND 17""",
)
def win14(t):
    d = windows.valid_targets(windows.lag_sequence(t.half, K, T, [W], 48), T, 48, 11, 17)
    n = F.size(F.filter(windows.same_day_mask("history", T, 11), lambda x: x))
    return d.select(K, T, n.alias("n_same_day"))


@query("win15_rolling_6h", "SELECT ride_name, timestamp, round(avg(wait_time) OVER (PARTITION BY ride_name ORDER BY timestamp RANGE BETWEEN INTERVAL '5 hours 59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW), 9) AS mean_6h FROM v_obs")
def win15(t):
    return rounded(windows.rolling_time_mean(t.obs, K, T, W, 6, "mean_6h").select(K, T, "mean_6h"), "mean_6h", n=9)


@query("win16_latest_rows", "SELECT ride_name, timestamp, wait_time FROM v_obs QUALIFY row_number() OVER (PARTITION BY ride_name ORDER BY timestamp DESC) <= 48")
def win16(t):
    return grid.latest_rows(t.obs, K, T, 48)


@query("win17_template_row", "SELECT ride_name, CAST(timestamp AS DATE) AS date, min(timestamp) AS timestamp, arg_min(wait_time, timestamp) AS wait_time FROM v_obs GROUP BY 1, 2")
def win17(t):
    return windows.template_row(t.obs.withColumn("date", F.to_date(T)), [K, "date"], T, [W])


@query(
    "win18_argmin_per_group",
    "SELECT l_suppkey AS ride_name, CAST(l_linenumber AS INT) AS model, round(mae, 6) AS mae FROM (SELECT l_suppkey, l_linenumber, avg(l_extendedprice) AS mae, row_number() OVER (PARTITION BY l_suppkey ORDER BY avg(l_extendedprice), l_linenumber) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn = 1",
)
def win18(t):
    s = t.lineitem.groupBy(F.col("l_suppkey").alias(K), F.col("l_linenumber").alias("model")).agg(F.avg("l_extendedprice").alias("mae"))
    return rounded(evaluate.best_per_key(s, K), "mae", n=6)


# features -----------------------------------------------------------------------
@query(
    "fea1_decompose",
    """SELECT event_id, CAST(year(ts) AS INT) AS year, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts)-1 AS INT) AS weekday, CASE WHEN hour(ts) < 9 OR hour(ts) >= 21 OR value < 5 THEN 1 ELSE 0 END AS closed,
    CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(ts) BETWEEN 17 AND 19 THEN 'evening' ELSE 'night' END AS part_of_day, 'winter' AS season,
    round(sin(2*pi()*minute(ts)/60), 8) AS minute_sin, round(cos(2*pi()*(isodow(ts)-1)/7), 8) AS weekday_cos FROM events""",
)
def fea1(t):
    e = t.events.select("event_id", F.col("ts").alias(T), (F.col("value") < 5).alias("closed"))
    d = features.decompose(e, T).select("event_id", "year", "hour", "weekday", "closed", "part_of_day", "season", "minute_sin", "weekday_cos")
    return rounded(d, "minute_sin", "weekday_cos")


@query(
    "fea2_standardise",
    """WITH s AS (SELECT ride_name, avg(wait_time) m, stddev_samp(wait_time) s FROM v_hsplit WHERE split='train' GROUP BY 1)
    SELECT ride_name, timestamp, round(wait_time, 8) AS wait_time_unscaled, round((wait_time - m) / s, 6) AS wait_time FROM v_hourly JOIN s USING (ride_name)""",
)
def fea2(t):
    d = features.standardise(t.hourly, K, [W], fit_on=t.hourly_split.where("split='train'"))
    return rounded(rounded(d.select(K, T, W, "wait_time_unscaled"), "wait_time_unscaled"), W, n=6)


@query("fea3_fixed_scaler", "SELECT timestamp, round((temperature-15)/8, 9) AS temperature, round((rain-0.15)/0.36, 9) AS rain FROM v_weather")
def fea3(t):
    return rounded(features.scale_fixed(t.weather).select(T, "temperature", "rain"), "temperature", "rain", n=9)


@query(
    "fea4_recent_scaler",
    """WITH b AS (SELECT h.ride_name, w.temperature, w.rain, count(*) OVER (PARTITION BY h.ride_name) AS n FROM v_half h JOIN v_weather w USING (timestamp) WHERE h.timestamp >= '2024-01-20'),
    q1 AS (SELECT ride_name, quantile_cont(temperature, 0.25) a, quantile_cont(temperature, 0.75) b FROM b GROUP BY 1), c AS (SELECT b.* FROM b JOIN q1 USING (ride_name) WHERE temperature BETWEEN a - 1.5*(q1.b-a) AND q1.b + 1.5*(q1.b-a)),
    q2 AS (SELECT ride_name, quantile_cont(rain, 0.25) a, quantile_cont(rain, 0.75) b FROM c GROUP BY 1), d AS (SELECT c.* FROM c JOIN q2 USING (ride_name) WHERE rain BETWEEN a - 1.5*(q2.b-a) AND q2.b + 1.5*(q2.b-a)),
    n AS (SELECT ride_name, count(*) AS n_rows FROM b GROUP BY 1), x AS (SELECT ride_name, count(*) AS n_valid, avg(temperature) tm, stddev_pop(temperature) ts, avg(rain) rm, stddev_pop(rain) rs FROM d GROUP BY 1),
    j AS (SELECT n.ride_name, tm, ts, rm, rs, n_rows >= 10 AND coalesce(n_valid, 0) >= 5 AS fitted FROM n LEFT JOIN x USING (ride_name))
    SELECT ride_name, round(CASE WHEN fitted THEN tm ELSE 15.0::DOUBLE END, 6) AS temperature_mean, round(CASE WHEN fitted THEN ts ELSE 8.0::DOUBLE END, 6) AS temperature_scale,
      round(CASE WHEN fitted THEN rm ELSE 0.15::DOUBLE END, 6) AS rain_mean, round(CASE WHEN fitted THEN rs ELSE 0.36::DOUBLE END, 6) AS rain_scale, fitted FROM j""",
)
def fea4(t):
    d = t.half.where("timestamp >= '2024-01-20'").join(t.weather, T)
    s = features.recent_scaler(d, K, ["temperature", "rain"])
    return rounded(s, "temperature_mean", "temperature_scale", "rain_mean", "rain_scale", n=6)


@query(
    "fea5_one_hot",
    "SELECT event_id, " + ", ".join(f"CAST(event_type = '{k}' AS INT) AS ride_{k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events",
)
def fea5(t):
    return features.one_hot_columns(t.events.select("event_id", "event_type"), "event_type", prefix="ride_").drop("event_type")


@query(
    "fea5_one_hot_vector",
    """WITH c AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i FROM (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS k FROM lineitem WHERE l_linenumber < 7) s)
    SELECT l_orderkey, l_linenumber, CAST(coalesce(i, (SELECT count(*) FROM c)) AS INT) AS place, CAST((SELECT count(*) FROM c) + 1 AS INT) AS size FROM lineitem LEFT JOIN c ON k = CAST(l_suppkey AS VARCHAR)""",
)
def fea5_vector(t):
    """A vector place for every supplier seen in the fitted rows; the last place for the others."""
    d = features.one_hot_vector(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey", "v", fit_on=t.lineitem.where("l_linenumber < 7"))
    return d.select("l_orderkey", "l_linenumber", features.hot_place("v").alias("place"), features.vector_size("v").alias("size"))


@query(
    "fea6_polynomial",
    """WITH p AS (SELECT timestamp, temperature, rain, temperature*temperature AS tt, temperature*rain AS tr, rain*rain AS rr FROM v_weather)
    SELECT timestamp, round((tt - (SELECT avg(tt) FROM p)) / (SELECT stddev_samp(tt) FROM p), 6) AS tt, round((tr - (SELECT avg(tr) FROM p)) / (SELECT stddev_samp(tr) FROM p), 6) AS tr, round((rr - (SELECT avg(rr) FROM p)) / (SELECT stddev_samp(rr) FROM p), 6) AS rr FROM p""",
)
def fea6(t):
    d = features.polynomial(t.weather.select(T, "temperature", "rain"), ["temperature", "rain"])
    d = d.select(T, F.col("`temperature^2`").alias("tt"), F.col("`temperature rain`").alias("tr"), F.col("`rain^2`").alias("rr"))
    d = features.standardise(d, [], ["tt", "tr", "rr"])
    return rounded(d.select(T, "tt", "tr", "rr"), "tt", "tr", "rr", n=6)


@query(
    "fea7_temporal_bundle",
    f"""SELECT ride_name, timestamp, round(coalesce(lag(wait_time,1) OVER w, 0), 8) AS wait_time_lag_1h, round(coalesce(avg(wait_time) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0), 7) AS rolling_avg_3h,
    round(coalesce(max(wait_time) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0), 8) AS rolling_max_3h, round(coalesce(wait_time - lag(wait_time,1) OVER w, 0), 7) AS wait_trend_1h FROM v_hourly WINDOW w AS ({DAY} ORDER BY timestamp)""",
)
def fea7(t):
    d = day(t, leaky=True, fill=True).select(K, T, "wait_time_lag_1h", "rolling_avg_3h", "rolling_max_3h", "wait_trend_1h")
    return rounded(rounded(d, "wait_time_lag_1h", "rolling_max_3h"), "rolling_avg_3h", "wait_trend_1h", n=7)


@query(
    "fea8_seasonal_frame",
    """SELECT ride_name, timestamp AS ds, round(wait_time, 8) AS y, round(temperature, 8) AS temperature, round(rain, 8) AS rain, wk AS is_weekend, round(temperature*temperature, 6) AS temp_squared, CASE WHEN temperature > 25 THEN 1 ELSE 0 END AS high_temp,
    CASE WHEN rain > 0 THEN 1 ELSE 0 END AS any_rain, round(temperature*wk, 8) AS temp_weekend, round(rain*wk, 8) AS rain_weekend, 0 AS between_covid_lockdowns, 0 AS covid_recovery
    FROM (SELECT h.*, w.temperature, w.rain, CAST(isodow(timestamp) >= 6 AS INT) AS wk FROM v_half h JOIN v_weather w USING (timestamp))""",
)
def fea8(t):
    d = features.seasonal_frame(t.half.join(t.weather.drop("wind"), T), T, W)
    return rounded(rounded(d, "y", "temperature", "rain", "temp_weekend", "rain_weekend"), "temp_squared", n=6)


@query(
    "fea9_boosted_frame",
    """SELECT ride_name, timestamp, CAST(hour(timestamp) AS INT) AS hour, CASE WHEN hour(timestamp) BETWEEN 9 AND 11 THEN 1 ELSE 0 END AS morning_rush, CASE WHEN hour(timestamp) >= 18 THEN 1 ELSE 0 END AS evening,
    CASE WHEN temperature < 15 THEN 1 ELSE 0 END AS low_temp, 0 AS is_spring, round(temperature * CAST(isodow(timestamp) >= 6 AS INT), 8) AS temp_weekend, round(lag(wait_time, 48) OVER w, 8) AS wait_time_lag_48, round(lag(wait_time, 336) OVER w, 8) AS wait_time_lag_336
    FROM v_half h JOIN v_weather USING (timestamp) WINDOW w AS (PARTITION BY ride_name ORDER BY timestamp)""",
)
def fea9(t):
    d = features.boosted_frame(t.half.join(t.weather.drop("wind"), T), K, T, W, "temperature", "rain", [W])
    d = d.select(K, T, "hour", "morning_rush", "evening", "low_temp", "is_spring", "temp_weekend", "wait_time_lag_48", "wait_time_lag_336")
    return rounded(d, "temp_weekend", "wait_time_lag_48", "wait_time_lag_336")


# splits --------------------------------------------------------------------------
@query("spl1_boundaries", "SELECT ride_name, timestamp, split FROM v_dsplit")
def spl1(t):
    return t.daily_split.select(K, T, "split")


@query("spl2_sizes", "SELECT split, count(*) AS n_rows, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM v_dsplit GROUP BY 1")
def spl2(t):
    return rounded(split.split_sizes(t.daily_split), "pct", n=6)


@query(
    "spl3_chronological",
    "SELECT ride_name, timestamp, CASE WHEN row_number() OVER (PARTITION BY ride_name ORDER BY timestamp) <= floor(count(*) OVER (PARTITION BY ride_name) * 0.8) THEN 'train' ELSE 'test' END AS split FROM v_daily",
)
def spl3(t):
    return split.chronological(t.daily, K, T, 0.8).select(K, T, "split")


@query(
    "spl4_expanding_folds",
    """SELECT ride_name, timestamp, CAST(f AS INT) AS fold, CASE WHEN tile = f + 1 THEN 'test' ELSE 'train' END AS role FROM (SELECT ride_name, timestamp, ntile(6) OVER (PARTITION BY ride_name ORDER BY timestamp) AS tile FROM v_daily), unnest(generate_series(1, 5)) AS u(f)
    WHERE f >= greatest(tile - 1, 1)""",
)
def spl4(t):
    return split.expanding_folds(t.daily, K, T, 5).select(K, T, "fold", "role")


@query(
    "spl5_size_gate",
    """WITH s AS (SELECT *, CASE WHEN timestamp < '2000-01-01' THEN 'train' WHEN timestamp < '2001-01-01' THEN 'val' ELSE 'test' END AS split FROM v_wide),
    ok AS (SELECT ride_name FROM s GROUP BY 1 HAVING count(*) FILTER (split='train') >= 380 AND count(*) FILTER (split='val') >= 60 AND count(*) FILTER (split='test') >= 30) SELECT ride_name, timestamp, split FROM s WHERE ride_name IN (SELECT ride_name FROM ok)""",
)
def spl5(t):
    s = split.by_boundaries(t.wide, T, "2000-01-01", "2001-01-01")
    return split.size_gate(s, K, {"train": 380, "val": 60, "test": 30}).select(K, T, "split")
