"""Exploration aggregates and run tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.functions.stats import safe_corr
from slotwise.operators import evaluate, explore, sets
from slotwise.operators.filters import meaningful
from slotwise.plans.q_forecast import pred, rounded, scores
from slotwise.plans.registry import query
from slotwise.session import cut_lineage

R = lambda c, n=6: F.round(c, n)
K, T, W = "ride_name", "timestamp", "wait_time"
KEYS = ["click", "error", "purchase", "signup", "view"]
PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def sql_pivot(agg: str, src: str, row: str, name: str, values=KEYS, col=K, digits=6) -> str:
    cols = ", ".join(f"round({agg.format(k=k)}, {digits}) AS \"{k}\"" for k in values)
    return f"SELECT CAST({row} AS INT) AS {name}, {cols} FROM {src} GROUP BY 1"


@query("agg1_by_hour", "SELECT CAST(hour(timestamp) AS INT) AS hour, max(wait_time) AS max_wait, min(wait_time) AS min_wait, round(avg(wait_time), 6) AS mean_wait FROM v_obs GROUP BY 1")
def agg1(t):
    return t.obs.groupBy(F.hour(T).alias("hour")).agg(F.max(W).alias("max_wait"), F.min(W).alias("min_wait"), R(F.avg(W)).alias("mean_wait"))


@query("agg2_hour_by_ride", sql_pivot("avg(CASE WHEN ride_name='{k}' THEN wait_time END)", "v_obs", "hour(timestamp)", "hour"))
def agg2(t):
    return rounded(explore.pivot(t.obs, {"hour": F.hour(T)}, K, KEYS, F.avg(W)), *KEYS)


@query("agg2_mean_per_ride", "SELECT ride_name, round(avg(wait_time), 6) AS mean_wait FROM v_wide GROUP BY 1")
def agg2_mean(t):
    return t.wide.groupBy(K).agg(R(F.avg(W)).alias("mean_wait"))


@query("agg3_day_of_year_by_ride", sql_pivot("avg(CASE WHEN ride_name='{k}' THEN wait_time END)", "v_daily", "dayofyear(timestamp)", "day_of_year", PRIOS, digits=9))
def agg3(t):
    return rounded(explore.pivot(t.daily, {"day_of_year": F.dayofyear(T)}, K, PRIOS, F.avg(W)), *PRIOS, n=9)


@query("agg4_closure_rate", sql_pivot("avg(CASE WHEN ride_name='{k}' THEN CAST(closed AS INT) END)", "v_grid5", "month(timestamp)", "month"))
def agg4(t):
    return rounded(explore.pivot(t.grid5, {"month": F.month(T)}, K, KEYS, F.avg(F.col("closed").cast("int"))), *KEYS)


@query("agg5_zero_waits", "SELECT CAST(dayofyear(l_shipdate) AS INT) AS day_of_year, count(*) AS n_zero FROM lineitem WHERE l_discount = 0 GROUP BY 1")
def agg5(t):
    return t.lineitem.where("l_discount = 0").groupBy(F.dayofyear("l_shipdate").alias("day_of_year")).agg(F.count(F.lit(1)).alias("n_zero"))


@query(
    "agg6_distinct_open",
    "SELECT CAST(year(l_shipdate) AS INT) AS year, " + ", ".join(f'count(DISTINCT CASE WHEN month(l_shipdate)={m} THEN l_suppkey END) AS "{m}"' for m in range(1, 13)) + " FROM lineitem WHERE l_quantity > 25 GROUP BY 1",
)
def agg6(t):
    d = t.lineitem.where("l_quantity > 25").withColumn("month", F.month("l_shipdate"))
    months = list(range(1, 13))
    n = d.select(F.year("l_shipdate").alias("year"), "month", "l_suppkey").distinct()
    return explore.pivot(n, {"year": F.col("year")}, "month", months, F.count("l_suppkey"), fill=0)


@query(
    "agg7_hour_histogram",
    "SELECT CAST(h AS INT) AS hour, count(o.ride_name) AS n FROM unnest(generate_series(0, 23)) AS u(h) LEFT JOIN (SELECT * FROM v_obs WHERE wait_time > 200) o ON hour(o.timestamp) = h GROUP BY 1",
)
def agg7(t):
    return explore.count_by_spine(t.obs.where(F.col(W) > 200), F.hour(T), 0, 23, "hour")


DESC = "count(wait_time) AS count, round(avg(wait_time), {d}) AS mean, round(stddev_samp(wait_time), {d}) AS std, min(wait_time) AS min, max(wait_time) AS max, round(quantile_cont(wait_time, 0.25), {d}) AS p25, round(median(wait_time), {d}) AS p50, round(quantile_cont(wait_time, 0.75), {d}) AS p75"


@query("agg8_describe", f"SELECT ride_name, {DESC.format(d=6)} FROM v_obs GROUP BY 1")
def agg8(t):
    return rounded(explore.describe(t.obs, K, W), "mean", "std", "p25", "p50", "p75")


@query(
    "agg8_describe_era",
    f"SELECT era, {DESC.format(d=3)} FROM (SELECT o_totalprice AS wait_time, CASE WHEN o_orderdate BETWEEN '1998-12-01' AND '1999-05-01' THEN 'era' ELSE 'normal' END AS era FROM orders) GROUP BY 1",
)
def agg8_era(t):
    era = F.when(F.col("o_orderdate").between(F.lit("1998-12-01").cast("timestamp_ntz"), F.lit("1999-05-01").cast("timestamp_ntz")), "era").otherwise("normal")
    d = t.orders.select(era.alias("era"), F.col("o_totalprice").alias(W))
    return rounded(explore.describe(d, "era", W), "mean", "std", "p25", "p50", "p75", n=3)


@query(
    "agg9_era_patterns",
    """WITH f AS (SELECT *, CASE WHEN day(timestamp) BETWEEN 10 AND 15 THEN 'era' ELSE 'normal' END AS era FROM v_sparse WHERE wait_time > 1 OR (wait_time = 0 AND NOT closed))
    SELECT era, 'weekday' AS unit, CAST(isodow(timestamp)-1 AS INT) AS v, round(avg(wait_time), 6) AS mean_wait FROM f GROUP BY ALL UNION ALL SELECT era, 'hour', CAST(hour(timestamp) AS INT), round(avg(wait_time), 6) FROM f GROUP BY ALL""",
)
def agg9(t):
    d = t.sparse_grid.where(meaningful(W, "closed")).withColumn("era", F.when(F.dayofmonth(T).between(10, 15), "era").otherwise("normal"))
    units = F.explode(F.array(F.struct(F.lit("weekday").alias("unit"), F.weekday(T).alias("v")), F.struct(F.lit("hour").alias("unit"), F.hour(T).alias("v"))))
    u = d.select("era", W, units.alias("u"))
    return u.groupBy("era", F.col("u.unit").alias("unit"), F.col("u.v").alias("v")).agg(R(F.avg(W)).alias("mean_wait"))


@query("agg10_daily_rain", "SELECT date, round(sum(m), 6) AS rain_daily FROM (SELECT CAST(timestamp AS DATE) AS date, hour(timestamp) AS h, avg(rain) AS m FROM v_weather GROUP BY 1, 2) GROUP BY 1")
def agg10(t):
    return rounded(explore.nested_sum(t.weather, T, "rain"), "rain_daily")


@query(
    "agg11_wait_by_weather_bin",
    """WITH j AS (SELECT h.wait_time, w.temperature AS x FROM v_half h JOIN v_weather w USING (timestamp)), e AS (SELECT min(x) lo, max(x) hi FROM j)
    SELECT b AS temp_bin, round(avg(wait_time), 6) AS mean_wait, count(*) AS n FROM (SELECT wait_time, CASE WHEN b BETWEEN 0 AND m THEN CAST(b AS INT) END AS b FROM (SELECT wait_time, ceil((x-lo)/5)-1 AS b, ceil((hi-lo)/5)-2 AS m FROM j, e)) GROUP BY 1""",
)
def agg11(t):
    d = explore.fixed_width_bin(t.half.join(t.weather.select(T, "temperature"), T), "temperature", 5, "temp_bin")
    return d.groupBy("temp_bin").agg(R(F.avg(W)).alias("mean_wait"), F.count(F.lit(1)).alias("n"))


@query(
    "agg12_iqr_outliers",
    "SELECT o.ride_name, timestamp, wait_time FROM v_obs o JOIN (SELECT ride_name, quantile_cont(wait_time, 0.25) a, quantile_cont(wait_time, 0.75) b FROM v_obs GROUP BY 1) q USING (ride_name) WHERE wait_time < a - 1.5*(b-a) OR wait_time > b + 1.5*(b-a)",
)
def agg12(t):
    return explore.iqr_outliers(t.obs, K, W)


@query(
    "agg13_quantile_bins",
    """WITH m AS (SELECT ride_name, avg(wait_time) AS mean_wait FROM v_wide GROUP BY 1), e AS (SELECT quantile_cont(mean_wait, [0.2, 0.4, 0.6, 0.8, 1.0]) q FROM m)
    SELECT ride_name, concat('Bin ', CASE WHEN mean_wait <= q[1] THEN 1 WHEN mean_wait <= q[2] THEN 2 WHEN mean_wait <= q[3] THEN 3 WHEN mean_wait <= q[4] THEN 4 ELSE 5 END) AS bin FROM m, e""",
)
def agg13(t):
    m = t.wide.groupBy(K).agg(F.avg(W).alias("mean_wait"))
    return explore.quantile_bins(m, "mean_wait", 5, "bin").select(K, "bin")


@query("agg14_high_wait_days", "SELECT CAST(timestamp AS DATE) AS date, ride_name, count(*) AS n_high FROM v_obs WHERE wait_time > 150 GROUP BY 1, 2 ORDER BY 3 DESC")
def agg14(t):
    d = t.obs.where(F.col(W) > 150).groupBy(F.to_date(T).alias("date"), K).agg(F.count(F.lit(1)).alias("n_high"))
    return d.orderBy(F.col("n_high").desc(), "date", K)


ATT = """WITH top AS (SELECT ride_name FROM v_obs GROUP BY 1 ORDER BY avg(wait_time) DESC, 1 LIMIT 3),
    d AS (SELECT *, CAST(timestamp AS DATE) AS date, CASE WHEN hour(timestamp) BETWEEN 11 AND 15 THEN wait_time END AS pk, CASE WHEN ride_name IN (SELECT ride_name FROM top) THEN wait_time END AS tp FROM v_obs),
    a AS (SELECT date, avg(wait_time) AS daily_avg_wait, sum(wait_time) AS daily_total_wait, max(wait_time) AS daily_max_wait, count(*) AS daily_data_points, count(DISTINCT ride_name) AS daily_active_rides, avg(pk) AS peak_avg_wait, max(pk) AS peak_max_wait,
      avg(tp) AS top_rides_avg_wait, max(tp) AS top_rides_max_wait, median(wait_time) AS daily_median_wait, median(pk) AS peak_median_wait, median(tp) AS top_rides_median_wait FROM d GROUP BY 1)"""
ATT_AVG = ["daily_avg_wait", "daily_total_wait", "peak_avg_wait", "top_rides_avg_wait", "daily_median_wait", "peak_median_wait", "top_rides_median_wait"]


@query("agg15_attendance_metrics", ATT + " SELECT date, daily_max_wait, daily_data_points, daily_active_rides, peak_max_wait, top_rides_max_wait, " + ", ".join(f"round({c}, 6) AS {c}" for c in ATT_AVG) + " FROM a")
def agg15(t):
    return rounded(explore.attendance_metrics(t.obs, K, T, W, top=3), *ATT_AVG)


IDX = " SELECT date, round((least(daily_total_wait/x*100,100) + least(daily_avg_wait/y*100,100) + least(daily_median_wait/z*100,100))/3, 6) AS attendance_index FROM a, l"


@query("agg16_attendance_index", ATT + ", l AS (SELECT quantile_cont(daily_total_wait, 0.95) x, quantile_cont(daily_avg_wait, 0.95) y, quantile_cont(daily_median_wait, 0.95) z FROM a)" + IDX)
def agg16(t):
    m = cut_lineage(explore.attendance_metrics(t.obs, K, T, W, top=3).select("date", "daily_total_wait", "daily_avg_wait", "daily_median_wait"))
    return rounded(explore.attendance_index(m).select("date", "attendance_index"), "attendance_index")


@query("agg16_attendance_index_listed", ATT + ", l AS (SELECT median(daily_total_wait) x, median(daily_avg_wait) y, median(daily_median_wait) z FROM a WHERE date IN ('2024-01-06', '2024-01-13', '2024-01-20', '2031-01-01'))" + IDX)
def agg16_listed(t):
    m = cut_lineage(explore.attendance_metrics(t.obs, K, T, W, top=3).select("date", "daily_total_wait", "daily_avg_wait", "daily_median_wait"))
    d = explore.attendance_index(m, ["2024-01-06", "2024-01-13", "2024-01-20", "2031-01-01"])
    return rounded(d.select("date", "attendance_index"), "attendance_index")


@query("agg17_loss_accounting", "SELECT count(*) AS rows_before, count(*) FILTER (wait_time <= 100) AS rows_after, count(*) FILTER (wait_time > 100) AS rows_lost, round(count(*) FILTER (wait_time > 100)*100.0/count(*), 6) AS pct_lost FROM v_obs")
def agg17(t):
    return rounded(explore.loss_accounting(t.obs, t.obs.where(F.col(W) <= 100)), "pct_lost")


@query(
    "agg18_rows_by_month_split",
    "SELECT strftime(timestamp, '%Y-%m') AS month, count(*) FILTER (split='train') AS train, count(*) FILTER (split='val') AS val, count(*) FILTER (split='test') AS test, count(*) AS total FROM v_dsplit GROUP BY 1",
)
def agg18(t):
    p = explore.pivot(t.daily_split, {"month": F.date_format(T, "yyyy-MM")}, "split", ["train", "val", "test"], F.count(F.lit(1)), fill=0)
    return p.withColumn("total", F.col("train") + F.col("val") + F.col("test"))


@query("agg18_top_months", "SELECT strftime(timestamp, '%Y-%m') AS month, count(*) AS n FROM v_dsplit GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def agg18_top(t):
    n = t.daily_split.groupBy(F.date_format(T, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return sets.top_n(n, "n", 5, ["month"])


@query("agg19_metric_summary", "SELECT model, round(avg(mae),2) AS mae_mean, round(stddev_samp(mae),2) AS mae_std, round(median(mae),2) AS mae_median FROM v_scores GROUP BY 1")
def agg19(t):
    return evaluate.summarise(cut_lineage(scores(t)), "model", ["mae"])


@query("agg20_correlation", "SELECT ride_name, round(corr(hour(timestamp), wait_time), 6) AS c FROM v_obs GROUP BY 1")
def agg20(t):
    return t.obs.groupBy(K).agg(R(safe_corr(F.hour(T), W)).alias("c"))


@query("agg20_val_test_correlation", "SELECT model, round(corr(v, x), 6) AS c FROM (SELECT model, ride_name, max(CASE WHEN split='val' THEN mae END) v, max(CASE WHEN split='test' THEN mae END) x FROM v_scores GROUP BY 1, 2) WHERE model <> 'none' GROUP BY 1")
def agg20_scores(t):
    return evaluate.drift(scores(t), [K, "model"], "mae").groupBy("model").agg(R(safe_corr("val", "test")).alias("c"))


@query("agg21_run_summary", "SELECT l_suppkey, count(*) AS n, min(l_extendedprice) AS min_metric, round(avg(l_extendedprice), 4) AS mean_metric, round(stddev_samp(l_extendedprice), 4) AS std_metric FROM lineitem GROUP BY 1")
def agg21(t):
    m = "l_extendedprice"
    return t.lineitem.groupBy("l_suppkey").agg(F.count(m).alias("n"), F.min(m).alias("min_metric"), R(F.avg(m), 4).alias("mean_metric"), R(F.stddev_samp(m), 4).alias("std_metric"))


@query("agg22_frequent_names", "SELECT name, n_occurrences FROM (SELECT o_orderpriority AS name, count(DISTINCT (o_custkey, year(o_orderdate))) AS n_occurrences FROM orders GROUP BY 1) WHERE n_occurrences >= 70")
def agg22(t):
    d = t.orders.select(F.col("o_orderpriority").alias("name"), "o_custkey", F.year("o_orderdate").alias("year"))
    return explore.frequent_names(d, "name", ["o_custkey", "year"], 70)


@query(
    "agg23_representative_dates",
    "SELECT DISTINCT coalesce(p, f) AS date FROM (SELECT o_custkey, year(o_orderdate) y, min(CASE WHEN o_orderstatus='F' THEN CAST(o_orderdate AS DATE) END) p, min(CASE WHEN o_orderstatus='O' THEN CAST(o_orderdate AS DATE) END) f FROM orders GROUP BY 1, 2) WHERE coalesce(p, f) IS NOT NULL",
)
def agg23(t):
    d = t.orders.select("o_custkey", F.year("o_orderdate").alias("y"), "o_orderstatus", F.to_date("o_orderdate").alias("date"))
    return explore.representative_dates(d, "o_custkey", "y", "o_orderstatus", "date", "F", "O")


@query(
    "agg24_forecast_summary",
    """WITH p AS (SELECT ride_name, timestamp, wait_time AS f, yhat AS b, wait_time - yhat AS r FROM v_pred WHERE split='test')
    SELECT ride_name, round(avg(f),6) AS mean, round(stddev_pop(f),6) AS std, round(min(f),6) AS min, round(max(f),6) AS max, CAST(hour(arg_max(timestamp, (f, -epoch_us(timestamp)))) AS INT) AS peak_hour, CAST(hour(arg_min(timestamp, (f, epoch_us(timestamp)))) AS INT) AS lowest_hour,
    CASE WHEN arg_max(f, timestamp) > arg_min(f, timestamp) THEN 'increasing' ELSE 'decreasing' END AS trend, round(corr(b, r),6) AS component_corr, round(quantile_cont(f,0.25),6) AS q25, round(median(f),6) AS median, round(quantile_cont(f,0.75),6) AS q75 FROM p GROUP BY 1""",
)
def agg24(t):
    p = cut_lineage(pred(t).where("split='test'").withColumn("resid", F.col(W) - F.col("yhat")))
    d = evaluate.forecast_summary(p, K, T, W, "yhat", "resid")
    return rounded(d, "mean", "std", "min", "max", "component_corr", "q25", "median", "q75")


@query("agg25_batch_accounting", "SELECT CAST(ts AS DATE) AS date, count(*) FILTER (event_type <> 'error') AS n_success, count(*) FILTER (event_type = 'error') AS n_failed, count(*) AS n_total, round(count(*) FILTER (event_type <> 'error')*100.0/count(*), 2) AS pct_success FROM events GROUP BY 1")
def agg25(t):
    return explore.batch_accounting(t.events, F.to_date("ts"), F.col("event_type") != "error")


# run leaderboard --------------------------------------------------------------------
RUNS = "(SELECT l_orderkey * 8 + l_linenumber AS run, l_suppkey AS ride, l_linestatus AS state, l_extendedprice AS metric, l_discount AS lr, l_tax AS dropout, l_quantity AS layers FROM lineitem)"


def runs(t):
    return t.lineitem.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("run"), F.col("l_suppkey").alias("ride"), F.col("l_linestatus").alias("state"),
        F.col("l_extendedprice").alias("metric"), F.col("l_discount").alias("lr"), F.col("l_tax").alias("dropout"), F.col("l_quantity").alias("layers"),
    )


@query("tun2_leaderboard", f"SELECT run, ride, metric, lr, dropout FROM {RUNS} WHERE state='F' ORDER BY metric, run LIMIT 20")
def tun2(t):
    return explore.leaderboard(runs(t), "state", "F", "metric", 20, "run").select("run", "ride", "metric", "lr", "dropout")


@query("tun2_parameter_correlation", " UNION ALL ".join(f"SELECT '{p}' AS parameter, round(corr({p}, metric), 6) AS correlation FROM {RUNS} WHERE state='F'" for p in ("lr", "dropout", "layers")))
def tun2_corr(t):
    return rounded(explore.metric_correlations(runs(t).where("state='F'"), ["lr", "dropout", "layers"], "metric"), "correlation")


@query("tun2_best_config", f"SELECT ride, min(metric) AS metric, arg_min(run, (metric, run)) AS run, arg_min(lr, (metric, run)) AS lr, arg_min(dropout, (metric, run)) AS dropout FROM {RUNS} WHERE state='F' GROUP BY 1")
def tun2_best(t):
    g = runs(t).where("state='F'").groupBy("ride").agg(F.min(F.struct("metric", "run", "lr", "dropout")).alias("b"))
    return g.select("ride", "b.*")
