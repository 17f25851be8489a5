"""Baseline forecasts and their evaluation."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions.calendar import flag
from slotwise.operators import evaluate, models
from slotwise.operators.baselines import MODELS, Baselines, post_process
from slotwise.plans.registry import define_view, query
from slotwise.session import cut_lineage

R = lambda c, n=6: F.round(c, n)
K, T, W = "ride_name", "timestamp", "wait_time"


def rounded(df, *cols, n=6):
    return df.withColumns({c: R(c, n) for c in cols})


DTK = "(isodow({a}timestamp)-1)*1440+hour({a}timestamp)*60+minute({a}timestamp)"
TK = "hour({a}timestamp)*60+minute({a}timestamp)"


def base_sql(model: str, src: str) -> str:
    """(ride_name, timestamp, split, wait_time, yhat) of a model for the rows after training."""
    tr, fu = f"(SELECT * FROM {src} WHERE split = 'train')", f"(SELECT * FROM {src} WHERE split <> 'train')"
    g = f"(SELECT ride_name, avg(wait_time) AS m FROM {tr} GROUP BY 1)"
    head = "SELECT f.ride_name, f.timestamp, f.split, f.wait_time, "
    by = lambda k, extra="": f"(SELECT ride_name, {k.format(a='')} AS k{', hol' if extra else ''}, avg(wait_time) AS m FROM {extra or tr} GROUP BY ALL)"
    if model == "mean":
        return f"{head} g.m AS yhat FROM {fu} f LEFT JOIN {g} g USING (ride_name)"
    if model == "time_of_day":
        return f"{head} coalesce(t.m, g.m) AS yhat FROM {fu} f LEFT JOIN {by(TK)} t ON t.ride_name=f.ride_name AND t.k={TK.format(a='f.')} LEFT JOIN {g} g ON g.ride_name=f.ride_name"
    if model == "day_time":
        return f"{head} coalesce(d.m, t.m, g.m) AS yhat FROM {fu} f LEFT JOIN {by(DTK)} d ON d.ride_name=f.ride_name AND d.k={DTK.format(a='f.')} LEFT JOIN {by(TK)} t ON t.ride_name=f.ride_name AND t.k={TK.format(a='f.')} LEFT JOIN {g} g ON g.ride_name=f.ride_name"
    if model == "moving_average":
        ma = f"(SELECT ride_name, timestamp, avg(wait_time) OVER (PARTITION BY ride_name ORDER BY timestamp ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS ma FROM {tr})"
        return f"{head} coalesce(x.ma, g.m) AS yhat FROM {fu} f ASOF LEFT JOIN {ma} x ON x.ride_name=f.ride_name AND f.timestamp > x.timestamp LEFT JOIN {g} g ON g.ride_name=f.ride_name"
    if model == "seasonal_weekly":
        r = f"(SELECT ride_name, k, avg(wait_time) AS m FROM (SELECT *, {DTK.format(a='')} AS k, row_number() OVER (PARTITION BY ride_name, {DTK.format(a='')} ORDER BY timestamp DESC) AS rn FROM {tr}) WHERE rn <= 4 GROUP BY 1, 2)"
        return f"{head} coalesce(d.m, g.m) AS yhat FROM {fu} f LEFT JOIN {r} d ON d.ride_name=f.ride_name AND d.k={DTK.format(a='f.')} LEFT JOIN {g} g ON g.ride_name=f.ride_name"
    if model == "holiday_aware":
        h = "CAST(timestamp AS DATE) IN (SELECT date FROM v_holidays)"
        trh, fuh = f"(SELECT *, {h} AS hol FROM {src} WHERE split = 'train')", f"(SELECT *, {h} AS hol FROM {src} WHERE split <> 'train')"
        hg = f"(SELECT ride_name, hol, avg(wait_time) AS m FROM {trh} GROUP BY 1, 2)"
        return (
            f"{head} coalesce(d.m, t.m, h.m, g.m) AS yhat FROM {fuh} f LEFT JOIN {by(DTK, trh)} d ON d.ride_name=f.ride_name AND d.hol=f.hol AND d.k={DTK.format(a='f.')} "
            f"LEFT JOIN {by(TK, trh)} t ON t.ride_name=f.ride_name AND t.hol=f.hol AND t.k={TK.format(a='f.')} LEFT JOIN {hg} h ON h.ride_name=f.ride_name AND h.hol=f.hol LEFT JOIN {g} g ON g.ride_name=f.ride_name"
        )
    if model == "last_week":
        return f"{head} coalesce(p.wait_time, g.m) AS yhat FROM {fu} f LEFT JOIN {tr} p ON p.ride_name=f.ride_name AND p.timestamp=f.timestamp - INTERVAL 7 DAY LEFT JOIN {g} g ON g.ride_name=f.ride_name"
    if model == "last_year":
        tgt = f"(SELECT *, b + to_days(CAST(isodow(timestamp) - isodow(b) AS INT)) AS target FROM (SELECT *, timestamp - INTERVAL 1 YEAR AS b FROM {fu}))"
        cost = "abs(epoch_us(h.timestamp) - epoch_us(q.target)) - CASE WHEN isodow(h.timestamp) = isodow(q.target) THEN 3600000000 ELSE 0 END"
        c = f"(SELECT q.ride_name, q.timestamp, arg_min(h.wait_time, (CASE WHEN h.timestamp = q.target THEN 0 ELSE 1 END, {cost}, h.timestamp)) AS v FROM {tgt} q JOIN {tr} h ON h.ride_name=q.ride_name AND {cost} < 7*86400000000 GROUP BY 1, 2)"
        return f"{head} coalesce(c.v, g.m) AS yhat FROM {fu} f LEFT JOIN {c} c ON c.ride_name=f.ride_name AND c.timestamp=f.timestamp LEFT JOIN {g} g ON g.ride_name=f.ride_name"
    raise ValueError(model)


def forecast(t, model: str, src: DataFrame) -> DataFrame:
    train, future = src.where("split = 'train'"), src.where("split <> 'train'")
    b = Baselines()
    if model == "holiday_aware":
        return b.holiday_aware(train, future, t.holidays)
    return getattr(b, model)(train, future)


def _register_baseline(i: int, model: str) -> None:
    src_sql, src = ("v_dsplit", "daily_split") if model == "last_year" else ("v_hsplit", "hourly_split")
    digits = 9 if model == "last_year" else 8

    @query(f"bas{i}_{model}", f"SELECT ride_name, timestamp, split, round(yhat, {digits}) AS yhat FROM ({base_sql(model, src_sql)})")
    def _run(t):
        return rounded(forecast(t, model, getattr(t, src)).select(K, T, "split", "yhat"), "yhat", n=digits)


for _i, _m in enumerate(MODELS, 1):
    _register_baseline(_i, _m)


@query(
    "bas7_last_week_later_sources",
    """SELECT f.ride_name, f.timestamp, f.split, round(coalesce(p.wait_time, g.m), 8) AS yhat FROM (SELECT * FROM v_hsplit WHERE split='test') f LEFT JOIN v_hourly p ON p.ride_name=f.ride_name AND p.timestamp=f.timestamp - INTERVAL 7 DAY
    LEFT JOIN (SELECT ride_name, avg(wait_time) AS m FROM v_hsplit WHERE split='train' GROUP BY 1) g ON g.ride_name=f.ride_name""",
)
def bas7_later(t):
    s = t.hourly_split
    part = lambda x: s.where(F.col("split") == x)
    d = Baselines().last_week(part("train"), part("test"), later=[part("val"), part("test")])
    return rounded(d.select(K, T, "split", "yhat"), "yhat", n=8)


@query("bas9_post_process", f"SELECT ride_name, timestamp, round(CASE WHEN hour(timestamp) < 9 THEN 0 ELSE greatest(yhat - 40, 0) END, 8) AS yhat FROM ({base_sql('time_of_day', 'v_hsplit')})")
def bas9(t):
    d = forecast(t, "time_of_day", t.hourly_split).withColumn("yhat", F.col("yhat") - 40).withColumn("closed", F.hour(T) < 9)
    return rounded(post_process(d, "yhat", "closed").select(K, T, "yhat"), "yhat", n=8)


@query(
    "bas10_all_baselines",
    " UNION ALL ".join(f"SELECT ride_name, timestamp, split, round(yhat, 9) AS yhat, '{m}' AS model FROM ({base_sql(m, 'v_dsplit')})" for m in MODELS),
)
def bas10(t):
    s = cut_lineage(t.daily_split)
    d = Baselines().all(s.where("split='train'"), s.where("split<>'train'"), t.holidays)
    return rounded(d.select(K, T, "split", "yhat", "model"), "yhat", n=9)


@query(
    "bas10_resume",
    " UNION ALL ".join(
        f"SELECT '{m}' AS model, ride_name, count(*) AS n FROM v_dsplit WHERE split<>'train'" + (" AND ride_name NOT IN ('1-URGENT', '5-LOW')" if m in ("mean", "last_year") else "") + " GROUP BY 2"
        for m in MODELS
    ),
)
def bas10_resume(t):
    s = cut_lineage(t.daily_split)
    done = s.select(K).distinct().where(F.col(K).isin("1-URGENT", "5-LOW")).select(K, F.explode(F.array(F.lit("mean"), F.lit("last_year"))).alias("model"))
    d = Baselines().all(s.where("split='train'"), s.where("split<>'train'"), t.holidays, done=done)
    return d.groupBy("model", K).agg(F.count(F.lit(1)).alias("n"))


# shared long tables ----------------------------------------------------------------
LONG = ("mean", "time_of_day", "day_time")
define_view("v_pred", base_sql("time_of_day", "v_hsplit"))
define_view("v_long", " UNION ALL ".join(f"SELECT *, '{m}' AS model FROM ({base_sql(m, 'v_hsplit')})" for m in LONG))
define_view(
    "v_scores",
    "SELECT ride_name, model, split, avg(abs(wait_time-yhat)) AS mae, sqrt(avg((wait_time-yhat)*(wait_time-yhat))) AS rmse, 1-avg((wait_time-yhat)*(wait_time-yhat))/var_pop(wait_time) AS r2 FROM v_long GROUP BY 1, 2, 3",
)


def pred(t):
    return forecast(t, "time_of_day", t.hourly_split)


def long(t):
    s = cut_lineage(t.hourly_split)  # slots, read by every model
    return reduce(DataFrame.unionByName, [forecast(t, m, s).withColumn("model", F.lit(m)) for m in LONG])


def scores(t):
    return evaluate.score(long(t), [K, "model", "split"], W, "yhat", ["mae", "rmse", "r2"])


@query(
    "eva1_metrics",
    """SELECT ride_name, split, round(avg(abs(e)),6) AS mae, round(sqrt(avg(e*e)),6) AS rmse, round(1-avg(e*e)/var_pop(wait_time),6) AS r2, round(avg(CASE WHEN wait_time>0.1 THEN abs(e)/(abs(wait_time)+abs(yhat)) END)*100,6) AS smape_pos, count(*) AS n_samples
    FROM (SELECT *, wait_time-yhat AS e FROM v_pred) GROUP BY 1,2""",
)
def eva1(t):
    d = evaluate.score(pred(t), [K, "split"], W, "yhat", ["mae", "rmse", "r2", "smape_pos", "n_samples"])
    return rounded(d, "mae", "rmse", "r2", "smape_pos")


@query("eva2_smape_both", "SELECT ride_name, split, round(avg(CASE WHEN wait_time>0 AND yhat>0 THEN abs(wait_time-yhat)/(abs(wait_time)+abs(yhat)+1e-8) END)*100,6) AS smape_both FROM v_pred GROUP BY 1,2")
def eva2(t):
    return rounded(evaluate.score(pred(t), [K, "split"], W, "yhat", ["smape_both"]), "smape_both")


@query("eva3_mape", "SELECT ride_name, split, round(avg(CASE WHEN wait_time>0 THEN abs(wait_time-yhat)/wait_time END)*100,6) AS mape, round(avg(wait_time-yhat),6) AS bias FROM v_pred GROUP BY 1,2")
def eva3(t):
    return rounded(evaluate.score(pred(t), [K, "split"], W, "yhat", ["mape", "bias"]), "mape", "bias")


@query(
    "eva4_exclude_closed",
    """SELECT ride_name, d AS date, count(*) FILTER (NOT c) AS n_samples, CASE WHEN count(*) FILTER (NOT c) = 0 THEN 'Infinity'::DOUBLE ELSE round(avg(CASE WHEN NOT c THEN abs(wait_time-yhat) END),6) END AS mae,
    CASE WHEN count(*) FILTER (NOT c) = 0 THEN '-Infinity'::DOUBLE ELSE round(1 - avg(CASE WHEN NOT c THEN (wait_time-yhat)*(wait_time-yhat) END) / nullif(var_pop(CASE WHEN NOT c THEN wait_time END), 0), 6) END AS r2
    FROM (SELECT *, CAST(timestamp AS DATE) AS d, hour(timestamp) < 9 OR day(timestamp) = 27 AS c FROM v_pred) GROUP BY 1, 2""",
)
def eva4(t):
    d = pred(t).withColumn("date", F.to_date(T)).withColumn("closed", (F.hour(T) < 9) | (F.dayofmonth(T) == 27))
    d = evaluate.score(d, [K, "date"], W, "yhat", ["n_samples", "mae", "r2"], closed="closed")
    inf = F.lit(float("inf"))
    return d.withColumn("mae", F.when(F.col("mae") < inf, R("mae")).otherwise(F.col("mae"))).withColumn("r2", F.when(F.col("r2") > -inf, R("r2")).otherwise(F.col("r2")))


@query(
    "eva5_error_table",
    """SELECT ride_name, timestamp, round(wait_time-yhat,7) AS error, round(abs(wait_time-yhat),7) AS abs_error, round(abs(wait_time-yhat)*100/wait_time,6) AS pct_error, CAST(hour(timestamp) AS INT) AS hour, CAST(isodow(timestamp)-1 AS INT) AS weekday, CAST(month(timestamp) AS INT) AS month FROM v_pred""",
)
def eva5(t):
    d = evaluate.error_table(pred(t), T, W, "yhat").select(K, T, "error", "abs_error", "pct_error", "hour", "weekday", "month")
    return rounded(rounded(d, "error", "abs_error", n=7), "pct_error")


@query("eva6_error_by_hour", "SELECT CAST(hour(timestamp) AS INT) AS hour, round(avg(abs(wait_time-yhat)),6) AS mean_abs_error, round(avg(wait_time-yhat),6) AS mean_error, count(*) AS n FROM v_pred GROUP BY 1")
def eva6(t):
    d = evaluate.error_table(pred(t), T, W, "yhat").groupBy("hour")
    return rounded(d.agg(F.avg("abs_error").alias("mean_abs_error"), F.avg("error").alias("mean_error"), F.count(F.lit(1)).alias("n")), "mean_abs_error", "mean_error")


@query(
    "eva6_error_by_wait_bin",
    """SELECT CASE WHEN wait_time>=60 THEN '60+' WHEN wait_time>=30 THEN '30-60' WHEN wait_time>=10 THEN '10-30' ELSE '0-10' END AS wait_range, round(avg(abs(wait_time-yhat)),6) AS mae, round(stddev_samp(abs(wait_time-yhat)),6) AS std, count(*) AS n FROM v_pred GROUP BY 1""",
)
def eva6_bins(t):
    from slotwise.operators.filters import wait_range

    d = evaluate.error_table(pred(t), T, W, "yhat").groupBy(wait_range(W).alias("wait_range"))
    return rounded(d.agg(F.avg("abs_error").alias("mae"), F.stddev_samp("abs_error").alias("std"), F.count(F.lit(1)).alias("n")), "mae", "std")


@query(
    "eva7_interval_scores",
    """WITH b AS (SELECT *, greatest(yhat - 30, 0) AS lo, yhat + 45 AS hi FROM v_pred) SELECT ride_name, round(avg(CASE WHEN wait_time BETWEEN lo AND hi THEN 100.0 ELSE 0 END),6) AS coverage_rate, round(avg(hi-lo),6) AS avg_width,
    round(avg(hi-lo + 40*(greatest(0,lo-wait_time)+greatest(0,wait_time-hi))),6) AS interval_score FROM b GROUP BY 1""",
)
def eva7(t):
    d = pred(t).withColumn("lo", F.greatest(F.col("yhat") - 30, F.lit(0.0))).withColumn("hi", F.col("yhat") + 45)
    return rounded(evaluate.interval_scores(d, K, W, "lo", "hi"), "coverage_rate", "avg_width", "interval_score")


@query(
    "eva8_mode_gap",
    "SELECT a.ride_name, a.split, round(a.mae,6) AS mae_tf, round(b.mae,6) AS mae_ar, round(b.mae-a.mae,6) AS diff, round((a.mae-b.mae)/a.mae*100,6) AS improvement_pct FROM v_scores a JOIN v_scores b USING (ride_name, split) WHERE a.model='time_of_day' AND b.model='mean'",
)
def eva8(t):
    s = cut_lineage(scores(t))
    d = evaluate.compare_runs(s.where("model='time_of_day'"), s.where("model='mean'"), [K, "split"], "mae", ("_tf", "_ar"))
    return rounded(d, "mae_tf", "mae_ar", "diff", "improvement_pct")


@query(
    "eva9_feature_sets",
    "SELECT a.ride_name, a.split, round(a.rmse,6) AS rmse_without, round(b.rmse,6) AS rmse_with, round(b.rmse-a.rmse,6) AS diff, round((a.rmse-b.rmse)/a.rmse*100,6) AS improvement_pct FROM v_scores a JOIN v_scores b USING (ride_name, split) WHERE a.model='time_of_day' AND b.model='day_time'",
)
def eva9(t):
    s = cut_lineage(scores(t))
    d = evaluate.compare_runs(s.where("model='time_of_day'"), s.where("model='day_time'"), [K, "split"], "rmse", ("_without", "_with"))
    return rounded(d, "rmse_without", "rmse_with", "diff", "improvement_pct")


@query("eva10_drift", "SELECT ride_name, model, round(max(CASE WHEN split='val' THEN mae END),6) AS val, round(max(CASE WHEN split='test' THEN mae END),6) AS test, round(max(CASE WHEN split='test' THEN mae END)-max(CASE WHEN split='val' THEN mae END),6) AS drift FROM v_scores GROUP BY 1,2")
def eva10(t):
    return rounded(evaluate.drift(scores(t), [K, "model"], "mae"), "val", "test", "drift")


@query("eva11_best_model", "SELECT ride_name, arg_min(model, (mae, model)) AS model, round(min(mae),6) AS mae FROM v_scores WHERE split='test' GROUP BY 1")
def eva11(t):
    return rounded(evaluate.best_per_key(scores(t).where("split='test'"), K), "mae")


@query("eva11_win_counts", "SELECT model, count(*) AS n_wins FROM (SELECT ride_name, arg_min(model, (mae, model)) AS model FROM v_scores WHERE split='test' GROUP BY 1) GROUP BY 1")
def eva11_wins(t):
    return evaluate.win_counts(evaluate.best_per_key(scores(t).where("split='test'"), K))


@query(
    "eva12_method_summary",
    """WITH s AS (SELECT model, split, CASE WHEN ride_name <> 'view' THEN mae END AS mae, rmse FROM v_scores)
    SELECT model, split, round(avg(mae),2) AS mae_mean, round(stddev_samp(mae),2) AS mae_std, round(median(mae),2) AS mae_median, round(avg(rmse),2) AS rmse_mean, round(stddev_samp(rmse),2) AS rmse_std, round(median(rmse),2) AS rmse_median FROM s GROUP BY 1,2""",
)
def eva12(t):
    s = cut_lineage(scores(t)).withColumn("mae", F.when(F.col(K) == "view", F.lit(float("inf"))).otherwise(F.col("mae")))
    return evaluate.summarise(s, ["model", "split"], ["mae", "rmse"])


@query("gbt2_residual", "SELECT ride_name, timestamp, round(wait_time - yhat, 7) AS residual FROM v_pred")
def gbt2(t):
    return rounded(models.residual(pred(t), W, "yhat").select(K, T, "residual"), "residual", n=7)


@query(
    "gbt3_interval",
    """WITH s AS (SELECT ride_name, stddev_samp(wait_time) AS s FROM v_hsplit WHERE split='train' GROUP BY 1)
    SELECT ride_name, timestamp, round(greatest(yhat - 1.96*s, 0),6) AS yhat_lower, round(yhat + 1.96*s,6) AS yhat_upper FROM v_pred JOIN s USING (ride_name)""",
)
def gbt3(t):
    d = models.interval(pred(t), t.hourly_split.where("split='train'"), K, W, "yhat")
    return rounded(d.select(K, T, "yhat_lower", "yhat_upper"), "yhat_lower", "yhat_upper")
