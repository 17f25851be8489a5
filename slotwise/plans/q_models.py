"""Learned models and roll-out."""
from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.functions import calendar as cal
from slotwise.operators import enrich, evaluate, features, models, rollout, windows
from slotwise.operators.baselines import Baselines
from slotwise.plans.q_forecast import rounded
from slotwise.plans.registry import define_view, query
from slotwise.session import cut_lineage, shared_folder

R = lambda c, n=6: F.round(c, n)
K, T, W = "ride_name", "timestamp", "wait_time"
FEATURES = ["hour", "weekday", "is_weekend", "lag1", "avg3"]


def frame(t):
    """Hourly rows with split, calendar columns and past waits."""
    d = windows.day_features(t.hourly_split, K, T, W)
    return d.select(
        K, T, W, "split", F.hour(T).alias("hour"), F.weekday(T).alias("weekday"), cal.day_flags(T)["is_weekend"].alias("is_weekend"),
        F.coalesce("wait_time_lag_1h", F.lit(0.0)).alias("lag1"), F.coalesce("rolling_avg_3h", F.lit(0.0)).alias("avg3"),
    )


def boosted(t):
    """Half-hour slots with weather as the boosted-tree frame, and its feature columns."""
    d = features.boosted_frame(t.half_split.join(t.weather.drop("wind"), T), K, T, W, "temperature", "rain", [W])
    return d, [c for c in d.columns if c not in (K, T, W, "split")]


@query("gbt1_boosted_trees")
def gbt1(t):
    d, cols = boosted(t)
    m = models.BoostedModel(K, W, cols, trees=100, depth=6).fit(d.where("split='train'"))
    p = m.predict(d.where("split<>'train'"))
    return evaluate.score(p, [K, "split"], W, "yhat", ["mae", "rmse", "r2", "n_samples"])


# one tree with one split, where SQL can try every split
STUMP_SQL = """WITH st AS (SELECT ride_name, avg(wait_time) km, stddev_samp(wait_time) ks FROM v_hsplit WHERE split='train' GROUP BY 1),
    d AS (SELECT h.ride_name, h.timestamp, h.split, h.wait_time AS y, [st.km, st.ks, CAST(hour(h.timestamp) AS DOUBLE)] AS xs FROM v_hsplit h JOIN st USING (ride_name)),
    f AS (SELECT ride_name, timestamp, split, y, xs[i] AS x, i FROM d, unnest([1, 2, 3]) AS u(i)),
    c AS (SELECT i, x, count(*) n, sum(y) s FROM f WHERE split='train' GROUP BY 1, 2),
    cum AS (SELECT i, x, sum(n) OVER w nl, sum(s) OVER w sl, sum(n) OVER (PARTITION BY i) nt, sum(s) OVER (PARTITION BY i) st FROM c WINDOW w AS (PARTITION BY i ORDER BY x)),
    best AS (SELECT * FROM cum WHERE nl >= 5 AND nt - nl >= 5 ORDER BY sl*sl/nl + (st-sl)*(st-sl)/(nt-nl) DESC, i LIMIT 1)
    """


def stump(t):
    d = t.hourly_split.withColumn("hour", F.hour(T).cast("double"))
    return d, models.BoostedModel(K, W, ["hour"], trees=1, depth=1).fit(d.where("split='train'"))


@query("gbt1_single_split", STUMP_SQL + "SELECT ride_name, timestamp, round(CASE WHEN f.x <= best.x THEN sl/nl ELSE (st-sl)/(nt-nl) END, 6) AS yhat FROM f JOIN best USING (i) WHERE split<>'train'")
def gbt1_stump(t):
    d, m = stump(t)
    return rounded(m.predict(d.where("split<>'train'")).select(K, T, "yhat"), "yhat")


@query("gbt4_importances")
def gbt4(t):
    d, cols = boosted(t)
    return models.BoostedModel(K, W, cols, trees=100, depth=6).fit(d.where("split='train'")).importances(t.spark)


@query("gbt4_single_split", STUMP_SQL + "SELECT ['key', 'hour'][j] AS feature, CASE WHEN (j = 2) = (i = 3) THEN 1.0::DOUBLE ELSE 0 END AS importance FROM best, unnest([1, 2]) AS u(j)")
def gbt4_stump(t):
    """A key's mean and deviation can name the same split, so their importances are added."""
    name = F.when(F.col("feature").startswith("key_"), "key").otherwise(F.col("feature"))
    return stump(t)[1].importances(t.spark).groupBy(name.alias("feature")).agg(F.sum("importance").alias("importance"))


@query(
    "lin1_single_feature",
    """WITH d AS (SELECT ride_name, wait_time AS y, CAST(hour(timestamp) AS DOUBLE) AS x FROM v_hsplit WHERE split='train'), m AS (SELECT ride_name, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d GROUP BY 1)
    SELECT h.ride_name, h.timestamp, round(a + b*hour(h.timestamp), 6) AS yhat FROM v_hsplit h JOIN m USING (ride_name) WHERE split<>'train'""",
)
def lin1_single(t):
    d = t.hourly_split.withColumn("x", models.feature_array([F.hour(T)]))
    m = models.ridge_fit(d.where("split='train'"), [K], "x", W, alpha=0.0)
    return rounded(models.ridge_predict(d.where("split<>'train'"), m, [K], "x").select(K, T, "yhat"), "yhat")


def lin_frame(t):
    hours = [(F.hour(T) == h).cast("int") for h in range(24)]
    days = [(F.weekday(T) == d).cast("int") for d in range(7)]
    return frame(t).withColumn("x", models.feature_array([*hours, *days, "lag1", "avg3", F.col("lag1") * F.col("avg3")]))


@query("lin1_ridge")
def lin1(t):
    d = lin_frame(t)
    m = models.ridge_fit(d.where("split='train'"), [K], "x", W, alpha=1.0)
    p = models.ridge_predict(d.where("split<>'train'"), m, [K], "x")
    return evaluate.score(p, [K, "split"], W, "yhat", ["mae", "rmse", "r2", "n_samples"])


@query("lin1_coefficients")
def lin1_coefficients(t):
    m = models.ridge_fit(lin_frame(t).where("split='train'"), [K], "x", W, alpha=1.0)
    names = [f"hour_{h}" for h in range(24)] + [f"weekday_{d}" for d in range(7)] + ["lag1", "avg3", "lag1 avg3"]
    return models.coefficient_ranking(m, [K], names)


@query("tun1_ridge_search")
def tun1(t):
    return models.search_ridge(lin_frame(t), [K], T, "x", W, [0.1, 1.0, 10.0, 100.0], folds=3)


@query(
    "tun1_ridge_single_feature",
    """WITH d AS (SELECT ride_name, timestamp, wait_time AS y, CAST(hour(timestamp) AS DOUBLE) AS x, ntile(4) OVER (PARTITION BY ride_name ORDER BY timestamp) AS tile FROM v_hourly),
    r AS (SELECT d.*, CAST(f AS INT) AS fold FROM d, unnest(generate_series(1, 3)) AS u(f) WHERE f >= greatest(tile - 1, 1)),
    s AS (SELECT ride_name, fold, avg(x) mx, avg(y) my, regr_sxx(y, x) sxx, regr_sxy(y, x) sxy FROM r WHERE tile <= fold GROUP BY 1, 2),
    e AS (SELECT r.ride_name, r.fold, a AS alpha, avg(abs(r.y - (my + sxy/(sxx+a)*(r.x-mx)))) AS mae FROM r JOIN s USING (ride_name, fold), unnest([0.5::DOUBLE, 5000.0::DOUBLE]) AS v(a) WHERE r.tile = r.fold + 1 GROUP BY 1, 2, 3)
    SELECT ride_name, alpha, round(avg(mae), 6) AS mean_mae, count(*) AS n_folds FROM e GROUP BY 1, 2""",
)
def tun1_single(t):
    d = t.hourly.withColumn("x", models.feature_array([F.hour(T)]))
    return rounded(models.search_ridge(d, [K], T, "x", W, [0.5, 5000.0], folds=3), "mean_mae")


#: Value lists of the random search.
SPACE = {"trees": [100], "rate": [0.01, 0.05, 0.1], "depth": [3, 5, 7], "leaf": [1, 3, 5], "rows": [0.6, 0.8, 1.0], "columns": [0.6, 0.8, 1.0]}


@query("tun1_boosted_search")
def tun1_boosted(t):
    """Ten random sets over three folds of the training rows; the best one, refitted, is scored on the test rows."""
    d, cols = boosted(t)
    sets = models.random_candidates(SPACE, 10)
    found, best = models.search_boosted(d.where("split='train'"), K, T, W, cols, sets)
    test = evaluate.score(best.predict(d.where("split='test'")), [], W, "yhat", ["rmse"]).select(F.col("rmse").alias("refit_rmse"))
    return found.withColumn("refit_rmse", F.when(F.col("best"), test.scalar()))


@query(
    "tun1_boosted_single_split",
    """WITH d AS (SELECT ride_name, timestamp, wait_time AS y, CAST(hour(timestamp) AS DOUBLE) AS x, ntile(3) OVER (PARTITION BY ride_name ORDER BY timestamp) AS tile FROM v_hourly WHERE ride_name = 'view'),
    r AS (SELECT d.*, f AS fold FROM d, unnest([1, 2]) AS u(f)),
    c AS (SELECT fold, x, count(*) n, sum(y) s FROM r WHERE tile <= fold GROUP BY 1, 2),
    cum AS (SELECT fold, x, sum(n) OVER w nl, sum(s) OVER w sl, sum(n) OVER (PARTITION BY fold) nt, sum(s) OVER (PARTITION BY fold) st FROM c WINDOW w AS (PARTITION BY fold ORDER BY x)),
    b AS (SELECT *, leaf FROM cum, unnest([5, 60]) AS u(leaf) WHERE nl >= leaf AND nt - nl >= leaf QUALIFY row_number() OVER (PARTITION BY fold, leaf ORDER BY sl*sl/nl + (st-sl)*(st-sl)/(nt-nl) DESC) = 1),
    a AS (SELECT fold, leaf, sum(y) / count(*) AS mean FROM r, unnest([5, 60]) AS u(leaf) WHERE tile <= fold GROUP BY 1, 2),
    e AS (SELECT a.leaf, r.fold, sqrt(avg(power(r.y - CASE WHEN b.x IS NULL THEN mean WHEN r.x <= b.x THEN sl/nl ELSE (st-sl)/(nt-nl) END, 2))) AS rmse
          FROM r JOIN a ON a.fold = r.fold LEFT JOIN b ON b.fold = r.fold AND b.leaf = a.leaf WHERE tile = r.fold + 1 GROUP BY 1, 2),
    m AS (SELECT leaf, avg(rmse) AS v FROM e GROUP BY 1)
    SELECT CAST(CASE leaf WHEN 5 THEN 0 ELSE 1 END AS INT) AS candidate, '{"depth": 1, "leaf": ' || leaf || ', "trees": 1}' AS params, round(v, 6) AS mean_rmse, CAST(2 AS INT) AS n_folds, row_number() OVER (ORDER BY v, leaf) = 1 AS best FROM m""",
)
def tun1_boosted_single(t):
    d = t.hourly.where(F.col(K) == "view").withColumn("hour", F.hour(T).cast("double"))
    found, _ = models.search_boosted(d, K, T, W, ["hour"], [{"trees": 1, "depth": 1, "leaf": n} for n in (5, 60)], folds=2)
    return rounded(found, "mean_rmse")


@query(
    "sea1_fourier_terms",
    """SELECT o_orderkey, """ + ", ".join(f"round({f}(2*pi()*{k}*(epoch(o_orderdate)/86400.0)/{p}), 6) AS {n}_{f}_{k}" for n, p, o in (("yearly", 365.25, 2), ("weekly", 7, 1)) for k in range(1, o + 1) for f in ("sin", "cos")) + " FROM orders",
)
def sea1_terms(t):
    d = t.orders.select("o_orderkey", *[R(e).alias(n) for n, e in models.fourier("o_orderdate", 2, 1, 0).items()])
    return d


# a trend with one change of slope under a Laplace prior, where SQL can solve the two equations
SEA_SQL = """WITH e AS (SELECT min(epoch_us(timestamp)) a, max(epoch_us(timestamp)) - min(epoch_us(timestamp)) s FROM v_dsplit WHERE split='train'),
    c AS (SELECT (epoch_us(TIMESTAMP '1997-07-01') - a) / CAST(s AS DOUBLE) AS c FROM e),
    d AS (SELECT ride_name, timestamp, split, wait_time, (epoch_us(timestamp) - a) / CAST(s AS DOUBLE) AS x, greatest((epoch_us(timestamp) - a) / CAST(s AS DOUBLE) - c, 0) AS h FROM v_dsplit, e, c),
    k AS (SELECT ride_name, max(abs(wait_time)) AS top FROM d WHERE split='train' GROUP BY 1),
    g AS (SELECT ride_name, top, avg(wait_time/top) my, avg(x) mx, avg(h) mh, regr_sxx(h, x) sxx, regr_syy(h, x) shh, regr_sxy(h, x) sxh, regr_sxy(wait_time/top, x) sxy, regr_sxy(wait_time/top, h) shy
          FROM d JOIN k USING (ride_name) WHERE split='train' GROUP BY 1, 2),
    w AS (SELECT *, sign(shy - sxh*sxy/sxx) * greatest(abs(shy - sxh*sxy/sxx) - 0.3*0.3/0.05, 0) / (shh - sxh*sxh/sxx) AS v FROM g)
    SELECT ride_name, timestamp, round(greatest(top * (my + (sxy - sxh*v)/sxx*(x - mx) + v*(h - mh)), 0), 6) AS yhat FROM d JOIN w USING (ride_name) WHERE split<>'train'"""


@query("sea1_trend_change", SEA_SQL)
def sea1_trend(t):
    d = t.daily_split
    m = models.SeasonalModel([K], T, W, changepoints=["1997-07-01"], orders=(0, 0, 0), noise=0.3).fit(d.where("split='train'"))
    return rounded(m.predict(d.where("split<>'train'")).select(K, T, "yhat"), "yhat")


#: How each regressor enters; the others of the frame are additive.
REGRESSORS = {n: "multiplicative" for n in ("temperature", "rain", "high_temp", "any_rain", "rain_weekend", "between_covid_lockdowns", "covid_recovery")} | {n: "additive" for n in ("temp_squared", "temp_weekend")}


@query("sea1_seasonal_model")
def sea1(t):
    """Half-hour slots with weather: 25 changes of slope, yearly, weekly and daily terms, three countries' holidays, nine regressors."""
    d = features.seasonal_frame(t.half_split.join(t.weather.drop("wind"), T).where("temperature IS NOT NULL AND rain IS NOT NULL"), T, W)
    days = t.holidays.select("date", F.col("country").alias("name"))
    m = models.SeasonalModel(
        [K], "ds", "y", REGRESSORS, mode="multiplicative", holidays=days, holiday_names=["DE", "CH", "FR"], standardise=["temperature", "rain", "temp_squared", "temp_weekend", "rain_weekend"]
    ).fit(d.where("split='train'"))
    p = m.predict(d.where("split<>'train'"))
    return evaluate.interval_scores(p, [K, "split"], "y", "yhat_lower", "yhat_upper")


@query("sea1_multiplicative")
def sea1_mult(t):
    d = t.daily_split.withColumn("is_weekend", cal.day_flags(T)["is_weekend"])
    m = models.SeasonalModel([K], T, W, {"is_weekend": "multiplicative"}, orders=(10, 3, 0), mode="multiplicative").fit(d.where("split='train'"))
    return evaluate.score(m.predict(d.where("split<>'train'")), [K, "split"], W, "yhat", ["mae", "rmse", "n_samples"])


# two stages and roll-out -----------------------------------------------------------------
def two_stage(t, n=48):
    """Half-hour series with a first-stage forecast everywhere, and the residual model."""
    s = t.half_split
    d = Baselines(out="base").time_of_day(s.where("split='train'"), s)
    d = cut_lineage(d.select(K, T, W, "split", "base"))
    return d, cut_lineage(rollout.fit_residual_model(d.where("split='train'"), [K], T, W, "base", n))


# the same with one lag pair, where SQL can solve the two normal equations
define_view("v_stage1", "SELECT f.ride_name, f.timestamp, f.split, f.wait_time, coalesce(m.m, g.m) AS base, f.wait_time - coalesce(m.m, g.m) AS r FROM v_halfsplit f LEFT JOIN (SELECT ride_name, hour(timestamp)*60+minute(timestamp) AS tk, avg(wait_time) AS m FROM v_halfsplit WHERE split='train' GROUP BY 1, 2) m ON m.ride_name=f.ride_name AND m.tk=hour(f.timestamp)*60+minute(f.timestamp) LEFT JOIN (SELECT ride_name, avg(wait_time) AS m FROM v_halfsplit WHERE split='train' GROUP BY 1) g ON g.ride_name=f.ride_name")
define_view("v_lag1", "SELECT *, lag(wait_time) OVER (PARTITION BY ride_name ORDER BY timestamp) AS w1, lag(r) OVER (PARTITION BY ride_name ORDER BY timestamp) AS r1, row_number() OVER (PARTITION BY ride_name ORDER BY timestamp) AS i FROM v_stage1")
define_view(
    "v_coef1",
    """SELECT ride_name, b1, b2, my - b1*m1 - b2*m2 AS b0 FROM (SELECT *, (s1y*(s22+10) - s2y*s12)/((s11+10)*(s22+10) - s12*s12) AS b1, (s2y*(s11+10) - s1y*s12)/((s11+10)*(s22+10) - s12*s12) AS b2 FROM (
      SELECT ride_name, avg(w1) m1, avg(r1) m2, avg(r) my, var_pop(w1)*count(*) s11, var_pop(r1)*count(*) s22, covar_pop(w1, r1)*count(*) s12, covar_pop(w1, r)*count(*) s1y, covar_pop(r1, r)*count(*) s2y FROM v_lag1 WHERE split='train' AND i > 1 GROUP BY 1))""",
)


@query(
    "rol1_one_lag",
    "SELECT ride_name, timestamp, round(CASE WHEN i = 1 THEN base ELSE greatest(base + b0 + b1*w1 + b2*r1, 0) END, 5) AS prediction FROM v_lag1 JOIN v_coef1 USING (ride_name)",
)
def rol1_one(t):
    d, m = two_stage(t, n=1)
    return rounded(rollout.teacher_forced(d, m, [K], T, W, "base", 1).select(K, T, "prediction"), "prediction", n=5)


@query(
    "rol2_one_lag",
    """WITH RECURSIVE d AS (SELECT l.*, b0, b1, b2, row_number() OVER (PARTITION BY l.ride_name, CAST(timestamp AS DATE) ORDER BY timestamp) AS k FROM v_lag1 l JOIN v_coef1 USING (ride_name)),
    p AS (
      SELECT ride_name, CAST(timestamp AS DATE) AS day, timestamp, k, CASE WHEN i = 1 THEN base ELSE greatest(base + b0 + b1*w1 + b2*r1, 0) END AS pred, CASE WHEN i = 1 THEN 0 ELSE b0 + b1*w1 + b2*r1 END AS res, hour(timestamp) >= 11 AND i > 1 AS fed, wait_time, r FROM d WHERE k = 1
      UNION ALL
      SELECT d.ride_name, p.day, d.timestamp, d.k, greatest(d.base + x.res, 0), x.res, hour(d.timestamp) >= 11, d.wait_time, d.r
      FROM p JOIN d ON d.ride_name = p.ride_name AND CAST(d.timestamp AS DATE) = p.day AND d.k = p.k + 1,
        LATERAL (SELECT d.b0 + d.b1*(CASE WHEN p.fed THEN p.pred ELSE p.wait_time END) + d.b2*(CASE WHEN p.fed THEN p.res ELSE p.r END) AS res) x)
    SELECT ride_name, timestamp, round(pred, 5) AS prediction FROM p""",
)
def rol2_one(t):
    d, m = two_stage(t, n=1)
    return rounded(rollout.same_day(d, m, [K], T, W, "base", 1, 11).select(K, T, "prediction"), "prediction", n=5)


@query(
    "res1_two_stage_one_lag",
    """WITH p AS (SELECT ride_name, split, wait_time AS y, CASE WHEN i = 1 THEN base ELSE greatest(base + b0 + b1*w1 + b2*r1, 0) END AS f FROM v_lag1 JOIN v_coef1 USING (ride_name) WHERE split<>'train')
    SELECT ride_name, split, round(avg(abs(y - f)), 5) AS mae, round(sqrt(avg((y - f)*(y - f))), 5) AS rmse, round(1 - avg((y - f)*(y - f))/var_pop(y), 5) AS r2, count(*) AS n_samples FROM p GROUP BY 1, 2""",
)
def res_two_stage_one(t):
    d, m = two_stage(t, n=1)
    p = rollout.teacher_forced(d, m, [K], T, W, "base", 1).where("split<>'train'")
    return rounded(evaluate.score(p, [K, "split"], W, "prediction", ["mae", "rmse", "r2", "n_samples"]), "mae", "rmse", "r2", n=5)


@query("res1_two_stage")
def res_two_stage(t):
    d, m = two_stage(t)
    p = rollout.teacher_forced(d, m, [K], T, W, "base").where("split<>'train'")
    return evaluate.score(p, [K, "split"], W, "prediction", ["mae", "rmse", "r2", "n_samples"])


@query("rol1_teacher_forced")
def rol1(t):
    d, m = two_stage(t)
    return rollout.teacher_forced(d, m, [K], T, W, "base").select(K, T, "base", "residual_prediction", "prediction")


@query("rol2_same_day")
def rol2(t):
    d, m = two_stage(t)
    return rollout.same_day(d, m, [K], T, W, "base")


def coming(t, d, days=7):
    """Future slots of every ride after its last day, with the first-stage forecast."""
    last = F.date_add(t.obs.agg(F.max(F.to_date(T)).alias("d")).scalar(), 1)
    f = rollout.future_slots(t.obs.select(K).distinct(), K, T, last, days)
    return Baselines(out="base").time_of_day(d.where("split='train'"), f.select(K, T))


def roll_sql(days: int, restart: str) -> str:
    """Slot after slot from the last known pair; ``restart`` is the residual that a day's first slot sees of the slot before."""
    return f"""WITH RECURSIVE e AS (SELECT max(CAST(timestamp AS DATE)) + 1 AS d0 FROM v_obs),
    f AS (SELECT ride_name, ((d0 + to_days(CAST(i AS INT)) + to_minutes(CAST(m AS BIGINT))) AT TIME ZONE 'Europe/Zurich') AT TIME ZONE 'UTC' AS timestamp FROM v_keys, e, unnest(generate_series(0, {days - 1})) AS a(i), unnest(generate_series(540, 1050, 30)) AS b(m)),
    g AS (SELECT ride_name, avg(wait_time) AS m FROM v_halfsplit WHERE split='train' GROUP BY 1),
    h AS (SELECT ride_name, hour(timestamp)*60+minute(timestamp) AS tk, avg(wait_time) AS m FROM v_halfsplit WHERE split='train' GROUP BY 1, 2),
    n AS (SELECT f.ride_name, f.timestamp, coalesce(h.m, g.m) AS base, row_number() OVER (PARTITION BY f.ride_name ORDER BY f.timestamp) AS k, row_number() OVER (PARTITION BY f.ride_name, CAST(f.timestamp AS DATE) ORDER BY f.timestamp) AS slot
          FROM f JOIN g ON g.ride_name = f.ride_name LEFT JOIN h ON h.ride_name = f.ride_name AND h.tk = hour(f.timestamp)*60+minute(f.timestamp)),
    s AS (SELECT ride_name, arg_max(wait_time, timestamp) AS w, arg_max(r, timestamp) AS r FROM v_stage1 GROUP BY 1),
    p AS (
      SELECT n.ride_name, n.timestamp, n.k, n.base, b0 + b1*w + b2*r AS res, greatest(n.base + b0 + b1*w + b2*r, 0) AS pred FROM n JOIN s USING (ride_name) JOIN v_coef1 USING (ride_name) WHERE k = 1
      UNION ALL
      SELECT n.ride_name, n.timestamp, n.k, n.base, x.res, greatest(n.base + x.res, 0) FROM p JOIN n ON n.ride_name = p.ride_name AND n.k = p.k + 1 JOIN v_coef1 c ON c.ride_name = p.ride_name,
        LATERAL (SELECT b0 + b1*p.pred + b2*(CASE WHEN n.slot = 1 THEN {restart} ELSE p.res END) AS res) x)
    """


@query("rol3_one_lag", roll_sql(2, "p.res") + "SELECT ride_name, timestamp, round(pred, 5) AS prediction, round(res, 5) AS residual_prediction FROM p")
def rol3_one(t):
    d, m = two_stage(t, n=1)
    p = rollout.horizon(d, coming(t, d, 2), m, [K], T, W, "base", 1)
    return rounded(p.select(K, T, "prediction", "residual_prediction"), "prediction", "residual_prediction", n=5)


@query("rol4_one_lag", roll_sql(3, "p.pred - p.base") + "SELECT ride_name, timestamp, round(pred, 5) AS prediction, round(base, 5) AS baseline FROM p")
def rol4_one(t):
    d, m = two_stage(t, n=1)
    f = cut_lineage(coming(t, d, 3))
    days = [str(r[0]) for r in f.select(F.to_date(T)).distinct().orderBy(F.to_date(T)).collect()]
    p = rollout.incremental(d, f, m, K, T, W, "base", shared_folder(t.spark, "rollout"), days, 1)
    return rounded(p.select(K, T, "prediction", "baseline"), "prediction", "baseline", n=5)


@query("rol3_horizon")
def rol3(t):
    d, m = two_stage(t)
    return rollout.horizon(d, coming(t, d, 2), m, [K], T, W, "base")


@query("rol4_incremental")
def rol4(t):
    d, m = two_stage(t)
    f = cut_lineage(coming(t, d, 7))
    days = [str(r[0]) for r in f.select(F.to_date(T)).distinct().orderBy(F.to_date(T)).collect()]
    return rollout.incremental(d, f, m, K, T, W, "base", shared_folder(t.spark, "rollout"), days)


@query(
    "rol5_future_slots",
    """WITH e AS (SELECT max(CAST(timestamp AS DATE)) + 1 AS d0 FROM v_obs)
    SELECT ride_name, (l AT TIME ZONE 'Europe/Zurich') AT TIME ZONE 'UTC' AS timestamp, l AS local_ts, CAST(l AS DATE) AS local_date, CAST(l AS DATE) IN (SELECT date FROM v_holidays WHERE country='DE') AS is_german_holiday
    FROM (SELECT ride_name, d0 + to_days(CAST(i AS INT)) + to_minutes(CAST(m AS BIGINT)) AS l FROM v_keys, e, unnest(generate_series(0, 6)) AS a(i), unnest(generate_series(540, 1050, 30)) AS b(m))""",
)
def rol5(t):
    last = F.date_add(t.obs.agg(F.max(F.to_date(T)).alias("d")).scalar(), 1)
    f = rollout.future_slots(t.obs.select(K).distinct(), K, T, last, 7)
    return enrich.add_holiday_flags(f, t.holidays, "local_ts", {"DE": "is_german_holiday"})


@query(
    "rol5_future_weather",
    """WITH e AS (SELECT max(CAST(timestamp AS DATE)) + 1 AS d0 FROM v_obs), f AS (SELECT ride_name, ((d0 + to_days(CAST(i AS INT)) + to_minutes(CAST(m AS BIGINT))) AT TIME ZONE 'Europe/Zurich') AT TIME ZONE 'UTC' AS timestamp
      FROM v_keys, e, unnest(generate_series(0, 8)) AS a(i), unnest(generate_series(540, 1050, 30)) AS b(m)),
    q AS (SELECT DISTINCT date_trunc('hour', timestamp) AS hr FROM f),
    b AS (SELECT hr, arg_min(w.timestamp, (abs(epoch_us(w.timestamp) - epoch_us(hr)), w.timestamp)) AS wt FROM q, v_weather w WHERE abs(epoch_us(w.timestamp) - epoch_us(hr)) < 7*86400000000 GROUP BY 1)
    SELECT f.ride_name, f.timestamp, round(coalesce(w.temperature, 20), 8) AS temperature, CASE WHEN coalesce(w.rain, 0) > 0.1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rain, round(coalesce(w.rain, 0), 8) AS rain_mm
    FROM f LEFT JOIN b ON b.hr = date_trunc('hour', f.timestamp) LEFT JOIN v_weather w ON w.timestamp = b.wt""",
)
def rol5_weather(t):
    last = F.date_add(t.obs.agg(F.max(F.to_date(T)).alias("d")).scalar(), 1)
    f = rollout.future_slots(t.obs.select(K).distinct(), K, T, last, 9).select(K, T)
    return rounded(enrich.nearest_weather(f, t.weather, T), "temperature", "rain_mm", n=8)


@query("rol5_slot_count_check", "WITH e AS (SELECT max(CAST(timestamp AS DATE)) + 1 AS d0 FROM v_obs) SELECT ride_name, CAST(d0 + CAST(i AS INT) AS DATE) AS local_date, CAST(18 AS BIGINT) AS n_slots, true AS ok FROM v_keys, e, unnest(generate_series(0, 6)) AS a(i)")
def rol5_check(t):
    last = F.date_add(t.obs.agg(F.max(F.to_date(T)).alias("d")).scalar(), 1)
    return rollout.slot_count_check(rollout.future_slots(t.obs.select(K).distinct(), K, T, last, 7), K, "local_date", 18)


@query("rol6_sampled_forecast")
def rol6(t):
    s = t.hourly_split
    p = Baselines().time_of_day(s.where("split='train'"), s.where("split='test'"))
    return rollout.sample_forecast(p, [K, T], "yhat", F.greatest(F.col("yhat") * 0.15, F.lit(0.1)), n=100)


@query("rol6_sample_bounds", "SELECT ride_name, timestamp, CAST(100 AS BIGINT) AS n_samples, true AS ordered, true AS near FROM v_hsplit WHERE split='test'")
def rol6_bounds(t):
    """The samples of every row: as many as asked for, points in order, mean and deviation near those of the normal they are drawn from."""
    s = t.hourly_split
    p = Baselines().time_of_day(s.where("split='train'"), s.where("split='test'"))
    sd = F.greatest(F.col("yhat") * 0.15, F.lit(0.1))
    d = rollout.sample_forecast(p, [K, T], "yhat", sd, n=100).join(p.select(K, T, "yhat"), [K, T])
    near = (F.abs(F.col("mean") - F.col("yhat")) < 0.5 * sd) & F.col("std").between(0.6 * sd, 1.45 * sd)
    return d.select(K, T, "n_samples", (F.col("p5").between(0, F.col("mean")) & (F.col("mean") <= F.col("p95"))).alias("ordered"), near.alias("near"))


PROB = {
    "linear": "greatest(0.02::DOUBLE, 1 - 0.02::DOUBLE*e)", "exponential": "greatest(0.05::DOUBLE, pow(0.95::DOUBLE, e))",
    "inverse_sigmoid": "greatest(0.05::DOUBLE, 1/(1+exp((e - n*0.4::DOUBLE)*0.3::DOUBLE)))", "other": "greatest(0.05::DOUBLE, 1 - 0.03::DOUBLE*e)",
}


@query("rol7_schedules", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(CASE WHEN n <= 1 THEN 1 ELSE {x} END, 6) AS p_{k}" for k, x in PROB.items()) + " FROM (SELECT l_orderkey, l_linenumber, l_quantity AS e, l_suppkey AS n FROM lineitem)")
def rol7(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", *[R(rollout.sampling_probability(F.col("l_quantity"), F.col("l_suppkey"), k)).alias(f"p_{k}") for k in PROB]
    )


@query("rol8_noisy_history")
def rol8(t):
    d = windows.lag_sequence(t.half.withColumn("residual", F.col(W) - 40), K, T, [W, "residual"], 12)
    hist = F.transform("history", lambda p: F.struct(p["at"].alias("at"), p[W].alias("w"), p["residual"].alias("r")))
    noisy = rollout.noisy_history(hist, F.to_date(T), 11, 7, F.col(K), F.col(T))
    changed = F.size(F.filter(F.zip_with(noisy, hist, lambda a, b: a["w"] != b["w"]), lambda x: x))
    return d.select(K, T, changed.alias("n_changed"), F.aggregate(noisy, F.lit(0.0), lambda a, x: a + x["w"]).alias("sum_w"))


LAGS = [f"lag(timestamp, {j}) OVER w" for j in range(1, 13)]


@query(
    "rol8_changed_pairs",
    "SELECT ride_name, timestamp, CAST(" + " + ".join(f"(CAST(l{j} AS DATE) = CAST(timestamp AS DATE) AND hour(l{j}) >= 11)::INT" for j in range(1, 13)) + " AS INT) AS n_changed, true AS others_kept FROM (SELECT ride_name, timestamp, "
    + ", ".join(f"{e} AS l{j}" for j, e in enumerate(LAGS, 1)) + " FROM v_half WINDOW w AS (PARTITION BY ride_name ORDER BY timestamp)) WHERE l12 IS NOT NULL",
)
def rol8_pairs(t):
    """Exactly the pairs of the same day after opening are perturbed."""
    d = windows.lag_sequence(t.half.withColumn("residual", F.col(W) - 40), K, T, [W, "residual"], 12)
    hist = F.transform("history", lambda p: F.struct(p["at"].alias("at"), p[W].alias("w"), p["residual"].alias("r")))
    noisy = rollout.noisy_history(hist, F.to_date(T), 11, 7, F.col(K), F.col(T))
    both = F.zip_with(noisy, hist, lambda a, b: F.struct((a["w"] != b["w"]).alias("w"), (a["r"] != b["r"]).alias("r"), ((F.to_date(b["at"]) == F.to_date(T)) & (F.hour(b["at"]) >= 11)).alias("own")))
    kept = F.forall(both, lambda x: x["own"] | (~x["w"] & ~x["r"]))
    return d.select(K, T, F.size(F.filter(both, lambda x: x["r"])).alias("n_changed"), kept.alias("others_kept"))
