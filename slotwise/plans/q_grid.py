"""Slot alignment, closing state, resampling, gap filling."""
from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.operators import evaluate, fill, grid
from slotwise.operators.baselines import Baselines
from slotwise.operators.split import by_boundaries
from slotwise.plans.registry import define_view, query
from slotwise.session import cut_lineage

R = lambda c, n=8: F.round(c, n)

# flagship ------------------------------------------------------------------
define_view(
    "v_fill1",
    """SELECT ride_name, timestamp, date, closed,
       CASE WHEN wait_time IS NULL AND NOT closed THEN
         last_value(CASE WHEN NOT closed THEN wait_time END IGNORE NULLS) OVER
           (PARTITION BY ride_name, date_trunc('hour', timestamp) ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
       ELSE wait_time END AS wait_time FROM v_grid5""",
)


@query(
    "flagship_hourly_profile",
    """WITH f AS (SELECT *, CASE WHEN timestamp < '2024-01-21' THEN 'train' WHEN timestamp < '2024-01-26' THEN 'val' ELSE 'test' END AS split
                  FROM v_fill1 WHERE NOT closed AND wait_time IS NOT NULL),
    tod AS (SELECT ride_name, hour(timestamp)*60+minute(timestamp) AS tk, avg(wait_time) AS m FROM f WHERE split='train' GROUP BY 1,2),
    g AS (SELECT ride_name, avg(wait_time) AS m FROM f WHERE split='train' GROUP BY 1),
    p AS (SELECT f.ride_name, f.split, f.wait_time AS y, coalesce(tod.m, g.m) AS p FROM f
          LEFT JOIN tod ON tod.ride_name=f.ride_name AND tod.tk=hour(f.timestamp)*60+minute(f.timestamp)
          LEFT JOIN g ON g.ride_name=f.ride_name WHERE f.split <> 'train')
    SELECT ride_name, split, round(avg(abs(y-p)),8) AS mae, round(sqrt(avg((y-p)*(y-p))),8) AS rmse,
      round(1-avg((y-p)*(y-p))/var_pop(y),8) AS r2, round(coalesce(avg(CASE WHEN y>0.1 THEN abs(y-p)/(abs(y)+abs(p)) END)*100,0),8) AS smape_pos,
      count(*) AS n_samples FROM p GROUP BY 1,2""",
)
def flagship(t):
    d = fill.fill_within_bucket(t.grid5, "ride_name", "timestamp", "wait_time", "closed", 60)
    d = d.where(~F.col("closed") & F.col("wait_time").isNotNull()).select("ride_name", "timestamp", "wait_time")
    d = cut_lineage(by_boundaries(d, "timestamp", "2024-01-21", "2024-01-26"))  # cleaned facts, read by fit and predict
    p = Baselines().time_of_day(d.where("split = 'train'"), d.where("split <> 'train'"))
    s = evaluate.score(p, ["ride_name", "split"], "wait_time", "yhat", ["mae", "rmse", "r2", "smape_pos", "n_samples"])
    return s.withColumns({c: R(F.col(c)) for c in ("mae", "rmse", "r2", "smape_pos")})


# GRID ----------------------------------------------------------------------
@query(
    "grid1_densify",
    "SELECT ride_name, timestamp, g.date, round(f.wait_time, 8) AS wait_time FROM v_g5 g LEFT JOIN v_slots f USING (ride_name, timestamp)",
)
def grid1(t):
    g = grid.densify(t.slots, "ride_name", "timestamp", "wait_time", "09:00", "21:00", 5)
    return g.withColumn("wait_time", R("wait_time"))


@query(
    "grid1_densify_strict",
    """SELECT k.ride_name, CAST(d.date AS TIMESTAMP) AS timestamp, d.date, round(f.wait_time, 8) AS wait_time
    FROM (SELECT DISTINCT ride_name FROM v_wide) k,
      (SELECT CAST(unnest(generate_series((SELECT min(timestamp) FROM v_wide), (SELECT max(timestamp) FROM v_wide), INTERVAL 1 DAY)) AS DATE) AS date) d
    LEFT JOIN v_wide f ON f.ride_name=k.ride_name AND f.timestamp=d.date""",
)
def grid1_strict(t):
    g = grid.densify(t.wide, "ride_name", "timestamp", "wait_time", "00:00", "00:00", 60, strict=True)
    return g.withColumn("wait_time", R("wait_time"))


@query(
    "grid2_missing_dates",
    """SELECT DISTINCT date FROM (SELECT CAST(unnest(generate_series((SELECT min(timestamp) FROM v_daily), (SELECT max(timestamp) FROM v_daily), INTERVAL 1 DAY)) AS DATE) AS date)
    WHERE date NOT IN (SELECT CAST(timestamp AS DATE) FROM v_daily WHERE wait_time < 60)""",
)
def grid2(t):
    g = grid.slot_grid(t.daily.select("ride_name").distinct(), "ride_name", "timestamp", *grid.date_bounds(t.daily, "timestamp"), "00:00", "00:00", 60)
    return grid.missing_dates(t.daily.where("wait_time < 60"), g, "timestamp")


@query("grid3_mark_closed", "SELECT ride_name, timestamp, closed FROM v_c5")
def grid3(t):
    return t.grid5.select("ride_name", "timestamp", "closed")


@query(
    "grid4_mask_closed",
    """SELECT c.ride_name, c.timestamp, round(CASE WHEN closed THEN 0 ELSE w0 END, 8) AS wait_time,
    round(CASE WHEN NOT closed THEN temperature END, 8) AS temperature FROM v_c60 c LEFT JOIN v_weather USING (timestamp)""",
)
def grid4(t):
    g = grid.densify(t.hourly, "ride_name", "timestamp", "wait_time", "09:00", "21:00", 60, strict=True)
    g = grid.mark_closed(g, t.obs, "timestamp", band=("09:00", "21:00"))
    g = g.join(t.weather.select("timestamp", "temperature"), "timestamp", "left")
    m = grid.mask_closed(g, ["wait_time"], ["temperature"])
    return m.select("ride_name", "timestamp", R("wait_time").alias("wait_time"), R("temperature").alias("temperature"))


@query(
    "grid5_span_histogram",
    """WITH s AS (SELECT CAST(timestamp AS DATE) d, min(hour(timestamp)*60+minute(timestamp)) a, max(hour(timestamp)*60+minute(timestamp)) b FROM v_obs GROUP BY 1)
    SELECT edge, CAST(m AS INTEGER) AS minute_of_day, count(*) AS n_days FROM (SELECT 'first' AS edge, a AS m FROM s UNION ALL SELECT 'last', b FROM s) GROUP BY 1,2""",
)
def grid5(t):
    return grid.daily_span_histogram(t.obs, "timestamp")


@query("grid6_daily_span", "SELECT CAST(timestamp AS DATE) AS date, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM v_obs GROUP BY 1")
def grid6(t):
    return grid.daily_span(t.obs, "timestamp")


# RES -----------------------------------------------------------------------
RES1_SQL = """WITH e AS (SELECT ride_name, min(timestamp) a, max(timestamp) b FROM v_half GROUP BY 1),
    s AS (SELECT ride_name, unnest(generate_series(a, b, INTERVAL 5 MINUTE)) AS timestamp FROM e)
    SELECT s.ride_name, s.timestamp, round(h.wait_time, 8) AS wait_time FROM s ASOF LEFT JOIN v_half h ON s.ride_name=h.ride_name AND s.timestamp >= h.timestamp"""


@query("res1_resample_ffill", RES1_SQL)
def res1(t):
    d = grid.resample_ffill(t.half, "ride_name", "timestamp", ["wait_time"], 5)
    return d.withColumn("wait_time", R("wait_time"))


@query(
    "res1_resample_ffill_max_age",
    RES1_SQL.replace("round(h.wait_time, 8)", "CASE WHEN h.timestamp >= s.timestamp - INTERVAL 45 MINUTE THEN round(h.wait_time, 8) END"),
)
def res1_age(t):
    d = grid.resample_ffill(t.half, "ride_name", "timestamp", ["wait_time"], 5, max_age=45)
    return d.withColumn("wait_time", R("wait_time"))


@query(
    "res2_resample_agg",
    """SELECT event_type AS ride_name, time_bucket(INTERVAL '60 minutes', ts) AS timestamp, round(avg(value),8) AS value, arg_min(user_id, ts) AS user_id
    FROM events GROUP BY 1,2""",
)
def res2(t):
    e = t.events.select(F.col("event_type").alias("ride_name"), F.col("ts").alias("timestamp"), "value", "user_id")
    return grid.resample_agg(e, "ride_name", "timestamp", 60, ["value"], ["user_id"]).withColumn("value", R("value"))


INTERP_SQL = """, k AS (SELECT s.ride_name, s.timestamp, f.wait_time AS v,
      last_value(CASE WHEN f.wait_time IS NOT NULL THEN s.timestamp END IGNORE NULLS) OVER w1 AS t0,
      last_value(f.wait_time IGNORE NULLS) OVER w1 AS v0,
      first_value(CASE WHEN f.wait_time IS NOT NULL THEN s.timestamp END IGNORE NULLS) OVER w2 AS t1,
      first_value(f.wait_time IGNORE NULLS) OVER w2 AS v1
      FROM s LEFT JOIN f USING (ride_name, timestamp)
      WINDOW w1 AS (PARTITION BY s.ride_name ORDER BY s.timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             w2 AS (PARTITION BY s.ride_name ORDER BY s.timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT ride_name, timestamp, round(coalesce(v, CASE WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN
      v0 + (v1-v0) * ((epoch_us(timestamp)-epoch_us(t0))/(epoch_us(t1)-epoch_us(t0))) END, v0), 9) AS wait_time FROM k"""


@query(
    "res3_interpolate",
    """WITH f AS (SELECT * FROM v_hourly), e AS (SELECT ride_name, min(timestamp) a, max(timestamp) b FROM f GROUP BY 1),
    s AS (SELECT ride_name, unnest(generate_series(a, b, INTERVAL 5 MINUTE)) AS timestamp FROM e)""" + INTERP_SQL,
)
def res3(t):
    spine = grid.series_spine(t.hourly, ["ride_name"], "timestamp", 5)
    d = spine.join(t.hourly, ["ride_name", "timestamp"], "left")
    return grid.interpolate(d, "ride_name", "timestamp", ["wait_time"]).withColumn("wait_time", R("wait_time", 9))


@query(
    "res3_interpolate_smooth",
    """WITH e AS (SELECT ride_name, min(timestamp) a, max(timestamp) b FROM v_hourly GROUP BY 1),
    s AS (SELECT ride_name, unnest(generate_series(a, b, INTERVAL 5 MINUTE)) AS timestamp FROM e),
    k AS (SELECT ride_name, timestamp, epoch_us(timestamp)/3600000000.0 AS t, wait_time * CAST(1.4142135623730951 AS DOUBLE) AS v FROM v_hourly),
    n AS (SELECT *, t - lag(t) OVER w AS h0, lead(t) OVER w - t AS h1, (v - lag(v) OVER w)/(t - lag(t) OVER w) AS d0, (lead(v) OVER w - v)/(lead(t) OVER w - t) AS d1 FROM k WINDOW w AS (PARTITION BY ride_name ORDER BY t)),
    m AS (SELECT ride_name, timestamp, t, v, CASE WHEN d0 IS NULL THEN coalesce(d1, 0) WHEN d1 IS NULL THEN d0 WHEN d0*d1 > 0 THEN (3*h0 + 3*h1)/((2*h1 + h0)/d0 + (h1 + 2*h0)/d1) ELSE 0 END AS g FROM n),
    p AS (SELECT s.*, m.t AS t0, m.v AS v0, m.g AS g0 FROM s ASOF JOIN m ON m.ride_name = s.ride_name AND s.timestamp >= m.timestamp),
    q AS (SELECT p.*, m.t AS t1, m.v AS v1, m.g AS g1, (epoch_us(p.timestamp)/3600000000.0 - t0)/nullif(m.t - t0, 0) AS x FROM p ASOF JOIN m ON m.ride_name = p.ride_name AND p.timestamp <= m.timestamp)
    SELECT ride_name, timestamp, round(CASE WHEN x IS NULL THEN v0 ELSE v0 + (v1 - v0)*x*x*(3 - 2*x) + (t1 - t0)*x*(1 - x)*(g0*(1 - x) - g1*x) END, 8) AS wait_time FROM q""",
)
def res3_smooth(t):
    spine = grid.series_spine(t.hourly, ["ride_name"], "timestamp", 5)
    d = spine.join(t.hourly, ["ride_name", "timestamp"], "left").withColumn("wait_time", F.col("wait_time") * 1.4142135623730951)  # no exact halves to round
    return grid.interpolate_smooth(d, "ride_name", "timestamp", ["wait_time"]).withColumn("wait_time", R("wait_time", 8))


@query(
    "res4_hold_rate",
    """WITH e AS (SELECT min(date_trunc('hour', timestamp)) a, max(date_trunc('hour', timestamp)) b FROM v_weather), h AS (SELECT date_trunc('hour', timestamp) AS timestamp, avg(rain) AS rain FROM v_weather GROUP BY 1),
    hh AS (SELECT * FROM h WHERE rain IS NOT NULL),
    s AS (SELECT unnest(generate_series(a, b, INTERVAL 5 MINUTE)) AS timestamp FROM e)
    SELECT s.timestamp, round(hh.rain, 8) AS rain_mm_per_hour FROM s ASOF LEFT JOIN hh ON s.timestamp >= hh.timestamp""",
)
def res4(t):
    h = grid.resample_agg(t.weather, [], "timestamp", 60, ["rain"], [])
    d = grid.resample_ffill(h, [], "timestamp", ["rain"], 5)
    return d.select("timestamp", R("rain").alias("rain_mm_per_hour"))


@query(
    "res5_fill_prediction_gaps",
    """WITH f AS (SELECT ride_name, timestamp, wait_time FROM v_half WHERE minute(timestamp)=0),
    s AS (SELECT ride_name, timestamp FROM v_half UNION SELECT ride_name, timestamp FROM v_hourly)""" + INTERP_SQL,
)
def res5(t):
    preds = t.half.where(F.minute("timestamp") == 0).withColumnRenamed("wait_time", "p")
    merged = t.half.unionByName(t.hourly).select("ride_name", "timestamp").distinct().join(preds, ["ride_name", "timestamp"], "full")
    return grid.interpolate(merged, "ride_name", "timestamp", ["p"]).select("ride_name", "timestamp", R("p", 9).alias("wait_time"))


@query(
    "res6_interval_aggregate",
    """WITH i AS (SELECT ride_name, time_bucket(INTERVAL '30 minutes', timestamp) AS timestamp, coalesce(round(avg(CASE WHEN NOT c THEN wait_time END),1),0) AS wait_time, bool_or(c) AS closed, count(*) AS data_points
      FROM (SELECT *, wait_time < 5 AS c FROM v_obs) WHERE hour(timestamp) BETWEEN 9 AND 21 GROUP BY 1,2)
    SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY ride_name ORDER BY timestamp DESC) <= 48""",
)
def res6(t):
    d = t.obs.withColumn("closed", F.col("wait_time") < 5)
    return grid.interval_aggregate(d, "ride_name", "timestamp", "wait_time", "closed")


# FILL ----------------------------------------------------------------------
@query("fill1_within_bucket", "SELECT ride_name, timestamp, closed, round(wait_time, 8) AS wait_time FROM v_fill1")
def fill1(t):
    d = fill.fill_within_bucket(t.grid5, "ride_name", "timestamp", "wait_time", "closed", 60)
    return d.select("ride_name", "timestamp", "closed", R("wait_time").alias("wait_time"))


define_view(
    "v_fill2",
    """SELECT g.ride_name, g.timestamp, g.closed, coalesce(g.wait_time, b.v) AS wait_time FROM v_grid5 g LEFT JOIN (
      SELECT m.ride_name, m.timestamp, arg_min(h.wait_time, abs(epoch_us(h.timestamp) + 7*86400000000 - epoch_us(m.timestamp)) * 1000000 + minute(h.timestamp)) AS v
      FROM v_grid5 m JOIN v_grid5 h ON h.ride_name = m.ride_name AND date_trunc('hour', h.timestamp) = date_trunc('hour', m.timestamp) - INTERVAL 7 DAY
      WHERE m.wait_time IS NULL AND NOT m.closed AND h.wait_time IS NOT NULL AND NOT h.closed GROUP BY 1, 2) b USING (ride_name, timestamp)""",
)


@query("fill2_from_prior_period", "SELECT ride_name, timestamp, closed, round(wait_time, 8) AS wait_time FROM v_fill2")
def fill2(t):
    d = fill.fill_from_prior_period(t.grid5, "ride_name", "timestamp", "wait_time", "closed")
    return d.select("ride_name", "timestamp", "closed", R("wait_time").alias("wait_time"))


# week by week: the first open gap of an hour that starts without a value is seeded from the
# filled week before, then values run forward inside the hour
CHAIN_FILL = """last_value(x IGNORE NULLS) OVER (PARTITION BY ride_name, date_trunc('hour', timestamp), closed ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query(
    "fill2_chained",
    f"""WITH RECURSIVE g AS (SELECT *, row_number() OVER (PARTITION BY ride_name, date_trunc('hour', timestamp), closed ORDER BY timestamp) AS rn,
        CAST(floor((date - (SELECT min(date) FROM v_grid5)) / 7) AS INT) AS wk FROM v_grid5),
    f AS (
      SELECT wk, ride_name, timestamp, closed, CASE WHEN closed THEN x ELSE {CHAIN_FILL} END AS wait_time FROM (SELECT *, wait_time AS x FROM g WHERE wk = 0)
      UNION ALL
      SELECT wk, ride_name, timestamp, closed, CASE WHEN closed THEN x ELSE {CHAIN_FILL} END AS wait_time FROM (
        SELECT g.wk, g.ride_name, g.timestamp, g.closed, CASE WHEN g.wait_time IS NOT NULL OR g.closed OR g.rn > 1 THEN g.wait_time ELSE p.v END AS x
        FROM g JOIN (SELECT DISTINCT wk AS w0 FROM f) o ON g.wk = o.w0 + 1 LEFT JOIN (
          SELECT a.ride_name, a.timestamp, arg_min(f.wait_time, abs(epoch_us(f.timestamp) + 7*86400000000 - epoch_us(a.timestamp)) * 1000000 + minute(f.timestamp)) AS v
          FROM g a JOIN f ON f.ride_name = a.ride_name AND date_trunc('hour', f.timestamp) = date_trunc('hour', a.timestamp) - INTERVAL 7 DAY
          WHERE a.rn = 1 AND NOT a.closed AND a.wait_time IS NULL AND NOT f.closed AND f.wait_time IS NOT NULL GROUP BY 1, 2) p ON p.ride_name = g.ride_name AND p.timestamp = g.timestamp))
    SELECT ride_name, timestamp, closed, round(wait_time, 8) AS wait_time FROM f""",
)
def fill2_chained(t):
    d = fill.fill_gaps_chained(t.grid5, "ride_name", "timestamp", "wait_time", "closed")
    return d.select("ride_name", "timestamp", "closed", R("wait_time").alias("wait_time"))


@query(
    "fill3_report",
    """WITH j AS (SELECT g.ride_name, CASE WHEN g.wait_time IS NOT NULL THEN 'kept' WHEN a.wait_time IS NOT NULL THEN 'same_bucket' WHEN b.wait_time IS NOT NULL THEN 'prior_period' ELSE 'open' END AS r
      FROM v_grid5 g JOIN v_fill1 a USING (ride_name, timestamp) JOIN v_fill2 b USING (ride_name, timestamp))
    SELECT ride_name, count(*) FILTER (r='kept') AS n_kept, count(*) FILTER (r='same_bucket') AS n_same_bucket, count(*) FILTER (r='prior_period') AS n_prior_period,
      count(*) FILTER (r='open') AS n_open, count(*) AS n_rows, round(count(*) FILTER (r IN ('same_bucket','prior_period'))*100.0/nullif(count(*) FILTER (r<>'kept'),0),2) AS pct_filled FROM j GROUP BY 1""",
)
def fill3(t):
    return fill.fill_report(fill.fill_gaps(t.grid5, "ride_name", "timestamp", "wait_time", "closed"), "ride_name")


@query(
    "fill4_ffill",
    """SELECT ride_name, timestamp, round(last_value(wait_time IGNORE NULLS) OVER (PARTITION BY ride_name ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) AS wait_time FROM v_sparse""",
)
def fill4(t):
    d = fill.ffill(t.sparse_grid, "ride_name", "timestamp", ["wait_time"])
    return d.select("ride_name", "timestamp", R("wait_time").alias("wait_time"))


@query("fill5_impute_constant", "SELECT ride_name, timestamp, round(coalesce(wait_time, -1), 8) AS wait_time FROM v_grid5")
def fill5_const(t):
    d = fill.impute(t.grid5, "ride_name", ["wait_time"], "constant", value=-1.0)
    return d.select("ride_name", "timestamp", R("wait_time").alias("wait_time"))


@query(
    "fill5_impute_median",
    """SELECT g.ride_name, g.timestamp, round(coalesce(g.wait_time, m.q), 8) AS wait_time FROM v_grid5 g LEFT JOIN
    (SELECT ride_name, median(wait_time) AS q FROM v_grid5 WHERE timestamp < '2024-01-21' GROUP BY 1) m USING (ride_name)""",
)
def fill5_median(t):
    g = cut_lineage(t.grid5)
    d = fill.impute(g, "ride_name", ["wait_time"], "median", fit_on=g.where("timestamp < '2024-01-21'"))
    return d.select("ride_name", "timestamp", R("wait_time").alias("wait_time"))


@query(
    "fill5_impute_mode",
    """WITH n AS (SELECT o_orderstatus s, o_orderpriority p, count(*) c FROM orders WHERE o_orderdate < '2000-01-01' AND o_custkey % 7 <> 0 GROUP BY 1,2),
    m AS (SELECT s, arg_min(p, (-c, p)) AS p FROM n GROUP BY 1)
    SELECT o_orderkey, o_orderstatus, CASE WHEN o_custkey % 7 <> 0 THEN o_orderpriority ELSE m.p END AS prio FROM orders JOIN m ON m.s = o_orderstatus""",
)
def fill5_mode(t):
    o = t.orders.withColumn("prio", F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderpriority")))
    d = fill.impute(o, "o_orderstatus", ["prio"], "mode", fit_on=o.where("o_orderdate < '2000-01-01'"))
    return d.select("o_orderkey", "o_orderstatus", "prio")
