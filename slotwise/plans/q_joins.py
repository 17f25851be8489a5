"""Joins, set operations, ranking."""
from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.functions import text
from slotwise.operators import baselines, enrich, evaluate, grid, sets
from slotwise.operators.scans import CHUNK_ROWS
from slotwise.plans.registry import query

R = lambda c, n=8: F.round(c, n)
K, T, W = "ride_name", "timestamp", "wait_time"


@query(
    "joi1_grid_left_join",
    "SELECT g.ride_name, g.date, CAST(hour(g.timestamp)*60+minute(g.timestamp) AS INT) AS time_key, round(h.wait_time, 8) AS wait_time FROM v_g60 g LEFT JOIN v_hourly h ON h.ride_name=g.ride_name AND CAST(h.timestamp AS DATE)=g.date AND hour(h.timestamp)=hour(g.timestamp)",
)
def joi1(t):
    lo, hi = grid.date_bounds(t.obs, T)
    g = grid.slot_grid(t.obs.select(K).distinct(), K, T, lo, hi, "09:00", "21:00", 60)
    tk = (F.hour(T) * 60 + F.minute(T)).alias("time_key")
    facts = t.hourly.select(K, F.to_date(T).alias("date"), tk, R(W).alias(W))
    return g.select(K, "date", tk).join(facts, [K, "date", "time_key"], "left")


@query("joi2_weather_join", "SELECT h.ride_name, h.timestamp, round(w.temperature, 8) AS temperature FROM v_half h LEFT JOIN v_weather w USING (timestamp)")
def joi2(t):
    return enrich.add_weather(t.half, t.weather, T, ["temperature"]).select(K, T, R("temperature").alias("temperature"))


@query(
    "joi3_attributes",
    "SELECT l_orderkey, l_linenumber, l_partkey, p_brand AS feature_p_brand, p_type AS feature_p_type, p_size AS feature_p_size FROM lineitem LEFT JOIN part ON p_partkey = l_partkey",
)
def joi3(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return enrich.add_attributes(li, t.part, "l_partkey", "p_partkey", ["p_brand", "p_type", "p_size"])


@query(
    "joi4_membership_flags",
    """SELECT ride_name, timestamp, CAST(timestamp AS DATE) IN (SELECT date FROM v_holidays WHERE country='DE') AS is_german_holiday,
    CAST(timestamp AS DATE) IN (SELECT date FROM v_holidays WHERE country='CH') AS is_swiss_holiday, CAST(timestamp AS DATE) IN (SELECT date FROM v_holidays WHERE country='FR') AS is_french_holiday FROM v_obs""",
)
def joi4(t):
    return enrich.add_holiday_flags(t.obs.select(K, T), t.holidays, T)


@query("joi4_tuple_anti", "SELECT ride_name, timestamp FROM v_hourly WHERE (ride_name, CAST(timestamp AS DATE)) NOT IN (SELECT (ride_name, CAST(timestamp AS DATE)) FROM v_obs WHERE wait_time > 200)")
def joi4_anti(t):
    bad = t.obs.where(F.col(W) > 200).select(K, F.to_date(T).alias("d")).distinct()
    return t.hourly.withColumn("d", F.to_date(T)).join(bad, [K, "d"], "left_anti").select(K, T)


@query(
    "joi5_group_stat",
    """SELECT h.ride_name, h.timestamp, round(d.w, 8) AS wait_daily FROM v_hourly h JOIN (SELECT ride_name, CAST(timestamp AS DATE) d, avg(wait_time) AS w FROM v_hourly GROUP BY 1, 2) d ON d.ride_name = h.ride_name AND d.d = CAST(h.timestamp AS DATE)""",
)
def joi5(t):
    d = t.hourly.withColumn("date", F.to_date(T))
    return enrich.add_group_stat(d, [K, "date"], {"wait": F.avg(W)}, "_daily").select(K, T, R("wait_daily").alias("wait_daily"))


@query(
    "joi6_forecast_residual",
    "SELECT h.ride_name, h.timestamp, round(h.wait_time, 8) AS wait_time, round(f.wait_time, 8) AS yhat, round(h.wait_time - f.wait_time, 8) AS residual FROM v_half h LEFT JOIN v_hourly f USING (ride_name, timestamp)",
)
def joi6(t):
    f = t.hourly.withColumnRenamed(W, "yhat")
    d = enrich.join_forecast(t.half, f, [K, T], W, "yhat")
    return d.withColumns({c: R(c) for c in (W, "yhat", "residual")})


@query(
    "joi7_full_outer",
    "SELECT ride_name, timestamp, round(a.wait_time, 8) AS wait_time, round(b.wait_time, 8) AS yhat FROM (SELECT * FROM v_half WHERE hour(timestamp) < 12) a FULL JOIN (SELECT * FROM v_hourly WHERE hour(timestamp) > 6) b USING (ride_name, timestamp)",
)
def joi7(t):
    f = t.hourly.where(F.hour(T) > 6).withColumnRenamed(W, "yhat")
    d = enrich.merge_predictions(t.half.where(F.hour(T) < 12), f, [K, T])
    return d.select(K, T, R(W).alias(W), R("yhat").alias("yhat"))


@query(
    "joi8_before_after",
    """WITH a AS (SELECT ride_name, avg(wait_time) m FROM v_obs GROUP BY 1), b AS (SELECT ride_name, avg(wait_time) m FROM v_obs WHERE wait_time <= 100 GROUP BY 1)
    SELECT ride_name, round(a.m, 6) AS m_before, round(b.m, 6) AS m_after, round(b.m - a.m, 6) AS diff, round((a.m - b.m) / a.m * 100, 6) AS improvement_pct FROM a JOIN b USING (ride_name)""",
)
def joi8(t):
    a = t.obs.groupBy(K).agg(F.avg(W).alias("m"))
    b = t.obs.where(F.col(W) <= 100).groupBy(K).agg(F.avg(W).alias("m"))
    d = evaluate.compare_runs(a, b, [K], "m")
    return d.withColumns({c: R(c, 6) for c in ("m_before", "m_after", "diff", "improvement_pct")})


@query(
    "joi9_exact_lag",
    "SELECT h.ride_name, h.timestamp, round(p.wait_time, 8) AS last_week FROM v_hourly h LEFT JOIN v_hourly p ON p.ride_name = h.ride_name AND p.timestamp = h.timestamp - INTERVAL 7 DAY",
)
def joi9(t):
    return enrich.lag_join(t.hourly, [K], T, W, 7, "last_week").select(K, T, R("last_week").alias("last_week"))


@query(
    "joi10_nearest_in_time",
    """WITH q AS (SELECT ride_name, timestamp + INTERVAL 17 MINUTE AS target FROM v_hourly),
    h AS (SELECT * FROM v_hourly WHERE wait_time > 100),
    c AS (SELECT q.ride_name, q.target, h.timestamp AS ht, h.wait_time, abs(epoch_us(h.timestamp) - epoch_us(q.target)) - CASE WHEN isodow(h.timestamp) = isodow(q.target) THEN 3600000000 ELSE 0 END AS cost FROM q JOIN h USING (ride_name))
    SELECT q.ride_name, q.target, round(b.v, 8) AS v FROM q LEFT JOIN (SELECT ride_name, target, arg_min(wait_time, (cost, ht)) AS v FROM c WHERE cost < 7*86400000000 GROUP BY 1, 2) b USING (ride_name, target)""",
)
def joi10(t):
    q = t.hourly.select(K, (F.col(T) + F.expr("INTERVAL 17 MINUTES")).alias("target"))
    h = t.hourly.where(F.col(W) > 100)
    return baselines.nearest_in_time(q, h, K, "target", T, W, "v").withColumn("v", R("v"))


@query(
    "joi11_nearest_weather",
    """WITH w AS (SELECT timestamp, temperature, rain FROM v_weather WHERE rain > 1), q AS (SELECT DISTINCT date_trunc('hour', timestamp) AS hr FROM v_obs),
    b AS (SELECT hr, arg_min(w.timestamp, (abs(epoch_us(w.timestamp) - epoch_us(hr)), w.timestamp)) AS wt FROM q, w WHERE abs(epoch_us(w.timestamp) - epoch_us(hr)) < 7*86400000000 GROUP BY 1)
    SELECT o.ride_name, o.timestamp, round(coalesce(w.temperature, 20), 8) AS temperature, CASE WHEN coalesce(w.rain, 0) > 0.1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rain, round(coalesce(w.rain, 0), 8) AS rain_mm
    FROM v_obs o LEFT JOIN b ON b.hr = date_trunc('hour', o.timestamp) LEFT JOIN w ON w.timestamp = b.wt""",
)
def joi11(t):
    w = t.weather.where(F.col("rain") > 1)
    d = enrich.nearest_weather(t.obs.select(K, T), w, T)
    return d.withColumn("temperature", R("temperature")).withColumn("rain_mm", R("rain_mm"))


@query("joi12_cross_product", "SELECT ride_name, timestamp, date FROM v_g60")
def joi12(t):
    lo, hi = grid.date_bounds(t.obs, T)
    return grid.slot_grid(t.obs.select(K).distinct(), K, T, lo, hi, "09:00", "21:00", 60)


@query("joi12_dates_and_hours", "SELECT d.date, CAST(h AS INT) AS hour FROM v_days d, unnest(generate_series(0, 23)) AS u(h)")
def joi12_hours(t):
    one = t.obs.agg(F.min(F.to_date(T)).alias("lo"), F.max(F.to_date(T)).alias("hi"))
    return grid.date_hours(one, F.col("lo"), F.col("hi"))


@query(
    "joi13_as_of",
    "SELECT o.ride_name, o.timestamp, round(h.wait_time, 8) AS last_known FROM v_obs o ASOF LEFT JOIN (SELECT * FROM v_hourly WHERE wait_time > 40) h ON h.ride_name = o.ride_name AND o.timestamp >= h.timestamp",
)
def joi13(t):
    h = t.hourly.where(F.col(W) > 40).withColumnRenamed(W, "last_known")
    return enrich.as_of(t.obs.select(K, T), h, K, T, {"last_known": "last_known"}, even=CHUNK_ROWS).withColumn("last_known", R("last_known"))


@query(
    "joi13_as_of_strict",
    "SELECT o.ride_name, o.timestamp, round(h.wait_time, 8) AS last_known FROM v_hourly o ASOF LEFT JOIN v_half h ON h.ride_name = o.ride_name AND o.timestamp > h.timestamp",
)
def joi13_strict(t):
    h = t.half.withColumnRenamed(W, "last_known")
    return enrich.as_of(t.hourly.select(K, T), h, K, T, {"last_known": "last_known"}, strict=True).withColumn("last_known", R("last_known"))


@query(
    "joi14_match_names",
    """WITH r AS (SELECT lower(p_name) AS k, min(p_partkey) AS id FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
    SELECT p.p_partkey, lower(p.p_name) AS match_key, r.id FROM part p LEFT JOIN r ON r.k = lower(p.p_name)""",
)
def joi14(t):
    left = t.part.select("p_partkey", F.concat(F.lit("The "), F.initcap("p_name"), F.lit("!  powered by Bolt")).alias("shown"))
    right = t.part.where(F.col("p_partkey") % 3 == 0).select("p_name", F.col("p_partkey").alias("id"))
    return enrich.match_names(left, right, "shown", "p_name", text.display_key, "id").select("p_partkey", "match_key", "id")


# sets ------------------------------------------------------------------------
@query("set1_union_columns", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def set1(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return sets.union_all(a, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("set2_except_dates", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus <> 'P'")
def set2(t):
    a = t.lineitem.select(F.to_date("l_shipdate").alias("date")).distinct()
    return a.join(t.orders.where("o_orderstatus <> 'P'").select(F.to_date("o_orderdate").alias("date")), "date", "left_anti")


@query("set3_distinct_keys", "SELECT DISTINCT o_orderpriority AS ride_name, CAST(year(o_orderdate) AS INT) AS year FROM orders")
def set3(t):
    return t.orders.select(F.col("o_orderpriority").alias(K), F.year("o_orderdate").alias("year")).distinct()


@query("set4_intersect_keys", "SELECT l_suppkey AS id FROM lineitem WHERE year(l_shipdate) = 1995 INTERSECT SELECT l_suppkey FROM lineitem WHERE year(l_shipdate) = 2001")
def set4(t):
    y = lambda n: t.lineitem.where(F.year("l_shipdate") == n).select(F.col("l_suppkey").alias("id"))
    return y(1995).intersect(y(2001))


@query(
    "set5_merge_history",
    """WITH h AS (SELECT *, 'history' AS source FROM v_half WHERE day(timestamp) <= 20), p AS (SELECT ride_name, timestamp, wait_time + 1 AS wait_time, 'prediction' AS source FROM v_hourly WHERE day(timestamp) >= 15)
    SELECT ride_name, timestamp, round(wait_time, 8) AS wait_time, source FROM h UNION ALL SELECT ride_name, timestamp, round(wait_time, 8), source FROM p WHERE (ride_name, timestamp) NOT IN (SELECT (ride_name, timestamp) FROM h)""",
)
def set5(t):
    h = t.half.where(F.dayofmonth(T) <= 20)
    p = t.hourly.where(F.dayofmonth(T) >= 15).withColumn(W, F.col(W) + 1)
    return sets.merge_history(h, p, [K, T]).withColumn(W, R(W))


# ranking -----------------------------------------------------------------------
@query("top1_order", "SELECT ride_name, timestamp, wait_time FROM v_obs ORDER BY 1, 2")
def top1(t):
    return t.obs.orderBy(K, T)


@query("top2_largest", "SELECT ride_name, timestamp, wait_time FROM v_obs ORDER BY wait_time DESC, ride_name, timestamp LIMIT 25")
def top2(t):
    return sets.top_n(t.obs, W, 25, [K, T])


@query("top2_smallest", "SELECT ride_name, timestamp, wait_time FROM v_obs ORDER BY wait_time, ride_name, timestamp LIMIT 25")
def top2_small(t):
    return sets.top_n(t.obs, W, 25, [K, T], largest=False)


@query(
    "top3_featured_picks",
    """SELECT p_partkey, p_type, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS INT) AS pick FROM part WHERE p_type IN ('SMALL', 'LARGE')
    QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) <= CASE p_type WHEN 'SMALL' THEN 3 ELSE 2 END""",
)
def top3(t):
    return sets.picks_per_group(t.part, "p_type", {"SMALL": 3, "LARGE": 2}, ["p_partkey"]).select("p_partkey", "p_type", "pick")


@query("top4_next_hours", "WITH h AS (SELECT date_trunc('hour', timestamp) AS timestamp, avg(temperature) AS temperature FROM v_weather GROUP BY 1) SELECT timestamp, round(temperature, 8) AS temperature FROM h WHERE timestamp > '2024-01-12 10:20:00' ORDER BY timestamp LIMIT 6")
def top4(t):
    h = grid.resample_agg(t.weather, [], T, 60, ["temperature"], [])
    return sets.next_rows(h, T, F.lit("2024-01-12 10:20:00").cast("timestamp_ntz"), 6).withColumn("temperature", R("temperature"))


@query(
    "top5_preview",
    """WITH x AS (SELECT split, ride_name, timestamp, CAST(row_number() OVER (PARTITION BY split ORDER BY timestamp, ride_name) AS INT) AS a, CAST(row_number() OVER (PARTITION BY split ORDER BY timestamp DESC, ride_name DESC) AS INT) AS b FROM v_hsplit)
    SELECT split, ride_name, timestamp, a AS rank, 'head' AS part FROM x WHERE a <= 5 UNION ALL SELECT split, ride_name, timestamp, b, 'tail' FROM x WHERE b <= 5""",
)
def top5(t):
    return sets.preview(t.hourly_split.select("split", K, T), "split", [T, K], 5)
