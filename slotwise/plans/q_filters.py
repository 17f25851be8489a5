"""Filters and projections."""
from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.operators import filters as fl
from slotwise.operators import grid
from slotwise.plans.registry import query

R = lambda c, n=8: F.round(c, n)
COLS = "SELECT ride_name, timestamp, wait_time FROM v_obs"


@query("fil1_time_of_day", f"{COLS} WHERE hour(timestamp)*3600 + minute(timestamp)*60 + second(timestamp) BETWEEN 9*3600 AND 21*3600")
def fil1(t):
    return fl.filter_time_of_day(t.obs, "timestamp", "09:00", "21:00")


@query("fil2_drop_dates", f"{COLS} WHERE CAST(timestamp AS DATE) NOT IN (DATE '2024-01-05', DATE '2024-01-17')")
def fil2(t):
    return fl.drop_dates(t.obs, "timestamp", ["2024-01-05", "2024-01-17"])


@query("fil2_drop_dates_table", f"{COLS} WHERE CAST(timestamp AS DATE) NOT IN (SELECT date FROM v_holidays)")
def fil2_table(t):
    return fl.drop_dates(t.obs, "timestamp", t.holidays)


@query("fil3_drop_months", "SELECT o_orderkey, o_orderdate FROM orders WHERE month(o_orderdate) NOT IN (1, 2, 12)")
def fil3(t):
    return fl.drop_months(t.orders, "o_orderdate", [1, 2, 12]).select("o_orderkey", "o_orderdate")


@query("fil4_drop_keys", f"{COLS} WHERE NOT (ride_name LIKE '%err%' OR ride_name = 'view')")
def fil4(t):
    return fl.drop_keys(t.obs, "ride_name", contains=["err"], equals=["view"])


@query("fil5_meaningful", "SELECT ride_name, timestamp, round(wait_time, 8) AS wait_time FROM v_sparse WHERE wait_time > 1 OR (wait_time = 0 AND NOT closed)")
def fil5(t):
    return t.sparse_grid.where(fl.meaningful("wait_time", "closed")).select("ride_name", "timestamp", R("wait_time").alias("wait_time"))


@query("fil6_cap_keep_null", "SELECT ride_name, timestamp, round(wait_time, 8) AS wait_time FROM v_grid5 WHERE wait_time IS NULL OR wait_time <= 100")
def fil6(t):
    return fl.cap_filter(t.grid5, "wait_time", 100).select("ride_name", "timestamp", R("wait_time").alias("wait_time"))


@query("fil7_dropna", "SELECT ride_name, timestamp, round(wait_time, 8) AS wait_time FROM v_grid5 WHERE wait_time IS NOT NULL")
def fil7(t):
    return t.grid5.dropna(subset=["wait_time"]).select("ride_name", "timestamp", R("wait_time").alias("wait_time"))


@query("fil8_exclude_period", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < '1997-12-01' OR o_orderdate > '1998-06-30'")
def fil8(t):
    return fl.exclude_period(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "1997-12-01", "1998-06-30")


@query("fil9_open_only", "SELECT ride_name, timestamp FROM v_sparse WHERE NOT closed")
def fil9(t):
    return fl.open_only(t.sparse_grid).select("ride_name", "timestamp")


@query("fil10_on_bucket_edge", "SELECT ride_name, timestamp, round(wait_time, 8) AS wait_time FROM v_slots WHERE minute(timestamp) % 30 = 0")
def fil10(t):
    return fl.on_bucket_edge(t.slots, "timestamp", 30).withColumn("wait_time", R("wait_time"))


@query("fil11_search_catalogue", "SELECT p_partkey, p_name, p_type FROM part WHERE (lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%') AND p_type = 'SMALL'")
def fil11(t):
    return fl.search_catalogue(t.part, " Ring ", ["p_name", "p_brand"], "SMALL", "p_type").select("p_partkey", "p_name", "p_type")


@query("fil12_high_waits", f"{COLS} WHERE wait_time BETWEEN 200 AND 300")
def fil12(t):
    return t.obs.where(F.col("wait_time").between(200, 300))


@query(
    "fil13_wait_range",
    """SELECT ride_name, CASE WHEN wait_time>=60 THEN '60+' WHEN wait_time>=30 THEN '30-60' WHEN wait_time>=10 THEN '10-30' ELSE '0-10' END AS wait_range, count(*) AS n
    FROM v_obs GROUP BY 1,2""",
)
def fil13(t):
    return t.obs.groupBy("ride_name", fl.wait_range("wait_time").alias("wait_range")).agg(F.count(F.lit(1)).alias("n"))


@query("prj1_select_features", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount FROM lineitem")
def prj1(t):
    return fl.select_features(t.lineitem, numeric=True, exclude=["l_extendedprice", "l_tax"], keep=["l_orderkey"])


@query("prj1_select_by_prefix", "SELECT o_orderkey, o_orderdate, o_orderpriority, o_orderstatus FROM orders")
def prj1_prefix(t):
    return fl.select_features(t.orders, prefixes=["o_order"], keep=["o_orderkey"])


@query(
    "prj2_conform_features",
    """SELECT event_id, CAST(value >= 5 AS DOUBLE) AS closed, CAST(isodow(ts) - 1 AS DOUBLE) AS day_of_week, value AS temperature, CAST(user_id AS DOUBLE) AS weekday FROM events""",
)
def prj2(t):
    e = t.events.select(
        "event_id", F.col("user_id").alias("weekday"), (F.col("value") >= 5).alias("closed"), F.date_format("ts", "EEEE").alias("day_of_week"),
        F.col("value").cast("string").alias("temperature"), "props",
    )
    return fl.conform_features(e, ["closed", "day_of_week", "temperature", "weekday", "props"], size=4, keep=["event_id"])


@query("prj3_rename_columns", "SELECT timestamp, round(temperature, 8) AS \"temperature_C\", round(rain, 8) AS rain_mm FROM v_weather")
def prj3(t):
    d = t.weather.withColumnsRenamed({"temperature": "temperature_C", "rain": "rain_mm"}).drop("wind")
    return d.withColumns({c: R(c) for c in ("temperature_C", "rain_mm")})
