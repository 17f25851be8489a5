"""Data-quality statistics and filters."""
from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.functions.arrays import one_hot
from slotwise.functions.calendar import cyclic_features, part_of_day, season
from slotwise.operators import enrich, grid, quality
from slotwise.plans.registry import define_view, query

R = lambda c, n=8: F.round(c, n)
K, T, W, C = "ride_name", "timestamp", "wait_time", "closed"

define_view(
    "v_stats",
    """SELECT ride_name, date, count(wait_time) AS total_entries, count(*) FILTER (wait_time IS NULL) AS missing_entries,
      round(count(*) FILTER (wait_time IS NULL) / nullif(count(wait_time), 0) * 100, 2) AS missing_pct,
      coalesce(round(count(*) FILTER (wait_time IS NULL) / nullif(count(wait_time), 0) * 100, 2) > 400, true) AS "drop"
      FROM v_grid5 WHERE NOT closed GROUP BY 1, 2""",
)


@query("dq1_missing_day_stats", 'SELECT * FROM v_stats')
def dq1(t):
    return quality.missing_day_stats(t.grid5, K, T, W, C, max_pct=400)


@query("dq2_drop_summary", 'SELECT ride_name, count(*) FILTER ("drop") AS days_to_drop, count(*) AS total_days, round(count(*) FILTER ("drop") * 100.0 / count(*), 2) AS drop_pct FROM v_stats GROUP BY 1')
def dq2(t):
    return quality.drop_summary(quality.missing_day_stats(t.grid5, K, T, W, C, max_pct=400), K)


@query("dq2_drop_total", 'SELECT count(*) FILTER ("drop") AS days_to_drop, count(*) AS total_days, round(count(*) FILTER ("drop") * 100.0 / count(*), 2) AS drop_pct FROM v_stats')
def dq2_total(t):
    return quality.drop_summary(quality.missing_day_stats(t.grid5, K, T, W, C, max_pct=400), None)


@query("dq3_drop_bad_days", 'SELECT ride_name, timestamp, round(wait_time, 8) AS wait_time FROM v_grid5 WHERE (ride_name, date) NOT IN (SELECT (ride_name, date) FROM v_stats WHERE "drop")')
def dq3(t):
    d = quality.drop_bad_days(t.grid5, K, T, W, C, max_pct=400)
    return d.select(K, T, R(W).alias(W))


DEAD = """WITH b AS (SELECT *, CAST(timestamp AS DATE) AS d, wait_time - 30 AS w, hour(timestamp) < 6 OR day(timestamp) = 9 OR (day(timestamp) = 11 AND ride_name = 'view') AS c FROM v_hourly),
    o AS (SELECT * FROM b WHERE ({k}d) NOT IN (SELECT ({k}d) FROM b GROUP BY {k}d HAVING avg(CAST(c AS INT)) = 1)),
    z AS (SELECT {k}d FROM o GROUP BY {k}d HAVING avg(w) < 1)
    SELECT ride_name, timestamp FROM o WHERE ({k}d) NOT IN (SELECT ({k}d) FROM z)"""


def _dead_input(t):
    c = (F.hour(T) < 6) | (F.dayofmonth(T) == 9) | ((F.dayofmonth(T) == 11) & (F.col(K) == "view"))
    return t.hourly.withColumn(C, c).withColumn(W, F.col(W) - 30)


@query("dq4_drop_dead_days", DEAD.format(k="ride_name, "))
def dq4(t):
    return quality.drop_dead_days(_dead_input(t), T, W, C, [K]).select(K, T)


@query("dq4_drop_dead_days_pooled", DEAD.format(k=""))
def dq4_pooled(t):
    return quality.drop_dead_days(_dead_input(t), T, W, C).select(K, T)


HOURS = """WITH b AS (SELECT *, CAST(timestamp AS DATE) AS d, wait_time - 40 AS w FROM v_hourly),
    h AS (SELECT {k}d, greatest(9, least(11, min(hour(timestamp)))) AS o, greatest(17, least(21, max(hour(timestamp)))) AS z FROM b WHERE w > 0 GROUP BY {k}d)
    SELECT b.ride_name, b.timestamp FROM b JOIN h USING ({u}d) WHERE hour(timestamp) >= o AND hour(timestamp) < z"""


@query("dq5_operating_hours", HOURS.format(k="ride_name, ", u="ride_name, "))
def dq5(t):
    return quality.filter_operating_hours(t.hourly.withColumn(W, F.col(W) - 40), T, W, [K]).select(K, T)


@query("dq5_operating_hours_pooled", HOURS.format(k="", u=""))
def dq5_pooled(t):
    return quality.filter_operating_hours(t.hourly.withColumn(W, F.col(W) - 40), T, W).select(K, T)


@query(
    "dq6_replace_columns",
    """SELECT h.ride_name, h.timestamp, round(w.temperature, 8) AS temperature, round(coalesce(w.rain, 9.0), 8) AS rain FROM v_hourly h LEFT JOIN v_weather w USING (timestamp)""",
)
def dq6(t):
    d = t.hourly.select(K, T, F.lit(7.0).alias("temperature"), F.lit(9.0).alias("rain"))
    d = quality.replace_columns(d, t.weather, [T], ["temperature"])
    d = quality.replace_columns(d, t.weather, [T], ["rain"], fallback=True)
    return d.select(K, T, R("temperature").alias("temperature"), R("rain").alias("rain"))


@query(
    "dq7_add_off_hours",
    """WITH b AS (SELECT h.ride_name, h.timestamp, h.wait_time, hour(h.timestamp)::INT AS st, w.temperature, h.wait_time < 10 AS closed FROM v_half h LEFT JOIN v_weather w USING (timestamp) WHERE hour(h.timestamp) BETWEEN 9 AND 20),
    f AS (SELECT ride_name, CAST(timestamp AS DATE) d, arg_min(st, timestamp) AS st FROM b GROUP BY 1, 2),
    o AS (SELECT f.ride_name, w.timestamp, 0.0::DOUBLE AS wait_time, f.st, w.temperature, true AS closed FROM f JOIN v_weather w ON CAST(w.timestamp AS DATE) = f.d WHERE hour(w.timestamp) < 9 OR hour(w.timestamp) >= 21)
    SELECT ride_name, timestamp, round(wait_time, 8) AS wait_time, st, round(temperature, 8) AS temperature, closed, date_trunc('hour', timestamp) AS time_bucket FROM (SELECT * FROM b UNION ALL SELECT * FROM o)""",
)
def dq7(t):
    b = t.half.where(F.hour(T).between(9, 20)).join(t.weather.select(T, "temperature"), T, "left")
    b = b.withColumn("st", F.hour(T)).withColumn(C, F.col(W) < 10)
    d = quality.add_off_hours(b, t.weather, K, T, W, ["st"], ["temperature"])
    return d.withColumn(W, R(W)).withColumn("temperature", R("temperature"))


@query("dq8_dedupe_first", "SELECT ride_name, date_trunc('hour', timestamp) AS slot, arg_min(wait_time, timestamp) AS wait_time FROM v_obs GROUP BY 1, 2")
def dq8(t):
    d = t.obs.withColumn("slot", F.date_trunc("hour", T).cast("timestamp_ntz"))
    return quality.dedupe(d, [K, "slot"], T, "first").select(K, "slot", W)


@query("dq8_dedupe_last", "SELECT ride_name, date_trunc('hour', timestamp) AS slot, arg_max(wait_time, timestamp) AS wait_time FROM v_obs GROUP BY 1, 2")
def dq8_last(t):
    d = t.obs.withColumn("slot", F.date_trunc("hour", T).cast("timestamp_ntz"))
    return quality.dedupe(d, [K, "slot"], T, "last").select(K, "slot", W)


@query("dq9_round_to_5", "SELECT event_id, round_even(value / 5, 0) * 5 AS rounded FROM events")
def dq9(t):
    return t.events.select("event_id", quality.round_to("value", 5).alias("rounded"))


@query(
    "dq10_off_grid_share",
    """SELECT count(*) AS n, count(*) FILTER (l_quantity % 5 > 0) AS off_before, count(*) FILTER ((round_even(l_quantity/5, 0)*5) % 5 > 0) AS off_after,
    round(count(*) FILTER (l_quantity % 5 > 0) * 100.0 / count(*), 6) AS pct_before, round(count(*) FILTER ((round_even(l_quantity/5, 0)*5) % 5 > 0) * 100.0 / count(*), 6) AS pct_after FROM lineitem""",
)
def dq10(t):
    d = quality.off_grid_share(t.lineitem, "l_quantity", 5)
    return d.withColumn("pct_before", R("pct_before", 6)).withColumn("pct_after", R("pct_after", 6))


@query(
    "dq11_null_runs",
    """WITH a AS (SELECT ride_name, timestamp, wait_time, row_number() OVER (PARTITION BY ride_name ORDER BY timestamp) AS i FROM v_grid5),
    n AS (SELECT ride_name, i - row_number() OVER (PARTITION BY ride_name ORDER BY timestamp) AS run FROM a WHERE wait_time IS NULL),
    r AS (SELECT ride_name, run, count(*) AS run_length FROM n GROUP BY 1, 2) SELECT ride_name, run_length, count(*) AS n_runs FROM r GROUP BY 1, 2""",
)
def dq11(t):
    return quality.null_runs(t.grid5, K, T, W)


@query(
    "dq12_null_profile",
    """WITH d AS (SELECT g.ride_name, g.wait_time, w.temperature, w.rain FROM v_sparse g LEFT JOIN v_weather w USING (timestamp)),
    g AS (SELECT ride_name, count(*) AS n_rows, count(*) - count(wait_time) AS a, count(*) - count(temperature) AS b, count(*) - count(rain) AS c FROM d GROUP BY 1)
    SELECT ride_name, n_rows, "column", n_null, round(n_null * 100.0 / n_rows, 2) AS pct_null FROM (
      SELECT ride_name, n_rows, 'wait_time' AS "column", a AS n_null FROM g UNION ALL SELECT ride_name, n_rows, 'temperature', b FROM g UNION ALL SELECT ride_name, n_rows, 'rain', c FROM g)""",
)
def dq12(t):
    d = enrich.add_weather(t.sparse_grid, t.weather, T, ["temperature", "rain"]).select(K, W, "temperature", "rain")
    return quality.null_profile(d, K)


# the whole feature matrix in SQL, and every check on it
PARTS = {"morning": "hour(timestamp) BETWEEN 6 AND 11", "afternoon": "hour(timestamp) BETWEEN 12 AND 17", "evening": "hour(timestamp) BETWEEN 18 AND 21", "night": "hour(timestamp) >= 22 OR hour(timestamp) < 6"}
MONTHS = {"winter": "12, 1, 2", "spring": "3, 4, 5", "summer": "6, 7, 8", "fall": "9, 10, 11"}
UNITS = {"month": ("month(timestamp)", 12), "hour": ("hour(timestamp)", 24), "weekday": ("isodow(timestamp) - 1", 7), "minute": ("minute(timestamp)", 60), "doy": ("dayofyear(timestamp)", 365.25)}
CELLS = {"ride_name": "ride_name", T: T, "date": "date", W: W, C: "CAST(closed AS INT)"}
CELLS |= {f"{n}_{f}": f"{f}(2*pi()*({e})/{p})" for n, (e, p) in UNITS.items() for f in ("sin", "cos")}
CELLS |= {"weekday": "isodow(timestamp) - 1", "is_weekend": "CAST(isodow(timestamp) >= 6 AS INT)"}
CELLS |= {f"part_of_day_{n}": f"CAST({e} AS INT)" for n, e in PARTS.items()} | {f"season_{n}": f"CAST(month(timestamp) IN ({m}) AS INT)" for n, m in MONTHS.items()}
HOT = {p: [c for c in CELLS if c.startswith(p)] for p in ("part_of_day_", "season_")}


def sanity_sql() -> str:
    checks = [("nulls", c, f"count(*) - count({c})", "= 0") for c in CELLS]
    checks += [("cyclic_range", c, f"max(abs({c}))", "<= 1.1") for c in CELLS if c.endswith(("_sin", "_cos"))]
    checks += [("zero_one", c, f"count(*) FILTER ({c} NOT IN (0, 1))", "= 0") for c in [*HOT["part_of_day_"], *HOT["season_"], C, "is_weekend"]]
    checks += [("weekend", "is_weekend", "count(*) FILTER ((weekday >= 5) <> (is_weekend = 1))", "= 0")]
    checks += [("one_hot_sum", p, f"count(*) FILTER ({' + '.join(cols)} <> 1)", "= 0") for p, cols in HOT.items()]
    for u in ("month", "hour", "weekday", "minute"):
        both = f"{u}_sin, {u}_cos"
        checks += [("sin_cos_corr", u, f"CASE WHEN stddev_pop({u}_sin) > 0 AND stddev_pop({u}_cos) > 0 THEN corr({both}) END", "BETWEEN -0.1 AND 0.1")]
        checks += [("unit_circle", u, f"max(abs(sqrt({u}_sin*{u}_sin + {u}_cos*{u}_cos) - 1))", "<= 0.1")]
    checks += [("wait_outliers", W, f"count(*) FILTER (abs({W} - (SELECT avg({W}) FROM m)) > 5 * (SELECT stddev_samp({W}) FROM m))", "= 0")]
    checks += [("wait_negative", W, f"count(*) FILTER ({W} < 0)", "= 0"), ("closed_zero", W, f"count(*) FILTER ({C} = 1 AND {W} > 0)", "= 0")]
    one = ", ".join(f"CAST({e} AS DOUBLE) AS c{i}" for i, (_, _, e, _) in enumerate(checks))
    rows = " UNION ALL ".join(f"SELECT '{n}' AS \"check\", '{c}' AS \"column\", coalesce(c{i} {ok}, {str(n == 'sin_cos_corr').lower()}) AS ok, round(c{i}, 6) AS detail FROM one" for i, (n, c, _, ok) in enumerate(checks))
    return f"WITH m AS (SELECT {', '.join(f'{e} AS {c}' for c, e in CELLS.items())} FROM v_sparse), one AS (SELECT {one} FROM m) {rows}"


@query("dq13_sanity_report", sanity_sql())
def dq13(t):
    d = t.sparse_grid.withColumns(cyclic_features(T)).withColumn("weekday", F.weekday(T))
    d = d.withColumn("is_weekend", (F.col("weekday") >= 5).cast("int")).withColumn(C, F.col(C).cast("int"))
    d = d.withColumns(one_hot(part_of_day(T), ["afternoon", "evening", "morning", "night"], "part_of_day_"))
    d = d.withColumns(one_hot(season(T), ["fall", "spring", "summer", "winter"], "season_"))
    return quality.sanity_report(d).withColumn("detail", R("detail", 6))


@query(
    "dq14_coverage_check",
    "SELECT ride_name, CAST(isodow(timestamp) - 1 AS INT) AS weekday, CAST(hour(timestamp) AS INT) AS hour, count(*) AS n, count(DISTINCT CAST(timestamp AS DATE)) AS n_days FROM v_obs GROUP BY 1, 2, 3",
)
def dq14(t):
    return quality.coverage_check(t.obs, K, T)
