"""Scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.functions import arrays, calendar as cal, text, weather as wx
from slotwise.operators import enrich
from slotwise.plans.registry import query

R = lambda c, n=8: F.round(c, n)
K, T, W = "ride_name", "timestamp", "wait_time"
NAME_SQL = "concat('The ', p_name, ' – «', p_brand, '»  Café!', CASE WHEN p_partkey % 2 = 0 THEN ' Powered by X' ELSE '' END)"


def shown_name():
    """Names with dashes, accents, quotes and a sponsor, as displays carry them."""
    return F.concat(
        F.lit("The "), F.col("p_name"), F.lit(" – «"), F.col("p_brand"), F.lit("»  Café!"),
        F.when(F.col("p_partkey") % 2 == 0, " Powered by X").otherwise(""),
    )


@query("str1_training_key", f"SELECT p_partkey, regexp_replace(lower({NAME_SQL}), '[^a-z0-9\\s]', '', 'g') AS k FROM part")
def str1(t):
    return t.part.select("p_partkey", text.training_key(shown_name()).alias("k"))


@query(
    "str2_service_key",
    f"SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'unknown_ride' ELSE regexp_replace(regexp_replace(regexp_replace(lower({NAME_SQL}), '[^\\pL\\pN_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') END AS k FROM part",
)
def str2(t):
    name = F.when(F.col("p_partkey") % 10 == 0, "").when(F.col("p_partkey") % 5 != 0, shown_name())
    return t.part.select("p_partkey", text.service_key(name).alias("k"))


@query(
    "str3_display_key",
    "SELECT p_partkey, concat(lower(p_name), '-«', lower(p_brand), '» café') AS k FROM part",
)
def str3(t):
    return t.part.select("p_partkey", text.display_key(shown_name()).alias("k"))


@query("str4_aliases", "SELECT event_id, CASE event_type WHEN 'view' THEN 'click' WHEN 'error' THEN 'fault' ELSE event_type END AS k FROM events")
def str4(t):
    return t.events.select("event_id", text.apply_aliases("event_type", {"view": "click", "error": "fault"}).alias("k"))


@query(
    "str5_stamp_key",
    "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS k, strftime(ts, '%Y%m%d%H%M%S%f') AS k6, CASE WHEN event_id % 7 <> 0 THEN date_trunc('second', ts) END AS back FROM events",
)
def str5(t):
    k6 = text.stamp_key("ts", micros=True)
    back = text.parse_stamp_key(F.when(F.col("event_id") % 7 == 0, "not a time").otherwise(k6))
    return t.events.select("event_id", text.stamp_key("ts").alias("k"), k6.alias("k6"), back.alias("back"))


@query("str6_title_text", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ') AS title FROM part")
def str6(t):
    return t.part.select("p_partkey", text.title_text(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("title"))


ORD = "SELECT o_orderkey, "
H = "CAST(hour(ts) AS INT)"


@query(
    "dat1_date_parts",
    f"""{ORD} CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day, CAST(isodow(ts)-1 AS INT) AS weekday, {H} AS hour, CAST(minute(ts) AS INT) AS minute,
    CAST(dayofyear(ts) AS INT) AS day_of_year, CAST(weekofyear(ts) AS INT) AS week, CAST(quarter(ts) AS INT) AS quarter FROM (SELECT o_orderkey, o_orderdate + to_minutes(o_orderkey % 1440) AS ts FROM orders)""",
)
def dat1(t):
    ts = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    return t.orders.withColumn("ts", ts).select("o_orderkey", *[e.alias(n) for n, e in cal.date_parts("ts").items()])


@query(
    "dat2_day_bands",
    f"""SELECT event_id, CASE WHEN h BETWEEN 6 AND 11 THEN 'morning' WHEN h BETWEEN 12 AND 16 THEN 'afternoon' WHEN h BETWEEN 17 AND 19 THEN 'evening' ELSE 'night' END AS part_of_day,
    CASE WHEN h BETWEEN 6 AND 8 THEN 'early_morning' WHEN h BETWEEN 9 AND 11 THEN 'late_morning' WHEN h BETWEEN 12 AND 14 THEN 'early_afternoon' WHEN h BETWEEN 15 AND 17 THEN 'late_afternoon' WHEN h BETWEEN 18 AND 20 THEN 'early_evening' ELSE 'night' END AS six_bands,
    CASE WHEN h BETWEEN 12 AND 16 THEN 'afternoon' WHEN h BETWEEN 17 AND 19 THEN 'evening' WHEN h >= 20 THEN 'night' ELSE 'morning' END AS time_of_day,
    CASE WHEN h >= 6 THEN concat(lpad(CAST(h AS VARCHAR), 2, '0'), ':00-', lpad(CAST(h + 1 AS VARCHAR), 2, '0'), ':00') END AS hour_bin FROM (SELECT event_id, hour(ts) AS h FROM events)""",
)
def dat2(t):
    return t.events.select(
        "event_id", cal.part_of_day("ts").alias("part_of_day"), cal.six_bands("ts").alias("six_bands"),
        cal.time_of_day("ts").alias("time_of_day"), cal.hour_bin("ts").alias("hour_bin"),
    )


@query(
    "dat3_season",
    f"""{ORD} CASE WHEN m IN (12,1,2) THEN 'winter' WHEN m <= 5 THEN 'spring' WHEN m <= 8 THEN 'summer' ELSE 'fall' END AS season,
    CAST(m IN (4,5,6) AS INT) AS is_spring, CAST(m IN (7,8,9) AS INT) AS is_summer, CAST(m IN (10,11,12) AS INT) AS is_fall FROM (SELECT o_orderkey, month(o_orderdate) AS m FROM orders)""",
)
def dat3(t):
    return t.orders.select("o_orderkey", cal.season("o_orderdate").alias("season"), *[e.alias(n) for n, e in cal.shifted_season_flags("o_orderdate").items()])


@query(
    "dat4_cyclic",
    """SELECT event_id, round(sin(2*pi()*month(ts)/12),8) AS month_sin, round(cos(2*pi()*month(ts)/12),8) AS month_cos, round(sin(2*pi()*hour(ts)/24),8) AS hour_sin, round(cos(2*pi()*hour(ts)/24),8) AS hour_cos,
    round(sin(2*pi()*(isodow(ts)-1)/7),8) AS weekday_sin, round(cos(2*pi()*(isodow(ts)-1)/7),8) AS weekday_cos, round(sin(2*pi()*minute(ts)/60),8) AS minute_sin, round(cos(2*pi()*minute(ts)/60),8) AS minute_cos,
    round(sin(2*pi()*dayofyear(ts)/365.25),8) AS doy_sin, round(cos(2*pi()*dayofyear(ts)/365.25),8) AS doy_cos FROM events""",
)
def dat4(t):
    return t.events.select("event_id", *[R(e).alias(n) for n, e in cal.cyclic_features("ts").items()])


@query("dat5_inverse_cyclic", f"{ORD} CAST(month(o_orderdate) AS INT) AS month, CAST(isodow(o_orderdate)-1 AS INT) AS weekday FROM orders")
def dat5(t):
    d = t.orders.select("o_orderkey", *[e.alias(n) for n, e in cal.cyclic_features("o_orderdate").items()])
    return d.select(
        "o_orderkey", cal.inverse_cyclic("month_sin", "month_cos", 12, first=1).alias("month"),
        cal.inverse_cyclic("weekday_sin", "weekday_cos", 7).alias("weekday"),
    )


@query(
    "dat6_floor_ceil",
    """SELECT event_id, date_trunc('hour', ts) AS f60, time_bucket(INTERVAL '30 minutes', ts) AS f30,
    CASE WHEN time_bucket(INTERVAL '30 minutes', ts) = ts THEN ts ELSE time_bucket(INTERVAL '30 minutes', ts) + INTERVAL 30 MINUTE END AS c30 FROM events""",
)
def dat6(t):
    return t.events.select("event_id", cal.floor_to("ts", 60).alias("f60"), cal.floor_to("ts", 30).alias("f30"), cal.ceil_to("ts", 30).alias("c30"))


@query("dat7_time_keys", "SELECT event_id, CAST(hour(ts)*60+minute(ts) AS INT) AS time_key, CAST((isodow(ts)-1)*1440+hour(ts)*60+minute(ts) AS INT) AS day_time_key FROM events")
def dat7(t):
    return t.events.select("event_id", cal.time_key("ts").alias("time_key"), cal.day_time_key("ts").alias("day_time_key"))


@query(
    "dat8_same_weekday_last_year",
    f"{ORD} b + to_days(CAST(isodow(ts) - isodow(b) AS INT)) AS target FROM (SELECT o_orderkey, o_orderdate + INTERVAL 10 HOUR AS ts, o_orderdate + INTERVAL 10 HOUR - INTERVAL 1 YEAR AS b FROM orders)",
)
def dat8(t):
    return t.orders.select("o_orderkey", cal.same_weekday_last_year(F.col("o_orderdate") + F.expr("INTERVAL 10 HOURS")).alias("target"))


@query(
    "dat9_day_flags",
    """SELECT event_id, CAST(wd >= 5 AS INT) AS is_weekend, CAST(wd = 4 AS INT) AS is_friday, CAST(wd = 6 AS INT) AS is_sunday, CAST(h BETWEEN 11 AND 16 AS INT) AS is_peak_hour, CAST(h IN (9,10) AS INT) AS is_opening_hour,
    CAST(h IN (19,20,21) AS INT) AS is_closing_hour, CAST(m IN (6,7,8) AS INT) AS is_summer_vacation, CAST(h BETWEEN 9 AND 11 AS INT) AS morning_rush, CAST(h BETWEEN 12 AND 14 AS INT) AS lunch_time,
    CAST(h BETWEEN 15 AND 17 AS INT) AS afternoon_rush, CAST(h >= 18 AS INT) AS evening FROM (SELECT event_id, isodow(ts)-1 AS wd, hour(ts) AS h, month(ts) AS m FROM events)""",
)
def dat9(t):
    return t.events.select("event_id", *[e.alias(n) for n, e in cal.day_flags("ts").items()])


@query(
    "dat10_zones",
    """SELECT o_orderkey, l AS local_ts, u AS utc_ts, hour(l)*60+minute(l) BETWEEN 540 AND 1050 AS open_local FROM (
      SELECT o_orderkey, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Zurich' AS l, (noon AT TIME ZONE 'Europe/Zurich') AT TIME ZONE 'UTC' AS u
      FROM (SELECT o_orderkey, o_orderdate + to_minutes(o_orderkey % 1440) AS ts, o_orderdate + to_minutes(720 + o_orderkey % 600) AS noon FROM orders))""",
)
def dat10(t):
    after = lambda m: F.col("o_orderdate") + F.make_dt_interval(mins=m.cast("int"))
    d = t.orders.select("o_orderkey", after(F.col("o_orderkey") % 1440).alias("ts"), after(F.col("o_orderkey") % 600 + 720).alias("noon"))
    return d.select(
        "o_orderkey", cal.to_local("ts", "Europe/Zurich").alias("local_ts"), cal.to_utc("noon", "Europe/Zurich").alias("utc_ts"),
        cal.within_local_hours("ts", "Europe/Zurich").alias("open_local"),
    )


@query(
    "dat11_era_flags",
    f"{ORD} CAST(o_orderdate BETWEEN '1997-05-20' AND '1997-11-01' AS INT) AS first_era, CAST(o_orderdate BETWEEN '1998-05-21' AND '1998-08-31' AS INT) AS second_era FROM orders",
)
def dat11(t):
    eras = {"first_era": ("1997-05-20", "1997-11-01"), "second_era": ("1998-05-21", "1998-08-31")}
    return t.orders.select("o_orderkey", *[e.alias(n) for n, e in cal.era_flags("o_orderdate", eras).items()])


@query(
    "dat12_holiday_combinations",
    """SELECT event_id, CAST(h AS INT) AS is_any_holiday, CAST(h AND isodow(ts) >= 6 AS INT) AS holiday_weekend FROM (SELECT event_id, ts, CAST(ts AS DATE) IN (SELECT date FROM v_holidays) AS h FROM events)""",
)
def dat12(t):
    d = enrich.add_holiday_flags(t.events.select("event_id", "ts"), t.holidays, "ts")
    return d.select("event_id", *[e.alias(n) for n, e in enrich.holiday_combinations(list(enrich.COUNTRY_FLAGS.values()), cal.day_flags("ts")["is_weekend"]).items()])


@query(
    "dat13_age_text",
    """SELECT event_id, CASE WHEN m < 1 THEN 'Just updated' WHEN m = 1 THEN '1 minute ago' WHEN m < 60 THEN concat(CAST(m AS VARCHAR), ' minutes ago') WHEN m // 60 = 1 THEN '1 hour ago' ELSE concat(CAST(m // 60 AS VARCHAR), ' hours ago') END AS age
    FROM (SELECT event_id, (epoch_us(n) - epoch_us(ts)) // 60000000 AS m FROM (SELECT event_id, ts, coalesce(lead(ts, 20) OVER (ORDER BY event_id), ts) AS n FROM events))""",
)
def dat13(t):
    later = t.events.select((F.col("event_id") - 20).alias("event_id"), F.col("ts").alias("n"))
    d = t.events.select("event_id", "ts").join(later, "event_id", "left")
    return d.select("event_id", cal.age_text("ts", F.coalesce("n", "ts")).alias("age"))


@query(
    "mat1_weather_bins",
    """SELECT timestamp, CASE WHEN t<=0 THEN NULL WHEN t<=5 THEN 'very_cold' WHEN t<=10 THEN 'cold' WHEN t<=15 THEN 'cool' WHEN t<=20 THEN 'mild' WHEN t<=25 THEN 'warm' WHEN t<=30 THEN 'hot' WHEN t<=100 THEN 'very_hot' END AS temp_bin,
    CASE WHEN r<=0 THEN NULL WHEN r<=0.001 THEN 'none' WHEN r<=1 THEN 'light' WHEN r<=2.5 THEN 'moderate' WHEN r<=5 THEN 'heavy' WHEN r<=100 THEN 'extreme' END AS rain_intensity,
    CASE WHEN r>0 THEN 1 ELSE 0 END AS has_rain, CASE WHEN r>0 THEN 1 ELSE 0 END AS any_rain, CASE WHEN r>5 THEN 1 ELSE 0 END AS heavy_rain, round(t*t, 6) AS temp_squared,
    CASE WHEN t>25 THEN 1 ELSE 0 END AS high_temp, CASE WHEN t BETWEEN 15 AND 25 THEN 1 ELSE 0 END AS moderate_temp, CASE WHEN t<15 THEN 1 ELSE 0 END AS low_temp
    FROM (SELECT timestamp, temperature AS t, CASE WHEN minute(timestamp)=0 THEN rain ELSE 0 END AS r FROM v_weather)""",
)
def mat1(t):
    d = t.weather.withColumn("rain", F.when(F.minute(T) == 0, F.col("rain")).otherwise(0.0))
    f = {"temp_bin": wx.temp_bin("temperature"), "rain_intensity": wx.rain_intensity("rain"), **wx.weather_flags("temperature", "rain")}
    d = d.select(T, *[e.alias(n) for n, e in f.items()])
    return d.withColumn("temp_squared", R("temp_squared", 6))


@query(
    "mat2_interactions",
    """SELECT timestamp, round(temperature*w, 8) AS temp_weekend, round(rain*w, 8) AS rain_weekend, h*w AS weekend_hour, w*CAST(h BETWEEN 9 AND 11 AS INT) AS weekend_morning, w*CAST(h BETWEEN 15 AND 17 AS INT) AS weekend_afternoon
    FROM (SELECT *, CAST(isodow(timestamp)>=6 AS INT) AS w, CAST(hour(timestamp) AS INT) AS h FROM v_weather)""",
)
def mat2(t):
    f = cal.day_flags(T)
    i = wx.interactions("temperature", "rain", f["is_weekend"], F.hour(T), f["morning_rush"], f["afternoon_rush"])
    d = t.weather.select(T, *[e.alias(n) for n, e in i.items()])
    return d.withColumn("temp_weekend", R("temp_weekend")).withColumn("rain_weekend", R("rain_weekend"))


@query(
    "mat3_weather_code",
    """SELECT event_id, CASE WHEN c=0 THEN 'Clear' WHEN c<=3 THEN 'Partly Cloudy' WHEN c IN (45,48) THEN 'Foggy' WHEN c IN (51,53,55,56,57) THEN 'Drizzle' WHEN c IN (61,63,65,66,67) THEN 'Rain' WHEN c IN (71,73,75,77) THEN 'Snow'
    WHEN c IN (80,81,82) THEN 'Rain Showers' WHEN c=95 THEN 'Thunderstorm' ELSE 'Unknown' END AS condition FROM (SELECT event_id, event_id % 100 AS c FROM events)""",
)
def mat3(t):
    return t.events.select("event_id", wx.condition(F.col("event_id") % 100).alias("condition"))


@query("mat4_rain_indicator", "SELECT timestamp, CASE WHEN rain > 0.1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rain FROM v_weather")
def mat4(t):
    return t.weather.select(T, wx.rain_indicator("rain").alias("rain"))


@query("mat5_clip", "SELECT event_id, greatest(value - 50, 0) AS at_least_0, least(greatest(value, 10), 60) AS in_range FROM events")
def mat5(t):
    return t.events.select("event_id", wx.clip(F.col("value") - 50, lo=0).alias("at_least_0"), wx.clip("value", 10, 60).alias("in_range"))


@query("mat6_log1p", "SELECT event_id, round(ln(1 + value), 8) AS log_wait FROM events")
def mat6(t):
    return t.events.select("event_id", R(F.log1p("value")).alias("log_wait"))


@query(
    "mat7_severity",
    "SELECT event_id, CASE WHEN user_id % 4 <> 0 THEN CASE WHEN w <= 0 THEN 'none' WHEN w <= 15 THEN 'short' WHEN w <= 30 THEN 'medium' WHEN w <= 60 THEN 'long' ELSE 'very_long' END END AS severity FROM (SELECT *, floor(value) AS w FROM events)",
)
def mat7(t):
    return t.events.select("event_id", wx.severity(F.floor("value"), F.col("user_id") % 4 != 0).alias("severity"))


@query("boo1_truth_int", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS flag FROM events")
def boo1(t):
    s = F.element_at(F.array(*[F.lit(x) for x in ("True", "False", "1", "0.0", "maybe")]), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", wx.truth_int(s).alias("flag"))


SEQ_SQL = "SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS s FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1"


def _sequences(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber").distinct()
    return d.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("s"))


def _text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("arr1_pad_sequence", f"SELECT l_orderkey, array_to_string(list_concat(list_resize([]::INT[], CAST(greatest(4 - len(s), 0) AS BIGINT), 0), s[-4:]), ',') AS padded FROM ({SEQ_SQL})")
def arr1(t):
    return _sequences(t).select("l_orderkey", _text(arrays.pad_sequence("s", 4, F.lit(0))).alias("padded"))


@query("arr2_shift_append", f"SELECT l_orderkey, array_to_string(list_append(s[2:], 99), ',') AS shifted FROM ({SEQ_SQL})")
def arr2(t):
    return _sequences(t).select("l_orderkey", _text(arrays.shift_append("s", F.lit(99))).alias("shifted"))


@query("map1_one_hot_label", "SELECT event_id, CAST(event_type='click' AS INT) AS t_click, CAST(event_type='view' AS INT) AS t_view, CASE WHEN event_type IN ('click','view') THEN event_type ELSE 'click' END AS label FROM events")
def map1(t):
    d = t.events.select("event_id", *[e.alias(n) for n, e in arrays.one_hot("event_type", ["click", "view"], "t_").items()])
    return d.withColumn("label", arrays.one_hot_label(["t_click", "t_view"], "t_"))


@query("jsn1_decode", "SELECT event_id, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k FROM events")
def jsn1(t):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))
