"""Sources, payloads and stored tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.operators import grid
from slotwise.plans.registry import query
from slotwise.session import shared_folder
from slotwise.sources import payloads, readers, store

R = lambda c, n=8: F.round(c, n)
EV = {"timestamp": "ts", "ride_name": "event_type", "wait_time": "value"}


@query("src1_read_observations", "SELECT timestamp, ride_name, wait_time FROM v_obs")
def src1(t):
    return readers.read_observations(t.spark, f"{t.sf_dir}/events.parquet", EV)


@query("src2_read_checkpoints", "SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN event_type END AS event_type, value FROM events")
def src2(t):
    root = shared_folder(t.spark, "checkpoints")
    e = t.events.select("event_id", "event_type", "value")
    e.where("event_id % 3 <> 1").write.parquet(f"{root}/a")
    e.where("event_id % 3 = 1").drop("event_type").write.parquet(f"{root}/b")
    e.where("event_id < 0").write.parquet(f"{root}/empty")
    return readers.read_checkpoints(t.spark, [f"{root}/a", f"{root}/b", f"{root}/empty"])


@query("src3_read_dimension_json", "SELECT p_name AS name, p_type AS category, p_size AS min_age, p_retailprice AS max_height FROM part")
def src3(t):
    root = shared_folder(t.spark, "dimension")
    item = F.struct(
        F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_size").alias("min_age"),
        F.col("p_retailprice").alias("max_height"),
    )
    docs = t.part.groupBy(F.floor(F.col("p_partkey") / 50).alias("doc")).agg(F.collect_list(item).alias("attractions_features"))
    docs.drop("doc").write.json(root)
    return readers.read_dimension_json(t.spark, root, "attractions_features", ITEM, multi_line=False)


ITEM = "name string, category string, min_age int, max_height double"


@query("src3_read_dimension_document", "SELECT p_name AS name, p_type AS category, p_size AS min_age, p_retailprice AS max_height FROM part")
def src3_document(t):
    """The dimension as indented documents, each over many lines and in a file of its own."""
    root = shared_folder(t.spark, "dimension")
    item = F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_size").alias("min_age"), F.col("p_retailprice").alias("max_height"))
    docs = t.part.groupBy(F.pmod(F.col("p_partkey"), F.lit(4)).alias("doc")).agg(F.to_json(F.struct(F.collect_list(item).alias("attractions_features")), {"pretty": "true"}).alias("text"))
    docs.write.partitionBy("doc").text(root)
    return readers.read_dimension_json(t.spark, f"{root}/doc=*", "attractions_features", ITEM)


@query(
    "src4_parse_chart_points",
    "SELECT event_type AS ride_name, date_trunc('second', ts) AS timestamp, value AS wait_time FROM events WHERE event_id % 10 <> 0",
)
def src4(t):
    stamp = F.when(F.col("event_id") % 10 == 0, "bad").otherwise(F.date_format("ts", payloads.CHART_STAMP))
    point = F.concat(F.lit('["'), stamp, F.lit('",'), F.col("value").cast("string"), F.lit("]"))
    docs = t.events.groupBy(F.col("event_type").alias("ride_name"), F.floor(F.col("event_id") / 20).alias("doc")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(point), ","), F.lit("]")).alias("payload")
    )
    return payloads.parse_chart_points(docs.drop("doc"), "payload")


@query(
    "src5_zip_series",
    """WITH a AS (SELECT event_id // 25 AS doc, value, row_number() OVER (PARTITION BY event_id // 25 ORDER BY event_id) AS pos FROM events),
    b AS (SELECT event_id // 25 AS doc, user_id, row_number() OVER (PARTITION BY event_id // 25 ORDER BY event_id) AS pos FROM events WHERE user_id % 2 = 0)
    SELECT a.doc, CAST(a.pos - 1 AS INTEGER) AS pos, a.value AS temperature, b.user_id AS wind FROM a JOIN b USING (doc, pos)""",
)
def src5(t):
    s = lambda c: F.transform(F.array_sort(c), lambda x: x["v"])
    docs = t.events.groupBy(F.floor(F.col("event_id") / 25).alias("doc")).agg(
        s(F.collect_list(F.struct("event_id", F.col("value").alias("v")))).alias("temperature"),
        s(F.collect_list(F.when(F.col("user_id") % 2 == 0, F.struct("event_id", F.col("user_id").alias("v"))))).alias("wind"),
    )
    return payloads.zip_series(docs, ["temperature", "wind"])


@query(
    "src6_parse_hourly_payload",
    "SELECT date_trunc('hour', timestamp) AS timestamp, round(avg(temperature),8) AS \"temperature_C\", round(avg(rain),8) AS rain_mm FROM v_weather GROUP BY 1",
)
def src6(t):
    h = grid.resample_agg(t.weather, [], "timestamp", 60, ["temperature", "rain"], [])
    row = F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm").alias("t"), "temperature", "rain")
    docs = h.groupBy(F.to_date("timestamp")).agg(F.array_sort(F.collect_list(row)).alias("r")).select(
        F.struct(
            F.col("r.t").alias("time"), F.col("r.temperature").alias("temperature_2m"), F.col("r.rain").alias("rain")
        ).alias("hourly")
    )
    p = docs.select(F.to_json(F.struct("hourly"), {"ignoreNullFields": "false"}).alias("payload"))
    d = payloads.parse_hourly_payload(p, "payload")
    return d.select("timestamp", R("temperature_C").alias("temperature_C"), R("rain_mm").alias("rain_mm"))


def snapshots(events):
    """Snapshot documents of 40 readings each, as the live source would send them."""
    ride = F.struct(
        F.col("event_id").alias("id"), F.col("event_type").alias("name"), (F.col("value") >= 5).alias("is_open"),
        F.col("value").alias("wait_time"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("last_updated"),
    )
    per = lambda k: F.collect_list(F.when(F.col("event_type") == k, ride))
    docs = events.groupBy(F.floor(F.col("event_id") / 40).alias("doc")).agg(
        per("view").alias("a"), per("click").alias("b"), per("error").alias("c"), per("purchase").alias("d"), per("signup").alias("top")
    )
    land = lambda n, c: F.struct(F.lit(n).alias("name"), F.col(c).alias("rides"))
    body = F.struct(
        F.array(land("north", "a"), land("east", "b"), land("south", "c"), land("west", "d")).alias("lands"), F.col("top").alias("rides")
    )
    code = F.when(F.col("doc") % 11 == 5, 500).otherwise(200)
    return docs.select(F.struct(code.alias("http_code")).alias("status"), F.to_json(body).alias("contents"))


SNAP_SQL = """SELECT CASE event_type WHEN 'view' THEN 'north' WHEN 'click' THEN 'east' WHEN 'error' THEN 'south' WHEN 'purchase' THEN 'west' END AS land,
    event_id AS id, event_type AS ride_name, value >= 5 AS is_open, value AS wait_time, ts AS timestamp FROM events WHERE (event_id // 40) % 11 <> 5"""


@query("src7_flatten_snapshot", SNAP_SQL)
def src7(t):
    return payloads.flatten_snapshot(snapshots(t.events))


@query(
    "src8_date_spine",
    "SELECT CAST(unnest(generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS DATE) AS date",
)
def src8(t):
    ext = t.orders.agg(F.min(F.to_date("o_orderdate")).alias("lo"), F.max(F.to_date("o_orderdate")).alias("hi"))
    return grid.date_spine(ext, F.col("lo"), F.col("hi")).select("date")


@query(
    "src8_chunk_ranges",
    """WITH e AS (SELECT CAST(min(o_orderdate) AS DATE) lo, CAST(max(o_orderdate) AS DATE) hi FROM orders)
    SELECT CAST(s AS DATE) AS range_start, least(CAST(s AS DATE) + 90, hi) AS range_end FROM (SELECT hi, unnest(generate_series(lo, hi, INTERVAL 91 DAY)) AS s FROM e)""",
)
def src8_chunks(t):
    ext = t.orders.agg(F.min(F.to_date("o_orderdate")).alias("lo"), F.max(F.to_date("o_orderdate")).alias("hi"))
    return grid.chunk_ranges(ext, F.col("lo"), F.col("hi"), 91)


@query("snk1_write_table", "SELECT ride_name, timestamp, round(wait_time, 8) AS wait_time FROM v_hourly")
def snk1(t):
    path = shared_folder(t.spark, "table")
    store.write_table(t.hourly.withColumn("date", F.to_date("timestamp")), path, ["date"])
    return t.spark.read.parquet(path).select("ride_name", "timestamp", R("wait_time").alias("wait_time"))


@query("snk2_write_per_key", "SELECT lower(replace(ride_name, ' ', '_')) AS ride, count(*) AS n FROM (SELECT replace(o_orderpriority, '-', '_') AS ride_name FROM orders) GROUP BY 1")
def snk2(t):
    path = shared_folder(t.spark, "per_key")
    store.write_per_key(t.orders.select(F.col("o_orderpriority").alias("ride_name"), "o_orderkey"), "ride_name", path)
    return t.spark.read.parquet(path).groupBy("ride").agg(F.count(F.lit(1)).alias("n"))


@query(
    "snk3_upsert",
    """SELECT ride_name, timestamp, CAST(timestamp AS DATE) AS date, round(CASE WHEN timestamp >= '2024-01-20' THEN wait_time + 2 WHEN timestamp >= '2024-01-10' THEN wait_time + 1 ELSE wait_time END, 8) AS wait_time FROM v_hourly""",
)
def snk3(t):
    """Two writers use the same batch numbers; a retry keeps its place and drops dates that it no longer has."""
    root = shared_folder(t.spark, "store")
    up = lambda d, i, who: store.upsert(d, root, "ride_name", "timestamp", i, writer=who)
    plus = lambda first, n: t.hourly.where(f"timestamp >= '{first}'").withColumn("wait_time", F.col("wait_time") + n)
    up(t.hourly, 0, "a")
    up(plus("2024-01-03", 5), 1, "a")
    up(plus("2024-01-20", 2), 1, "b")
    up(plus("2024-01-10", 1), 1, "a")
    return store.read_store(t.spark, root, "ride_name", "timestamp").withColumn("wait_time", R("wait_time"))


@query("snk4_write_report", "SELECT ride_name, CAST(count(*) AS BIGINT) AS n, round(avg(wait_time), 4) AS mean_wait FROM v_obs GROUP BY 1")
def snk4(t):
    path = shared_folder(t.spark, "report")
    rep = t.obs.groupBy("ride_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("wait_time"), 4).alias("mean_wait"))
    store.write_report(rep, path, "csv", ";")
    return t.spark.read.schema("ride_name string, n bigint, mean_wait double").option("header", True).option("sep", ";").csv(path)


@query("snk4_write_report_json", "SELECT ride_name, CAST(count(*) AS BIGINT) AS n, round(avg(wait_time), 4) AS mean_wait FROM v_obs GROUP BY 1")
def snk4_json(t):
    path = shared_folder(t.spark, "report")
    rep = t.obs.groupBy("ride_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("wait_time"), 4).alias("mean_wait"))
    store.write_report(rep, path, "json")
    return t.spark.read.schema("ride_name string, n bigint, mean_wait double").json(path)


@query("snk5_expire", "SELECT ride_name, timestamp, CAST(timestamp AS DATE) AS date, round(wait_time, 8) AS wait_time FROM v_hourly WHERE timestamp >= '2024-01-15 12:00:00'")
def snk5(t):
    root = shared_folder(t.spark, "store")
    store.upsert(t.hourly, root, "ride_name", "timestamp", 0)
    store.retain(t.spark, root, "ride_name", "timestamp", "2024-01-15 12:00:00")
    return store.read_store(t.spark, root, "ride_name", "timestamp").withColumn("wait_time", R("wait_time"))


@query("snk5_compact", "SELECT ride_name, timestamp, CAST(timestamp AS DATE) AS date, round(wait_time, 8) AS wait_time FROM v_hourly WHERE timestamp >= '2024-01-15 12:00:00'")
def snk5_compact(t):
    root, kept = shared_folder(t.spark, "store"), shared_folder(t.spark, "store")
    store.upsert(t.hourly, root, "ride_name", "timestamp", 0)
    store.compact(t.spark, root, kept, "ride_name", "timestamp", cutoff="2024-01-15 12:00:00")
    return store.read_store(t.spark, kept, "ride_name", "timestamp").withColumn("wait_time", R("wait_time"))


@query(
    "snk6_read_span",
    "SELECT ride_name, timestamp, round(wait_time, 8) AS wait_time FROM v_half WHERE ride_name='click' AND timestamp >= '2024-01-10 20:00:00' AND timestamp < '2024-01-11 20:00:00'",
)
def snk6(t):
    root = shared_folder(t.spark, "store")
    store.upsert(t.half, root, "ride_name", "timestamp", 0)
    d = store.read_span(t.spark, root, "ride_name", "timestamp", "click", "2024-01-10 20:00:00", 24)
    return d.withColumn("wait_time", R("wait_time")).orderBy("timestamp")
