"""Slot series derived from the generic star-schema tables, used by the registered queries."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions.calendar import floor_to
from slotwise.operators import grid
from slotwise.operators.split import by_boundaries

# Fixed calendar of the queries: (date, country).
HOLIDAYS = [
    ("2024-01-01", "DE"), ("2024-01-01", "CH"), ("2024-01-01", "FR"),
    ("2024-01-06", "DE"), ("2024-01-02", "CH"), ("2024-01-26", "FR"),
]


class Tables:
    """Driver tables and the series mapped onto them. Everything is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def obs(self) -> DataFrame:
        """Raw observations: irregular stamps."""
        return self.events.select(
            F.col("event_type").alias("ride_name"), F.col("ts").alias("timestamp"), F.col("value").alias("wait_time")
        )

    def _slots(self, minutes: int) -> DataFrame:
        return grid.to_slots(self.obs, "ride_name", "timestamp", "wait_time", minutes)

    @cached_property
    def slots(self) -> DataFrame:
        return self._slots(5)

    @cached_property
    def half(self) -> DataFrame:
        return self._slots(30)

    @cached_property
    def hourly(self) -> DataFrame:
        return self._slots(60)

    @cached_property
    def daily(self) -> DataFrame:
        """Multi-year daily series in whole units, so that sums are exact in any order."""
        return self.orders.groupBy(
            F.col("o_orderpriority").alias("ride_name"), F.col("o_orderdate").alias("timestamp")
        ).agg(F.floor(F.avg("o_totalprice") / 1000).cast("double").alias("wait_time"))

    @cached_property
    def wide(self) -> DataFrame:
        """Many keys."""
        return self.lineitem.groupBy(
            F.col("l_suppkey").cast("string").alias("ride_name"), F.col("l_shipdate").alias("timestamp")
        ).agg(F.avg("l_quantity").alias("wait_time"))

    @cached_property
    def weather(self) -> DataFrame:
        """30-minute readings; shape only, no meaning."""
        kind = lambda k, d: F.avg(F.when(F.col("event_type") == k, F.col("value") / d))
        return self.events.groupBy(floor_to(F.col("ts"), 30).alias("timestamp")).agg(
            kind("view", 4).alias("temperature"), kind("purchase", 40).alias("rain"), kind("click", 8).alias("wind")
        )

    @cached_property
    def holidays(self) -> DataFrame:
        rows = ", ".join(f"(DATE '{d}', '{c}')" for d, c in HOLIDAYS)
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t(date, country)")

    @cached_property
    def sparse_grid(self) -> DataFrame:
        """Hourly 09-21 grid with closed flag; open slots without readings stay NULL."""
        facts = self.hourly
        g = grid.densify(facts, "ride_name", "timestamp", "wait_time", "09:00", "21:00", 60, strict=True)
        return grid.mask_closed(grid.mark_closed(g, self.obs, "timestamp", band=("09:00", "21:00")), ["wait_time"], [])

    @cached_property
    def grid5(self) -> DataFrame:
        """Five-minute 09-21 grid with closed flag and real gaps."""
        g = grid.densify(self.slots, "ride_name", "timestamp", "wait_time", "09:00", "21:00", 5, strict=True)
        return grid.mask_closed(grid.mark_closed(g, self.obs, "timestamp", band=("09:00", "21:00")), ["wait_time"], [])

    @cached_property
    def hourly_split(self) -> DataFrame:
        """Hourly series with train / val / test by day 21 and 26."""
        return by_boundaries(self.hourly, "timestamp", "2024-01-21", "2024-01-26")

    @cached_property
    def daily_split(self) -> DataFrame:
        return by_boundaries(self.daily, "timestamp", "2000-01-01", "2001-01-01")

    @cached_property
    def half_split(self) -> DataFrame:
        return by_boundaries(self.half, "timestamp", "2024-01-21", "2024-01-26")


# The same series as SQL, for checking. Each text may use the names defined before it.
SQL_VIEWS: dict[str, str] = {
    "v_obs": "SELECT event_type AS ride_name, ts AS timestamp, value AS wait_time FROM events",
    "v_slots": "SELECT ride_name, time_bucket(INTERVAL '5 minutes', timestamp) AS timestamp, avg(wait_time) AS wait_time FROM v_obs GROUP BY 1, 2",
    "v_half": "SELECT ride_name, time_bucket(INTERVAL '30 minutes', timestamp) AS timestamp, avg(wait_time) AS wait_time FROM v_obs GROUP BY 1, 2",
    "v_hourly": "SELECT ride_name, date_trunc('hour', timestamp) AS timestamp, avg(wait_time) AS wait_time FROM v_obs GROUP BY 1, 2",
    "v_daily": "SELECT o_orderpriority AS ride_name, o_orderdate AS timestamp, CAST(floor(avg(o_totalprice) / 1000) AS DOUBLE) AS wait_time FROM orders GROUP BY 1, 2",
    "v_wide": "SELECT CAST(l_suppkey AS VARCHAR) AS ride_name, l_shipdate AS timestamp, avg(l_quantity) AS wait_time FROM lineitem GROUP BY 1, 2",
    "v_weather": "SELECT time_bucket(INTERVAL '30 minutes', ts) AS timestamp, avg(CASE WHEN event_type='view' THEN value/4 END) AS temperature, "
    "avg(CASE WHEN event_type='purchase' THEN value/40 END) AS rain, avg(CASE WHEN event_type='click' THEN value/8 END) AS wind FROM events GROUP BY 1",
    "v_holidays": "SELECT CAST(d AS DATE) AS date, c AS country FROM (VALUES "
    + ", ".join(f"('{d}', '{c}')" for d, c in HOLIDAYS)
    + ") AS t(d, c)",
    "v_days": "SELECT CAST(unnest(generate_series((SELECT min(CAST(timestamp AS DATE)) FROM v_obs), (SELECT max(CAST(timestamp AS DATE)) FROM v_obs), INTERVAL 1 DAY)) AS DATE) AS date",
    "v_keys": "SELECT DISTINCT ride_name FROM v_obs",
    "v_span": "SELECT CAST(timestamp AS DATE) AS date, min(CAST(timestamp AS TIME)) AS t0, max(CAST(timestamp AS TIME)) AS t1 FROM v_obs WHERE CAST(timestamp AS TIME) BETWEEN TIME '09:00:00' AND TIME '21:00:00' GROUP BY 1",
    "v_g60": "SELECT k.ride_name, d.date + to_minutes(CAST(m AS BIGINT)) AS timestamp, d.date FROM v_keys k, v_days d, unnest(generate_series(540, 1260, 60)) AS u(m)",
    "v_g5": "SELECT k.ride_name, d.date + to_minutes(CAST(m AS BIGINT)) AS timestamp, d.date FROM v_keys k, v_days d, unnest(generate_series(540, 1260, 5)) AS u(m)",
    "v_c60": "SELECT g.ride_name, g.timestamp, g.date, f.wait_time AS w0, coalesce(CAST(g.timestamp AS TIME) < s.t0 OR CAST(g.timestamp AS TIME) > s.t1, true) AS closed FROM v_g60 g LEFT JOIN v_hourly f USING (ride_name, timestamp) LEFT JOIN v_span s ON s.date = g.date",
    "v_sparse": "SELECT ride_name, timestamp, date, CASE WHEN closed THEN 0.0 ELSE w0 END AS wait_time, closed FROM v_c60",
    "v_c5": "SELECT g.ride_name, g.timestamp, g.date, f.wait_time AS w0, coalesce(CAST(g.timestamp AS TIME) < s.t0 OR CAST(g.timestamp AS TIME) > s.t1, true) AS closed FROM v_g5 g LEFT JOIN v_slots f USING (ride_name, timestamp) LEFT JOIN v_span s ON s.date = g.date",
    "v_grid5": "SELECT ride_name, timestamp, date, CASE WHEN closed THEN 0.0 ELSE w0 END AS wait_time, closed FROM v_c5",
    "v_hsplit": "SELECT *, CASE WHEN timestamp < '2024-01-21' THEN 'train' WHEN timestamp < '2024-01-26' THEN 'val' ELSE 'test' END AS split FROM v_hourly",
    "v_halfsplit": "SELECT *, CASE WHEN timestamp < '2024-01-21' THEN 'train' WHEN timestamp < '2024-01-26' THEN 'val' ELSE 'test' END AS split FROM v_half",
    "v_dsplit": "SELECT *, CASE WHEN timestamp < '2000-01-01' THEN 'train' WHEN timestamp < '2001-01-01' THEN 'val' ELSE 'test' END AS split FROM v_daily",
}
