"""Live snapshots from a landing folder to stored readings and slots.

Two ways lead from readings to slots. ``keep_exact`` stores every reading by (ride, stamp) and recomputes the
cells that a micro-batch touches from the stored readings: files may come late, repeated and in any order.
``tumbling_mean`` and ``sliding_mean`` keep running sums behind a watermark instead: they need no
store, but drop readings more than an hour late.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from slotwise.columns import from_micros, instant, micros, wall_clock
from slotwise.functions.calendar import floor_to
from slotwise.operators.enrich import COUNTRY_FLAGS
from slotwise.operators.grid import latest_rows
from slotwise.sources import store
from slotwise.sources.payloads import WRAPPER_SCHEMA, flatten_snapshot

WATERMARK = "1 hour"
KEY, TS, WAIT = "ride_name", "timestamp", "wait_time"


def read_snapshots(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(WRAPPER_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(landing)


def readings(snapshots: DataFrame) -> DataFrame:
    """Readings of open rides that have a stamp."""
    return flatten_snapshot(snapshots).where(F.col("is_open") & F.col(TS).isNotNull()).select(KEY, TS, WAIT)


def open_readings(snapshots: DataFrame) -> DataFrame:
    """Readings of open rides with an event time a watermark accepts."""
    return readings(snapshots).select(KEY, instant(TS).alias("event_time"), WAIT)


def deduplicated(readings: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    return readings.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["ride_name", "event_time"])


def tumbling_mean(readings: DataFrame, length: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    return _windowed(readings, F.window("event_time", length), watermark)


def sliding_mean(readings: DataFrame, length: str = "6 hours", slide: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    return _windowed(readings, F.window("event_time", length, slide), watermark)


def _windowed(readings: DataFrame, window: Column, watermark: str) -> DataFrame:
    g = readings.withWatermark("event_time", watermark).groupBy(window.alias("w"), "ride_name")
    return g.agg(F.avg("wait_time").alias("wait_time"), F.count(F.lit(1)).alias("data_points")).select(
        "ride_name", wall_clock(F.col("w.start")).alias("timestamp"), "wait_time", "data_points"
    )


def enriched(readings: DataFrame, holidays: DataFrame) -> DataFrame:
    """Holiday flags from a static table joined to the stream."""
    per_day = holidays.groupBy(F.col("date").alias("_d")).agg(*[F.max(F.col("country") == k).alias(n) for k, n in COUNTRY_FLAGS.items()])
    j = readings.withColumn("_d", F.to_date(wall_clock(F.col("event_time")))).join(per_day, "_d", "left")
    return j.select(*readings.columns, *[F.coalesce(n, F.lit(False)).alias(n) for n in COUNTRY_FLAGS.values()])


def _writer(spark: SparkSession) -> str:
    """Name of the running query for the store. Its id lives in the checkpoint, so a new checkpoint is a new writer."""
    return "q-" + spark.sparkContext.getLocalProperty("sql.streaming.queryId")


def _drained(stream: DataFrame, write, checkpoint: str, mode: str) -> StreamingQuery:
    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_store(stream: DataFrame, root: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Upsert every micro-batch by (ride_name, timestamp); a repeated batch is idempotent."""
    def write(batch: DataFrame, batch_id: int) -> None:
        if "event_time" in batch.columns:
            batch = batch.withColumn(TS, wall_clock(F.col("event_time"))).drop("event_time")
        store.upsert(batch, root, KEY, TS, batch_id, writer=_writer(batch.sparkSession))

    return _drained(stream, write, checkpoint, mode)


def to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_exact(stream: DataFrame, root: str, checkpoint: str, means: Mapping[str, tuple[int, int]] | None = None) -> StreamingQuery:
    """Readings to the store ``root/readings``, and for each of ``means`` (name: length and slide in minutes) the means of all windows that a micro-batch touches to ``root/name``.

    A reading is known by (ride, stamp); the last one written counts, so repeated files change nothing. Means
    come from all stored readings of the touched windows, however old, not from state. A micro-batch
    that is tried again replaces what it wrote; a new checkpoint writes beside the old one. One query at a
    time should maintain the means of a folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        writer = _writer(spark)
        store.upsert(batch, f"{root}/readings", KEY, TS, batch_id, writer=writer)
        if means:
            own = spark.read.parquet(f"{root}/readings").where((F.col("writer") == writer) & (F.col("batch_id") == batch_id))
            for name, (length, slide) in means.items():
                refresh_means(own, root, name, length, slide, batch_id, writer)

    return _drained(stream, write, checkpoint, "append")


def refresh_means(changed: DataFrame, root: str, name: str, length: int, slide: int, batch_id: int, writer: str) -> None:
    """Upsert the windows (``length`` minutes, one every ``slide``) that hold a row of ``changed`` (with ``date``), from the stored readings."""
    spark = changed.sparkSession
    days = [r.date for r in changed.select("date").distinct().collect()]
    reach = -(-length // 1440)
    near = sorted({d + dt.timedelta(k) for d in days for k in ((0,) if length == slide and 1440 % length == 0 else range(-reach, reach + 1))})
    touched = _window_starts(changed.select(KEY, floor_to(F.col(TS), slide).alias("_slot")).distinct(), length, slide).select(KEY, TS).distinct()
    valid = store.read_store(spark, f"{root}/readings", KEY, TS, dates=near)
    slots = valid.groupBy(KEY, floor_to(F.col(TS), slide).alias("_slot")).agg(F.sum(WAIT).alias("_s"), F.count(WAIT).alias("_m"), F.count(F.lit(1)).alias("_n"))
    cells = _window_starts(slots, length, slide).join(touched, [KEY, TS], "left_semi").groupBy(KEY, TS)
    rows = cells.agg((F.sum("_s") / F.sum("_m")).alias(WAIT), F.sum("_n").alias("data_points"))
    store.upsert(rows, f"{root}/{name}", KEY, TS, batch_id, writer=writer, keep_order=False)


def _window_starts(slots: DataFrame, length: int, slide: int) -> DataFrame:
    """A copy of each slot for every window it lies in, by the window's start."""
    if length % slide or 1440 % slide:
        raise ValueError("the length of a window must be a multiple of its slide, and the slide divide the day")
    back = F.explode(F.sequence(F.lit(0), F.lit(length - slide), F.lit(slide)))
    return slots.withColumn("_b", back).withColumn(TS, F.col("_slot") - F.make_dt_interval(mins=F.col("_b"))).drop("_b", "_slot")


def backfill_intervals(spark: SparkSession, landing: str, root: str, batch_id: int, first_date: str, last_date: str, length: str = "30 minutes", writer: str = "backfill") -> None:
    """Batch path for late snapshots: the intervals of the given days are recomputed from all
    files and upserted as a newer batch."""
    d = readings(spark.read.schema(WRAPPER_SCHEMA).json(landing)).dropDuplicates([KEY, TS, WAIT])
    days = F.to_date(TS)
    d = d.where((days >= F.lit(first_date).cast("date")) & (days <= F.lit(last_date).cast("date")))
    g = d.groupBy(F.window(instant(TS), length).alias("w"), KEY).agg(F.avg(WAIT).alias(WAIT), F.count(F.lit(1)).alias("data_points"))
    store.upsert(g.select(KEY, wall_clock(F.col("w.start")).alias(TS), WAIT, "data_points"), root, KEY, TS, batch_id, writer=writer)


def freshness(stored: DataFrame, now: Column) -> DataFrame:
    """Age in minutes of the newest reading per ride."""
    age = (micros(now) - micros(F.max("timestamp"))) / 60_000_000
    return stored.groupBy("ride_name").agg(F.max("timestamp").alias("latest"), F.floor(age).alias("age_minutes"))


def recent_intervals(stored: DataFrame, n: int = 48) -> DataFrame:
    """The newest intervals per ride, recomputed from the store instead of kept as state."""
    return latest_rows(stored, "ride_name", "timestamp", n)


class _Recent(StatefulProcessor):
    """Readings of the newest ``keep`` intervals of one ride, by stamp.

    An interval that ``keep`` newer ones have pushed out can never come back, so late and repeated
    readings leave the means exact. A ride without readings for ``idle_ms`` of clock time is forgotten with the next
    micro-batch.
    """

    def __init__(self, keep: int, idle_ms: int):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "slot long", "stamps array<long>, waits array<double>")
        self.version = handle.getValueState("version", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        now = timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(now + self.idle_ms)
        cells = {k[0]: dict(zip(v[0], v[1])) for k, v in self.cells.iterator()}
        before, changed = set(cells), set()
        for part in rows:
            for slot, group in part.groupby("slot"):
                changed.add(int(slot))
                cells.setdefault(int(slot), {}).update(zip(group["at"].tolist(), group[WAIT].tolist()))
        newest = set(sorted(cells)[-self.keep :])
        for slot in changed & newest:
            self.cells.updateValue((slot,), (list(cells[slot]), list(cells[slot].values())))
        for slot in before - newest:
            self.cells.removeKey((slot,))
        version = max(now, self.version.get()[0] + 1 if self.version.exists() else 0)  # grows on, also after a ride was forgotten
        self.version.update((version,))
        shown = sorted(newest)
        waits = [[w for w in cells[s].values() if w == w and w is not None] for s in shown]
        yield pd.DataFrame(
            {
                KEY: key[0], "version": version, "slot": shown,
                WAIT: [sum(w) / len(w) if w else None for w in waits], "data_points": [len(cells[s]) for s in shown],
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.cells.clear()
        self.version.clear()
        return iter(())

    def close(self) -> None:
        pass


def state_session(spark: SparkSession) -> SparkSession:
    """A session of its own for ``recent_state``: RocksDB as state store, and no micro-batches without data, which clock timers would start for ever."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def recent_state(readings: DataFrame, minutes: int = 30, keep: int = 48, idle: dt.timedelta = dt.timedelta(days=14)) -> DataFrame:
    """Stream of the newest ``keep`` intervals per ride, kept as state: all of a ride's intervals, under a new ``version``, whenever it has new readings.

    The source is read in a ``state_session``.
    """
    d = readings.select(KEY, micros(floor_to(F.col(TS), minutes)).alias("slot"), micros(TS).alias("at"), F.col(WAIT).cast("double").alias(WAIT))
    out = d.groupBy(KEY).transformWithStateInPandas(
        _Recent(keep, int(idle.total_seconds() * 1000)), f"{KEY} string, version long, slot long, {WAIT} double, data_points long", "append", "processingTime"
    )
    return out.select(KEY, "version", from_micros(F.col("slot")).alias(TS), WAIT, "data_points")


def latest_state(emitted: DataFrame) -> DataFrame:
    """Rows of each ride's greatest version."""
    top = emitted.groupBy(F.col(KEY).alias("_k")).agg(F.max("version").alias("_v"))
    return emitted.join(top, F.col(KEY).eqNullSafe(F.col("_k")) & (F.col("version") == F.col("_v"))).drop("_k", "_v", "version")
