"""Slot alignment, closing state and resampling."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.columns import as_list, micros, require
from slotwise.functions.calendar import floor_to, hhmm_minutes, seconds_of_day, time_key
from slotwise.operators.scans import as_of, carry


def to_slots(df: DataFrame, key: str, ts: str, measure: str, minutes: int) -> DataFrame:
    """Average of the readings of each slot. Partial sums are built before the shuffle."""
    require(df, key, ts, measure)
    return df.groupBy(key, floor_to(ts, minutes).alias(ts)).agg(F.avg(measure).alias(measure))


def band(ts: str, lo: str, hi: str) -> Column:
    """Time-of-day test, both ends inclusive to the second."""
    return seconds_of_day(ts).between(hhmm_minutes(lo) * 60, hhmm_minutes(hi) * 60)


def date_bounds(df: DataFrame, ts: str) -> tuple[Column, Column]:
    """First and last date of a frame as a scalar subquery (one row, no driver round trip)."""
    b = df.agg(F.struct(F.min(F.to_date(ts)).alias("lo"), F.max(F.to_date(ts)).alias("hi"))).scalar()
    return b["lo"], b["hi"]


def date_spine(one: DataFrame, lo: Column, hi: Column, out: str = "date") -> DataFrame:
    """Every date from ``lo`` to ``hi`` for each row of ``one``."""
    return one.withColumn(out, F.explode(F.sequence(lo, hi, F.expr("INTERVAL 1 DAY"))))


def date_hours(one: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Every date from ``lo`` to ``hi`` with every hour of the day, without a join."""
    return date_spine(one, lo, hi).select("date", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))


def chunk_ranges(one: DataFrame, lo: Column, hi: Column, days: int) -> DataFrame:
    """Consecutive date ranges of at most ``days`` days, both ends inclusive."""
    d = one.select(lo.alias("_lo"), hi.alias("_hi")).select("_hi", F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {days} DAY"))).alias("range_start"))
    return d.select("range_start", F.least(F.date_add("range_start", days - 1), F.col("_hi")).alias("range_end"))


def dealt(df: DataFrame, *cols: str) -> DataFrame:
    """Spread by ``cols`` over the session's shuffle partitions; a stated number keeps AQE from merging rows that are about to multiply."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def slot_grid(
    keys: DataFrame, key: str, ts: str, lo: Column, hi: Column, open_t: str, close_t: str, minutes: int
) -> DataFrame:
    """Dates x slots for every key. Nothing is joined; the dates are dealt to all tasks before slots are generated."""
    g = dealt(date_spine(keys, lo, hi), key, "date")
    mins = F.sequence(F.lit(hhmm_minutes(open_t)), F.lit(hhmm_minutes(close_t)), F.lit(minutes))
    g = g.withColumn("_m", F.explode(mins))
    stamp = F.col("date").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("_m"))
    return g.select(key, stamp.alias(ts), "date")


def densify(
    df: DataFrame,
    key: str,
    ts: str,
    measure: str,
    open_t: str,
    close_t: str,
    minutes: int,
    start: str | None = None,
    end: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Dense date x time x key grid with the facts joined on.

    The date range is the frame's own unless given. Off-grid stamps are averaged into their
    slot; ``strict`` matches exact stamps only.
    """
    require(df, key, ts, measure)
    lo, hi = date_bounds(df, ts)
    if start:
        lo = F.lit(start).cast("date")
    if end:
        hi = F.lit(end).cast("date")
    entities = df.select(key).where(F.col(key).isNotNull()).distinct()
    g = slot_grid(entities, key, ts, lo, hi, open_t, close_t, minutes)
    facts = df.select(key, ts, measure) if strict else to_slots(df, key, ts, measure, minutes)
    return g.join(facts, [key, ts], "left").select(key, ts, "date", measure)


def missing_dates(df: DataFrame, grid: DataFrame, ts: str) -> DataFrame:
    have = df.select(F.to_date(ts).alias("date")).distinct()
    return grid.select("date").distinct().join(have, "date", "left_anti")


def mark_closed(grid: DataFrame, facts: DataFrame, ts: str, band: tuple[str, str] | None = None) -> DataFrame:
    """Closed before the first and after the last reading of the day; days without data too."""
    f = facts
    if band:
        lo, hi = (hhmm_minutes(t) * 60_000_000 for t in band)
        f = facts.where(micros_of_day(ts).between(lo, hi))
    span = f.groupBy(F.to_date(ts).alias("date")).agg(
        F.min(micros_of_day(ts)).alias("_t0"), F.max(micros_of_day(ts)).alias("_t1")
    )
    g = grid.join(span, "date", "left")
    at = micros_of_day(ts)
    closed = F.coalesce((at < F.col("_t0")) | (at > F.col("_t1")), F.lit(True))
    return g.withColumn("closed", closed).drop("_t0", "_t1").select(*grid.columns, "closed")


def micros_of_day(ts: str) -> Column:
    sec = F.extract(F.lit("SECOND"), F.col(ts))
    return time_key(ts).cast("bigint") * 60_000_000 + (sec * 1_000_000).cast("bigint")


def mask_closed(df: DataFrame, zero_cols: Sequence[str], null_cols: Sequence[str], closed: str = "closed") -> DataFrame:
    for col in zero_cols:
        df = df.withColumn(col, F.when(F.col(closed), F.lit(0.0)).otherwise(F.col(col)))
    for col in null_cols:
        df = df.withColumn(col, F.when(~F.col(closed), F.col(col)))
    return df


def daily_span(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("date")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def daily_span_histogram(df: DataFrame, ts: str) -> DataFrame:
    """How often each minute of the day is the first or the last one of a day."""
    s = df.groupBy(F.to_date(ts).alias("date")).agg(
        F.min(time_key(ts)).alias("first"), F.max(time_key(ts)).alias("last")
    )
    ends = F.explode(F.array(F.struct(F.lit("first").alias("edge"), F.col("first").alias("m")), F.struct(F.lit("last").alias("edge"), F.col("last").alias("m"))))
    return s.select(ends.alias("e")).groupBy(F.col("e.edge").alias("edge"), F.col("e.m").alias("minute_of_day")).agg(
        F.count(F.lit(1)).alias("n_days")
    )


def series_spine(df: DataFrame, keys: Sequence[str], ts: str, minutes: int) -> DataFrame:
    """Every slot from a key's first to its last reading, month by month.

    The span is cut into months before slots are generated, so a long series spreads over
    tasks instead of exploding in one.
    """
    slot = floor_to(ts, minutes)
    ext = df.groupBy(*keys).agg(F.min(slot).alias("_lo"), F.max(slot).alias("_hi"))
    months = F.sequence(F.trunc(F.col("_lo").cast("date"), "month"), F.col("_hi").cast("date"), F.expr("INTERVAL 1 MONTH"))
    d = dealt(ext.withColumn("_mo", F.explode(months)), *keys, "_mo")
    a = F.greatest(F.col("_mo").cast("timestamp_ntz"), F.col("_lo"))
    z = F.least(
        F.add_months("_mo", 1).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(minutes)), F.col("_hi")
    )
    return d.select(*keys, F.explode(F.sequence(a, z, F.make_dt_interval(mins=F.lit(minutes)))).alias(ts))


def resample_ffill(
    df: DataFrame,
    keys: str | Sequence[str],
    ts: str,
    cols: Sequence[str],
    minutes: int,
    max_age: int | None = None,
) -> DataFrame:
    """Upsample to a regular grid, holding the last value; ``max_age`` in minutes limits it.

    A slot takes the last reading at or before it, so off-grid readings count from the next
    slot on. A first slot before the first reading stays NULL.
    """
    keys = as_list(keys)
    spine = series_spine(df, keys, ts, minutes)
    src = {c: c for c in cols}
    if max_age is None:
        return as_of(spine, df, keys, ts, src)
    seen = df.withColumn("_seen", F.col(ts))
    out = as_of(spine, seen, keys, ts, {**src, "_seen": "_seen"})
    fresh = F.col("_seen") >= F.col(ts) - F.make_dt_interval(mins=F.lit(max_age))
    return out.select(*keys, ts, *[F.when(fresh, F.col(c)).alias(c) for c in cols])


def resample_agg(
    df: DataFrame, keys: str | Sequence[str], ts: str, minutes: int, mean: Sequence[str], first: Sequence[str]
) -> DataFrame:
    """Downsample: mean of numeric columns, earliest value of the others."""
    keys = as_list(keys)
    return df.groupBy(*keys, floor_to(ts, minutes).alias("_slot")).agg(
        *[F.avg(c).alias(c) for c in mean], *[F.min_by(c, ts).alias(c) for c in first]
    ).withColumnRenamed("_slot", ts)


def interpolate(df: DataFrame, keys: str | Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Linear in time between the neighbouring known values; constant after the last one,
    NULL before the first one."""
    keys = as_list(keys)
    d = df
    for c in cols:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(c).cast("double").alias("v")))
        d = d.withColumn(f"_k_{c}", known)
    d = carry(d, keys, ts, before={f"_k_{c}": f"_p_{c}" for c in cols}, after={f"_k_{c}": f"_q_{c}" for c in cols})
    for c in cols:
        p, q = F.col(f"_p_{c}"), F.col(f"_q_{c}")
        share = F.try_divide(micros(ts) - micros(p["t"]), micros(q["t"]) - micros(p["t"]))
        d = d.withColumn(
            c,
            F.coalesce(F.col(c).cast("double"), F.when(p.isNotNull() & q.isNotNull(), p["v"] + (q["v"] - p["v"]) * share), p["v"]),
        ).drop(f"_k_{c}", f"_p_{c}", f"_q_{c}")
    return d


def interpolate_smooth(df: DataFrame, keys: str | Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Cubic in time between the neighbouring known values, without overshooting them; ends as in ``interpolate``.

    A known value's slope comes from the secants to its two known neighbours (their weighted harmonic mean, 0 where
    they differ in sign, the one secant at either end), so four known values decide each gap.
    """
    keys = as_list(keys)
    at = micros(ts) / F.lit(3_600_000_000.0)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(at.alias("t"), F.col(c).cast("double").alias("v"))) for c in cols}
    d = df.withColumns({f"_k_{c}": e for c, e in known.items()})
    d = carry(d, keys, ts, before={f"_k_{c}": f"_p_{c}" for c in cols}, after={f"_k_{c}": f"_q_{c}" for c in cols}, inclusive=False)
    for c in cols:
        k, p, q = (F.col(f"_{x}_{c}") for x in "kpq")
        h0, h1 = k["t"] - p["t"], q["t"] - k["t"]
        d0, d1 = F.try_divide(k["v"] - p["v"], h0), F.try_divide(q["v"] - k["v"], h1)
        w0, w1 = 2 * h1 + h0, h1 + 2 * h0
        inner = F.when(d0 * d1 > 0, F.try_divide(w0 + w1, F.try_divide(w0, d0) + F.try_divide(w1, d1))).otherwise(0.0)
        slope = F.when(d0.isNull(), F.coalesce(d1, F.lit(0.0))).when(d1.isNull(), d0).otherwise(inner)
        d = d.withColumn(f"_k_{c}", F.when(k.isNotNull(), F.struct(k["t"].alias("t"), k["v"].alias("v"), slope.alias("m")))).drop(f"_p_{c}", f"_q_{c}")
    d = carry(d, keys, ts, before={f"_k_{c}": f"_p_{c}" for c in cols}, after={f"_k_{c}": f"_q_{c}" for c in cols})
    for c in cols:
        p, q = F.col(f"_p_{c}"), F.col(f"_q_{c}")
        h = q["t"] - p["t"]
        x = F.try_divide(at - p["t"], h)
        up = x * x * (3 - 2 * x)
        curve = p["v"] + (q["v"] - p["v"]) * up + h * x * (1 - x) * (p["m"] * (1 - x) - q["m"] * x)
        d = d.withColumn(c, F.coalesce(F.col(c).cast("double"), F.when(p.isNotNull() & q.isNotNull(), curve), p["v"])).drop(f"_k_{c}", f"_p_{c}", f"_q_{c}")
    return d


def interval_aggregate(
    df: DataFrame,
    key: str,
    ts: str,
    measure: str,
    closed: str,
    minutes: int = 30,
    first_hour: int = 9,
    last_hour: int = 21,
    tail: int | None = 48,
) -> DataFrame:
    """Mean of open readings per interval and the latest ``tail`` intervals per key.

    An interval without open readings is 0 and closed. Ranking stops at ``tail`` rows per
    key before the shuffle.
    """
    d = df.where(F.hour(ts).between(first_hour, last_hour))
    is_open = ~F.col(closed)
    out = d.groupBy(key, floor_to(ts, minutes).alias("_slot")).agg(
        F.coalesce(F.round(F.avg(F.when(is_open, F.col(measure))), 1), F.lit(0.0)).alias(measure),
        F.max(closed).alias(closed),
        F.count(F.lit(1)).alias("data_points"),
    ).withColumnRenamed("_slot", ts)
    return out if tail is None else latest_rows(out, key, ts, tail)


def latest_rows(df: DataFrame, keys: str | Sequence[str], ts: str, n: int) -> DataFrame:
    """Newest ``n`` rows per key; Spark drops the rest before the shuffle."""
    w = Window.partitionBy(*as_list(keys)).orderBy(F.col(ts).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
