"""Data-quality statistics and the filters built on them."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.columns import as_list
from slotwise.functions.calendar import c, floor_to
from slotwise.functions.stats import safe_corr
from slotwise.operators.scans import day_chunk, row_index


def missing_day_stats(
    df: DataFrame, key: str, ts: str, measure: str, closed: str, max_pct: float = 20.0, true_share: bool = False
) -> DataFrame:
    """Missing open readings per key and day.

    The percentage is missing over *present* readings, as published; ``true_share`` divides
    by all. A day without any present reading has no percentage and is to be dropped.
    """
    n, miss = F.count(measure), F.count_if(F.col(measure).isNull())
    s = df.where(~F.col(closed)).groupBy(key, F.to_date(ts).alias("date")).agg(
        n.alias("total_entries"), miss.alias("missing_entries")
    )
    base = F.col("total_entries") + F.col("missing_entries") if true_share else F.col("total_entries")
    pct = F.round(F.try_divide(F.col("missing_entries").cast("double"), base) * 100, 2)
    return s.withColumn("missing_pct", pct).withColumn("drop", F.coalesce(F.col("missing_pct") > max_pct, F.lit(True)))


def drop_summary(stats: DataFrame, key: str | None) -> DataFrame:
    """Days to drop per key, or overall without a key."""
    g = stats.groupBy(*as_list(key)).agg(F.count_if("drop").alias("days_to_drop"), F.count("drop").alias("total_days"))
    return g.withColumn("drop_pct", F.round(F.try_divide(F.col("days_to_drop") * 100.0, F.col("total_days")), 2))


def drop_bad_days(df: DataFrame, key: str, ts: str, measure: str, closed: str, max_pct: float = 20.0) -> DataFrame:
    bad = missing_day_stats(df, key, ts, measure, closed, max_pct).where("drop").select(key, F.col("date").alias("_d"))
    return df.withColumn("_d", F.to_date(ts)).join(bad, [key, "_d"], "left_anti").select(*df.columns)


def drop_dead_days(df: DataFrame, ts: str, measure: str, closed: str, keys: Sequence[str] = (), min_mean: float = 1.0) -> DataFrame:
    """Without fully closed days, and without days whose mean wait is below ``min_mean``.

    Per key when keys are given, else pooled. Both tests come from one aggregation: closed
    days vanish whole, so they do not change the means of the others.
    """
    g = df.groupBy(*keys, F.to_date(ts).alias("_d")).agg(
        F.avg(F.col(closed).cast("int")).alias("_c"), F.avg(measure).alias("_m")
    )
    dead = g.where((F.col("_c") == 1) | F.coalesce(F.col("_m") < min_mean, F.lit(False))).select(*keys, "_d")
    return df.withColumn("_d", F.to_date(ts)).join(dead, [*keys, "_d"], "left_anti").select(*df.columns)


def operating_hours(df: DataFrame, ts: str, measure: str, keys: Sequence[str] = (), opening=(9, 11), closing=(17, 21)) -> DataFrame:
    """First and last hour with a positive wait per day, clipped to plausible bounds."""
    h = F.hour(ts)
    g = df.where(F.col(measure) > 0).groupBy(*keys, F.to_date(ts).alias("date")).agg(F.min(h).alias("o"), F.max(h).alias("z"))
    clip = lambda x, b: F.greatest(F.lit(b[0]), F.least(F.lit(b[1]), F.col(x)))
    return g.select(*keys, "date", clip("o", opening).alias("opening_hour"), clip("z", closing).alias("closing_hour"))


def filter_operating_hours(df: DataFrame, ts: str, measure: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with opening hour <= hour < closing hour; days without positive waits go."""
    hrs = operating_hours(df, ts, measure, keys).withColumnRenamed("date", "_d")
    j = df.withColumn("_d", F.to_date(ts)).join(hrs, [*keys, "_d"])
    return j.where((F.hour(ts) >= F.col("opening_hour")) & (F.hour(ts) < F.col("closing_hour"))).select(*df.columns)


def replace_columns(df: DataFrame, other: DataFrame, on: Sequence[str], cols: Sequence[str], fallback: bool = False) -> DataFrame:
    """Columns taken from ``other`` by exact key; old values only where ``fallback`` asks for them."""
    o = other.select(*on, *[F.col(x).alias(f"_n_{x}") for x in cols])
    j = df.join(o, list(on), "left")
    for x in cols:
        new = F.col(f"_n_{x}")
        j = j.withColumn(x, F.coalesce(new, F.col(x)) if fallback and x in df.columns else new)
    return j.select(*df.columns, *[x for x in cols if x not in df.columns])


def add_off_hours(
    df: DataFrame,
    weather: DataFrame,
    key: str,
    ts: str,
    measure: str,
    statics: Sequence[str],
    weather_cols: Sequence[str],
    open_hour: int = 9,
    close_hour: int = 21,
    bucket_minutes: int = 60,
    copy_closed: bool = False,
) -> DataFrame:
    """Existing rows plus the non-operating slots of each (key, day) they cover.

    Slots come from the weather stamps outside the hours; wait is 0, static columns are those
    of the day's first row. Added rows are closed and carry their real bucket;
    ``copy_closed`` copies the flag of the first row instead.
    """
    first = df.groupBy(key, F.to_date(ts).alias("_d")).agg(
        F.min_by(F.struct(*statics, F.col("closed")), ts).alias("_s")
    )
    h = F.hour(ts)
    off = weather.where((h < open_hour) | (h >= close_hour)).select(F.to_date(ts).alias("_d"), ts, *weather_cols)
    new = first.join(off, "_d").select(
        key, ts, F.lit(0.0).alias(measure), *[F.col(f"_s.{s}").alias(s) for s in statics], *weather_cols,
        (F.col("_s.closed") if copy_closed else F.lit(True)).alias("closed"),
    )
    old = df.select(key, ts, measure, *statics, *weather_cols, "closed")
    return old.unionByName(new).withColumn("time_bucket", floor_to(ts, bucket_minutes))


def dedupe(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], keep: str = "first") -> DataFrame:
    """One row per key by an explicit order; copies collapse before the shuffle."""
    rest = [x for x in df.columns if x not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    g = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*as_list(order))).alias("_r"))
    return g.select(*[F.col(x) if x in keys else F.col(f"_r.{x}").alias(x) for x in df.columns])


def round_to(x: str | Column, base: float = 5) -> Column:
    """Nearest multiple, halves to even."""
    return F.bround(c(x) / F.lit(float(base))) * F.lit(float(base))


def off_grid_share(df: DataFrame, measure: str, base: float = 5) -> DataFrame:
    """Share of readings off the multiples of ``base`` before and after rounding."""
    off = lambda e: F.count_if(F.abs(e % F.lit(float(base))) > 0)
    g = df.where(F.col(measure).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), off(F.col(measure)).alias("off_before"), off(round_to(measure, base)).alias("off_after")
    )
    return g.withColumns(
        {
            "pct_before": F.try_divide(F.col("off_before") * 100.0, F.col("n")),
            "pct_after": F.try_divide(F.col("off_after") * 100.0, F.col("n")),
        }
    )


def null_runs(df: DataFrame, key: str, ts: str, measure: str) -> DataFrame:
    """Frequency of each length of runs of missing values, per key.

    Position among all rows minus position among missing rows is constant inside a run.
    """
    d = row_index(df.select(key, ts, measure), key, ts, day_chunk(ts), "_i")
    nulls = row_index(d.where(F.col(measure).isNull()), key, ts, day_chunk(ts), "_j")
    runs = nulls.groupBy(key, (F.col("_i") - F.col("_j")).alias("_run")).agg(F.count(F.lit(1)).alias("run_length"))
    return runs.groupBy(key, "run_length").agg(F.count(F.lit(1)).alias("n_runs"))


def null_profile(df: DataFrame, key: str | None = None, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count and share per column (and key) in long form, from one aggregation."""
    ks = as_list(key)
    cols = list(cols or [x for x in df.columns if x not in ks])
    g = df.groupBy(*ks).agg(*[F.count_if(F.col(x).isNull()).alias(x) for x in cols], F.count(F.lit(1)).alias("n_rows"))
    long = g.unpivot([*ks, "n_rows"], cols, "column", "n_null")
    return long.withColumn("pct_null", F.round(F.try_divide(F.col("n_null") * 100.0, F.col("n_rows")), 2))


def coverage_check(df: DataFrame, key: str, ts: str) -> DataFrame:
    return df.groupBy(key, F.weekday(ts).alias("weekday"), F.hour(ts).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.to_date(ts)).alias("n_days")
    )


def sanity_report(df: DataFrame, wait: str = "wait_time", closed: str = "closed", scaled: Sequence[str] = ("temperature", "rain", "wind", "year")) -> DataFrame:
    """Checks on a feature matrix as rows (check, column, ok, detail), from two aggregations.

    Nulls, range of cyclic columns, 0/1 flags, weekend against weekday, one-hot sums, mean
    and deviation of scaled columns, sine-cosine correlation, wait outliers beyond five
    deviations, positive waits while closed, unit circle.
    """
    have = df.columns
    checks: list[tuple[str, str, Column, Column]] = []
    add = lambda n, col, detail, ok: checks.append((n, col, detail, ok))
    zero = lambda x: x == 0
    for x in have:
        add("nulls", x, F.count_if(F.col(x).isNull()).cast("double"), zero)
    cyc = [x for x in have if x.endswith(("_sin", "_cos"))]
    for x in cyc:
        add("cyclic_range", x, F.max(F.abs(F.col(x))), lambda v: v <= 1.1)
    groups = {p: [x for x in have if x.startswith(p)] for p in ("ride_name_", "part_of_day_", "season_")}
    flags = [x for g in groups.values() for x in g] + [x for x in (closed, "is_german_holiday", "is_swiss_holiday", "is_french_holiday", "is_weekend") if x in have]
    for x in flags:
        add("zero_one", x, F.count_if(~F.col(x).cast("int").isin(0, 1)).cast("double"), zero)
    if {"weekday", "is_weekend"} <= set(have):
        add("weekend", "is_weekend", F.count_if((F.col("weekday") >= 5) != (F.col("is_weekend") == 1)).cast("double"), zero)
    for p, cols in groups.items():
        if cols:
            total = sum((F.col(x) for x in cols[1:]), F.col(cols[0]))
            add("one_hot_sum", p, F.count_if(total != 1).cast("double"), zero)
    for x in scaled:
        if x in have:
            add("scaled_mean", x, F.avg(x), lambda v: F.abs(v) <= 0.1)
            add("scaled_std", x, F.stddev_samp(x), lambda v: F.abs(v - 1) <= 0.1)
    for b in ("month", "hour", "weekday", "minute"):
        s, k = f"{b}_sin", f"{b}_cos"
        if s in have and k in have:
            add("sin_cos_corr", b, safe_corr(s, k), lambda v: F.coalesce(F.abs(v) <= 0.1, F.lit(True)))
            add("unit_circle", b, F.max(F.abs(F.sqrt(F.col(s) * F.col(s) + F.col(k) * F.col(k)) - 1)), lambda v: v <= 0.1)
    if wait in have:
        st = df.agg(F.struct(F.avg(wait).alias("m"), F.stddev_samp(wait).alias("s"))).scalar()
        far = F.abs(F.col(wait) - st["m"]) > 5 * st["s"]
        add("wait_outliers", wait, F.count_if(far).cast("double"), zero)
        add("wait_negative", wait, F.count_if(F.col(wait) < 0).cast("double"), zero)
        if closed in have:
            shut = F.col(closed).cast("int") == 1
            add("closed_zero", wait, F.count_if(shut & (F.col(wait) > 0)).cast("double"), zero)
    one = df.agg(*[d.alias(f"c{i}") for i, (_, _, d, _) in enumerate(checks)])
    rows = [
        F.struct(F.lit(n).alias("check"), F.lit(x).alias("column"), F.coalesce(ok(F.col(f"c{i}")), F.lit(False)).alias("ok"), F.col(f"c{i}").alias("detail"))
        for i, (n, x, _, ok) in enumerate(checks)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
