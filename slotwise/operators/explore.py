"""Exploration aggregates."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.columns import as_list, attach
from slotwise.functions.calendar import c
from slotwise.functions.order_stats import exact_quantiles, exact_quantiles_of
from slotwise.session import stored


def pivot(df: DataFrame, rows: dict[str, Column], column: str, values: Sequence[str], agg: Column, fill: object | None = None) -> DataFrame:
    """One output column per listed value. The values are given, so no job finds them first."""
    p = df.groupBy(*[e.alias(n) for n, e in rows.items()]).pivot(column, list(values)).agg(agg)
    return p.na.fill(fill) if fill is not None else p


def count_by_spine(df: DataFrame, value: Column, lo: int, hi: int, out: str) -> DataFrame:
    """Counts over a whole integer range, zero where nothing was seen."""
    n = df.groupBy(value.alias(out)).agg(F.count(F.lit(1)).alias("n"))
    spine = n.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias(out))
    return spine.join(n, out, "left").na.fill(0, ["n"])


def describe(df: DataFrame, by: str | Sequence[str], col: str) -> DataFrame:
    """count, mean, std, min, exact quartiles, max per group."""
    ks = as_list(by)
    a = df.groupBy(*ks).agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max")
    )
    return attach(a, exact_quantiles(df, ks, col, {"p25": 0.25, "p50": 0.5, "p75": 0.75}), ks)


def fixed_width_bin(df: DataFrame, col: str, width: float, out: str) -> DataFrame:
    """0-based right-closed bin of fixed width counted from the minimum.

    Edges run from the minimum while below the maximum, so the minimum itself and values
    above the last edge are NULL.
    """
    ext = df.agg(F.struct(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))).scalar()
    lo, hi = ext["lo"], ext["hi"]
    last = F.ceil((hi - lo) / width) - 2
    b = F.ceil((F.col(col) - lo) / width) - 1
    return df.withColumn(out, F.when((b >= 0) & (b <= last), b).cast("int"))


def iqr_outliers(df: DataFrame, by: str | Sequence[str], col: str, k: float = 1.5) -> DataFrame:
    ks = as_list(by)
    j = attach(df, stored(exact_quantiles(df, ks, col, {"_q1": 0.25, "_q3": 0.75}), "quartiles"), ks)
    w = k * (F.col("_q3") - F.col("_q1"))
    return j.where((F.col(col) < F.col("_q1") - w) | (F.col(col) > F.col("_q3") + w)).drop("_q1", "_q3")


def quantile_bins(means: DataFrame, col: str, n: int, out: str, prefix: str = "Bin ") -> DataFrame:
    """Label of the quantile bin, right-closed, the lowest value included."""
    probs = {f"_e{i}": i / n for i in range(n + 1)}
    e = exact_quantiles(means, [], col, probs)
    d = means.withColumn("_edges", e.select(F.struct(*probs)).scalar())
    label = None
    for i in range(n):
        cond = F.col(col) <= F.col("_edges")[f"_e{i + 1}"]
        label = F.when(cond, f"{prefix}{i + 1}") if label is None else label.when(cond, f"{prefix}{i + 1}")
    return d.withColumn(out, label).drop("_edges")


def nested_sum(df: DataFrame, ts: str, col: str) -> DataFrame:
    """Hourly mean, then daily sum."""
    h = df.groupBy(F.to_date(ts).alias("date"), F.hour(ts)).agg(F.avg(col).alias("_m"))
    return h.groupBy("date").agg(F.sum("_m").alias(f"{col}_daily"))


def attendance_metrics(df: DataFrame, key: str, ts: str, y: str, peak=(11, 15), top: int = 5) -> DataFrame:
    """Daily load of the whole park: all entities, peak hours, busiest entities."""
    d = df.withColumn("date", F.to_date(ts))
    busiest = d.groupBy(key).agg(F.avg(y).alias("_a")).orderBy(F.col("_a").desc(), key).limit(top).select(key, F.lit(True).alias("_top"))
    d = d.join(busiest, key, "left").withColumn("_pk", F.when(F.hour(ts).between(*peak), F.col(y)))
    d = d.withColumn("_tp", F.when(F.col("_top"), F.col(y)))
    a = d.groupBy("date").agg(
        F.avg(y).alias("daily_avg_wait"), F.sum(y).alias("daily_total_wait"), F.max(y).alias("daily_max_wait"),
        F.count(y).alias("daily_data_points"), F.count_distinct(key).alias("daily_active_rides"),
        F.avg("_pk").alias("peak_avg_wait"), F.max("_pk").alias("peak_max_wait"),
        F.avg("_tp").alias("top_rides_avg_wait"), F.max("_tp").alias("top_rides_max_wait"),
    )
    med = exact_quantiles_of(
        d, "date", {y: {"daily_median_wait": 0.5}, "_pk": {"peak_median_wait": 0.5}, "_tp": {"top_rides_median_wait": 0.5}}
    )
    return attach(a, med, ["date"])


def attendance_index(metrics: DataFrame, busiest: Sequence[str] = ()) -> DataFrame:
    """Mean of three daily metrics relative to a reference level, each capped at 100.

    The level is the median of the listed busiest days present, else the 95th percentile.
    ``metrics`` is read several times: hand in a stored or checkpointed table.
    """
    cols = ["daily_total_wait", "daily_avg_wait", "daily_median_wait"]
    def levels(df: DataFrame, p: float) -> Column:
        """One row of reference levels as a struct."""
        return exact_quantiles_of(df, [], {x: {x: p} for x in cols}).select(F.struct(*cols).alias("l")).scalar()

    d, parts = metrics.withColumn("_l", levels(metrics, 0.95)), []
    if busiest:
        at = F.to_date("date").isin([F.lit(x).cast("date") for x in busiest])
        d = d.withColumn("_b", levels(metrics.where(at), 0.5))
    for x in cols:
        level = F.coalesce(F.col("_b")[x], F.col("_l")[x]) if busiest else F.col("_l")[x]
        name = "attendance_index_" + x.split("_")[1]
        d = d.withColumn(name, F.least(F.try_divide(F.col(x), level) * 100, F.lit(100.0)))
        parts.append(F.col(name))
    return d.withColumn("attendance_index", (parts[0] + parts[1] + parts[2]) / 3).drop("_l", "_b")


def loss_accounting(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before, after, lost and the lost share."""
    n = F.count(F.lit(1))
    b = before.agg(n.alias("rows_before")).withColumn("rows_after", after.agg(n.alias("n")).select("n").scalar())
    lost = F.col("rows_before") - F.col("rows_after")
    return b.withColumn("rows_lost", lost).withColumn("pct_lost", F.try_divide(lost * 100.0, F.col("rows_before")))


def representative_dates(named: DataFrame, name: str, year: str, region: str, date: str, preferred: str, fallback: str) -> DataFrame:
    """Distinct first date per (name, year) in the preferred region, else in the second one."""
    g = named.groupBy(name, year).agg(
        F.min(F.when(F.col(region) == preferred, F.col(date))).alias("_p"), F.min(F.when(F.col(region) == fallback, F.col(date))).alias("_f")
    )
    return g.select(F.coalesce("_p", "_f").alias(date)).where(F.col(date).isNotNull()).distinct()


def frequent_names(named: DataFrame, name: str, pairs: Sequence[str], minimum: int) -> DataFrame:
    """Names seen in at least ``minimum`` distinct pairs (e.g. territory and year)."""
    n = named.select(name, *pairs).distinct().groupBy(name).agg(F.count(F.lit(1)).alias("n_occurrences"))
    return n.where(F.col("n_occurrences") >= minimum)


def batch_accounting(df: DataFrame, day: Column, ok: Column) -> DataFrame:
    g = df.groupBy(day.alias("date")).agg(F.count_if(ok).alias("n_success"), F.count_if(~ok).alias("n_failed"), F.count(F.lit(1)).alias("n_total"))
    return g.withColumn("pct_success", F.round(F.try_divide(F.col("n_success") * 100.0, F.col("n_total")), 2))


def leaderboard(runs: DataFrame, state: str, finished: str, metric: str, n: int, tie: str) -> DataFrame:
    """Best finished runs by ascending metric."""
    return runs.where((F.col(state) == finished) & F.col(metric).isNotNull()).orderBy(F.col(metric).asc(), tie).limit(n)


def metric_correlations(runs: DataFrame, params: Sequence[str], metric: str) -> DataFrame:
    """Correlation of each parameter with the metric in long form."""
    from slotwise.functions.stats import safe_corr

    g = runs.agg(*[safe_corr(p, metric).alias(p) for p in params])
    return g.unpivot([], list(params), "parameter", "correlation")
