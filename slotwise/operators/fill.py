"""Gap filling."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.columns import as_list, attach, micros
from slotwise.functions.calendar import floor_to
from slotwise.functions.order_stats import exact_quantiles
from slotwise.operators.scans import carry_forward


def fill_within_bucket(df: DataFrame, key: str, ts: str, measure: str, closed: str, minutes: int = 60) -> DataFrame:
    """Open gap takes the latest earlier open value of the same key, date and hour bucket.

    One bucket holds at most a bucket's worth of slots, so the window never grows with a key.
    """
    w = (
        Window.partitionBy(key, floor_to(ts, minutes)).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    )
    prev = F.last(F.when(~F.col(closed), F.col(measure)), ignorenulls=True).over(w)
    gap = F.col(measure).isNull() & ~F.col(closed)
    return df.withColumn("_prev", prev).withColumn(measure, F.when(gap, F.col("_prev")).otherwise(F.col(measure))).drop("_prev")


def _with_prior(df: DataFrame, key: str, ts: str, measure: str, closed: str, days: int, minutes: int) -> DataFrame:
    """Same-bucket and prior-period candidates (``_same``, ``_prior``) of every row.

    Each open reading also visits the bucket ``days`` later, where it serves as candidate. So
    one shuffle by (key, bucket) brings together all that a gap may take; a bucket holds no
    more than its slots and those of its prior one.
    """
    known = F.col(measure).isNotNull() & ~F.col(closed)
    us = micros(ts)
    period = F.make_dt_interval(days=F.lit(days))
    d = df.withColumn("_b", floor_to(ts, minutes))
    visit = d.where(known).select(
        key, (F.col("_b") + period).alias("_b"),
        F.struct(micros(F.col(ts) + period).alias("u"), F.col(measure).alias("v")).alias("_cand"),
    )
    u = d.unionByName(visit, allowMissingColumns=True)
    bucket = Window.partitionBy(key, "_b")
    past = bucket.orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    u = u.withColumns(
        {
            "_same": F.last(F.when(~F.col(closed), F.col(measure)), ignorenulls=True).over(past),
            "_cands": F.collect_list("_cand").over(bucket),
        }
    ).where(F.col("_cand").isNull())
    near = F.array_min(F.transform("_cands", lambda c: F.struct(F.abs(c["u"] - us).alias("d"), c["u"].alias("u"), c["v"].alias("v"))))
    return u.withColumn("_prior", near["v"]).drop("_b", "_cand", "_cands")


def fill_from_prior_period(
    df: DataFrame, key: str, ts: str, measure: str, closed: str, days: int = 7, minutes: int = 60
) -> DataFrame:
    """Open gap takes the value ``days`` earlier in the same bucket, nearest minute, earliest on ties."""
    d = _with_prior(df, key, ts, measure, closed, days, minutes)
    gap = F.col(measure).isNull() & ~F.col(closed)
    return d.withColumn(measure, F.when(gap, F.col("_prior")).otherwise(F.col(measure))).select(*df.columns)


def fill_gaps(df: DataFrame, key: str, ts: str, measure: str, closed: str, days: int = 7, minutes: int = 60) -> DataFrame:
    """Same bucket first, else the prior period's original values; the rule that fired is kept."""
    d = _with_prior(df, key, ts, measure, closed, days, minutes)
    gap = F.col(measure).isNull() & ~F.col(closed)
    rule = (
        F.when(F.col(measure).isNotNull(), "kept")
        .when(gap & F.col("_same").isNotNull(), "same_bucket")
        .when(gap & F.col("_prior").isNotNull(), "prior_period")
        .otherwise("open")
    )
    value = F.when(gap, F.coalesce("_same", "_prior")).otherwise(F.col(measure))
    return d.withColumn("fill_rule", rule).withColumn(measure, value).select(*df.columns, "fill_rule")


def fill_gaps_chained(df: DataFrame, key: str, ts: str, measure: str, closed: str) -> DataFrame:
    """As ``fill_gaps`` with hourly buckets and weekly period, but values filled in one week
    feed the next.

    The chain never leaves (key, weekday, hour): that group holds one hour per week, so it stays small whatever
    the size of the key. Hours are folded week after week inside one expression, each with the known values of
    the hour seven days before. All columns are kept.
    """
    row = F.struct(*[F.col(x).alias(f"_{i}") for i, x in enumerate(df.columns)])
    minute = F.hour(ts) * 60 + F.minute(ts)
    slot = F.struct(F.col(ts).alias("at"), minute.alias("m"), F.col(closed).alias("shut"), F.col(measure).cast("double").alias("v"), row.alias("row"))
    hours = df.groupBy(key, F.to_date(ts).alias("_day"), F.hour(ts).alias("_hour")).agg(F.collect_list(slot).alias("_rows"))
    by_time = F.array_sort("_rows", lambda x, y: F.when(x["at"] < y["at"], -1).when(x["at"] > y["at"], 1).otherwise(0))
    hour = F.struct(F.col("_day").alias("day"), by_time.alias("rows"))
    weeks = hours.groupBy(key, F.weekday("_day").alias("_weekday"), "_hour").agg(F.collect_list(hour).alias("_weeks"))
    known = "array<struct<m:int,v:double>>"

    def filled(rows: Column, before: Column) -> Column:
        """Values of one hour, and those of its open slots that are known."""
        def step(acc: Column, r: Column) -> Column:
            near = F.array_min(F.transform(before, lambda k, j: F.struct(F.abs(k["m"] - r["m"]).alias("d"), j.alias("j"), k["v"].alias("v"))))["v"]
            v = F.when(r["shut"], r["v"]).otherwise(F.coalesce(r["v"], acc["last"], near))
            seen = ~r["shut"] & v.isNotNull()
            return F.struct(
                F.when(seen, v).otherwise(acc["last"]).alias("last"),
                F.when(seen, F.concat(acc["open"], F.array(F.struct(r["m"].alias("m"), v.alias("v"))))).otherwise(acc["open"]).cast(known).alias("open"),
                F.concat(acc["all"], F.array(v)).alias("all"),
            )

        zero = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast(known).alias("open"), F.array().cast("array<double>").alias("all"))
        return F.aggregate(rows, zero, step)

    def week(acc: Column, h: Column) -> Column:
        before = F.when(F.date_add(acc["day"], 7) == h["day"], acc["open"]).otherwise(F.array().cast(known))
        done = F.transform(F.array(filled(h["rows"], before)), lambda f: F.struct(h["day"].alias("day"), f["open"].alias("open"), F.concat(acc["out"], F.array(f["all"])).alias("out")))
        return F.get(done, F.lit(0))

    start = F.struct(F.lit(None).cast("date").alias("day"), F.array().cast(known).alias("open"), F.array().cast("array<array<double>>").alias("out"))
    ordered = weeks.withColumn("_weeks", F.array_sort("_weeks", lambda x, y: F.when(x["day"] < y["day"], -1).otherwise(1)))
    values = ordered.withColumn("_values", F.flatten(F.aggregate("_weeks", start, week, lambda a: a["out"])))
    pairs = values.select(F.explode(F.arrays_zip(F.flatten("_weeks.rows").alias("r"), F.col("_values").alias("v"))).alias("_p"))
    kind = df.schema[measure].dataType
    return pairs.select(*[(F.col("_p.v").cast(kind) if x == measure else F.col(f"_p.r.row._{i}")).alias(x) for i, x in enumerate(df.columns)])


def fill_report(filled: DataFrame, key: str) -> DataFrame:
    """Count and share of each fill rule per key."""
    n = filled.groupBy(key).agg(
        *[F.count_if(F.col("fill_rule") == r).alias(f"n_{r}") for r in ("kept", "same_bucket", "prior_period", "open")],
        F.count(F.lit(1)).alias("n_rows"),
    )
    missing = F.col("n_rows") - F.col("n_kept")
    done = F.col("n_same_bucket") + F.col("n_prior_period")
    return n.withColumn("pct_filled", F.round(F.try_divide(done * 100.0, missing), 2))


def ffill(df: DataFrame, keys: str | Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Forward fill along time, per key, without limit."""
    out = carry_forward(df, keys, ts, {c: f"_f_{c}" for c in cols})
    for c in cols:
        out = out.withColumn(c, F.col(f"_f_{c}")).drop(f"_f_{c}")
    return out


def impute(
    df: DataFrame,
    keys: str | Sequence[str],
    cols: Sequence[str],
    strategy: str,
    fit_on: DataFrame | None = None,
    value: float | str | None = None,
) -> DataFrame:
    """Constant, median or most frequent value, learnt on ``fit_on`` (e.g. the training rows)."""
    if strategy == "constant":
        return df.fillna(value, subset=list(cols))
    keys, ref = as_list(keys), fit_on if fit_on is not None else df
    for c in cols:
        if strategy == "median":
            stat = exact_quantiles(ref, keys, c, {"_stat": 0.5})
        elif strategy == "mode":
            counts = ref.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_n"))
            # most frequent, smallest value on ties
            stat = counts.groupBy(*keys).agg(F.min_by(c, F.struct(-F.col("_n"), F.col(c))).alias("_stat"))
        else:
            raise ValueError(f"unknown strategy {strategy}")
        df = attach(df, stat, keys)
        df = df.withColumn(c, F.coalesce(c, "_stat")).drop("_stat")
    return df
