"""Forecast roll-out: future slots, teacher-forced and autoregressive prediction, sampling.

A second-stage model corrects a baseline from the last ``n`` (wait, residual) pairs. The
recurrence is folded over a bounded array of slots per series inside one expression, so all
series advance in parallel and no step needs a job of its own.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.columns import as_list, attach
from slotwise.functions import calendar as cal
from slotwise.functions.noise import standard_normal
from slotwise.operators.grid import latest_rows
from slotwise.operators.models import dot, ridge_fit, ridge_predict
from slotwise.operators.scans import day_chunk, over_previous_rows
from slotwise.operators.sets import merge_history
from slotwise.session import stored
from slotwise.sources import store

_PAIR = "array<struct<w:double,r:double>>"


def pairs_to_features(hist: Column) -> Column:
    """(w, r) pairs to one flat array, oldest first."""
    return F.flatten(F.transform(hist, lambda p: F.array(p["w"], p["r"])))


def with_history(df: DataFrame, keys: Sequence[str], ts: str, y: str, base: str, n: int = 48) -> DataFrame:
    """Residual column and the previous ``n`` (wait, residual) pairs as ``hist``."""
    d = df.withColumn("residual", F.col(y) - F.col(base))
    pair = F.struct(F.col(y).cast("double").alias("w"), F.col("residual").cast("double").alias("r"))
    return over_previous_rows(d, keys, ts, n, lambda w: {"hist": F.collect_list(pair).over(w.rowsBetween(-n, -1))}, day_chunk(ts))


def fit_residual_model(train: DataFrame, keys: Sequence[str], ts: str, y: str, base: str, n: int = 48, alpha: float = 10.0) -> DataFrame:
    """Second stage: ridge of the residual on the lag pairs, per key."""
    d = with_history(train, keys, ts, y, base, n).where(F.size("hist") == n).withColumn("_x", pairs_to_features(F.col("hist")))
    return ridge_fit(d, keys, "_x", "residual", alpha)


def teacher_forced(df: DataFrame, model: DataFrame, keys: Sequence[str], ts: str, y: str, base: str, n: int = 48) -> DataFrame:
    """True values in the lags; rows without a full history get the baseline alone."""
    d = with_history(df, keys, ts, y, base, n).withColumn("_x", pairs_to_features(F.col("hist")))
    full = F.size("hist") == n
    d = ridge_predict(d.withColumn("_x", F.when(full, F.col("_x"))), model, keys, "_x", "_r")
    d = d.withColumn("residual_prediction", F.coalesce(F.when(full, F.col("_r")), F.lit(0.0)))
    pred = F.greatest(F.col(base) + F.col("residual_prediction"), F.lit(0.0))
    return d.withColumn("prediction", pred).drop("hist", "_x", "_r", "row_idx", "residual")


def _roll(slots: Column, start: Column, coef: Column, n: int, feed: Callable[[Column], Column]) -> Column:
    """Fold the slots (at, base, w, r) into (at, prediction, residual_prediction).

    ``feed`` says for which slots the prediction, not the truth, enters the history.
    """
    zero = F.struct(start.cast(_PAIR).alias("h"), F.array().cast("array<struct<at:timestamp_ntz,p:double,r:double>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        ready = (F.size(acc["h"]) >= n) & coef.isNotNull()
        r = F.when(ready, dot(coef, pairs_to_features(acc["h"]))).otherwise(F.lit(0.0))
        p = F.when(ready, F.greatest(s["base"] + r, F.lit(0.0))).otherwise(s["base"])
        fed = feed(s) & ready
        new = F.struct(F.when(fed, p).otherwise(s["w"]).alias("w"), F.when(fed, r).otherwise(s["r"]).alias("r"))
        grown = F.concat(acc["h"], F.array(new))
        kept = F.slice(grown, F.greatest(F.size(grown) - n + 1, F.lit(1)), F.lit(n))
        return F.struct(kept.cast(_PAIR).alias("h"), F.concat(acc["out"], F.array(F.struct(s["at"].alias("at"), p.alias("p"), r.alias("r")))).alias("out"))

    return F.aggregate(slots, zero, step, lambda a: a["out"])


def _explode_roll(d: DataFrame, keep: Sequence[str], ts: str) -> DataFrame:
    return d.select(*keep, F.explode("_out").alias("o")).select(
        *keep, F.col("o.at").alias(ts), F.col("o.p").alias("prediction"), F.col("o.r").alias("residual_prediction")
    )


def same_day(
    df: DataFrame, model: DataFrame, keys: Sequence[str], ts: str, y: str, base: str, n: int = 48, opening_hour: int = 11
) -> DataFrame:
    """Predictions replace the truth inside the current day after opening only.

    Other days always contribute true values, so (key, day) is a closed unit of at most a
    day's slots.
    """
    d = with_history(df, keys, ts, y, base, n).withColumn("_day", F.to_date(ts))
    slot = F.struct(
        F.col(ts).alias("at"), F.col(base).cast("double").alias("base"), F.col(y).cast("double").alias("w"), F.col("residual").cast("double").alias("r")
    )
    days = d.groupBy(*keys, "_day").agg(F.array_sort(F.collect_list(slot)).alias("_slots"), F.min_by("hist", ts).alias("_start"))
    days = attach(days, model.select(*keys, F.col("coef").alias("_coef")), keys)
    out = days.withColumn("_out", _roll(F.col("_slots"), F.col("_start"), F.col("_coef"), n, lambda s: F.hour(s["at"]) >= opening_hour))
    return _explode_roll(out, keys, ts)


def horizon(
    history: DataFrame, future: DataFrame, model: DataFrame, keys: Sequence[str], ts: str, y: str, base: str, n: int = 48
) -> DataFrame:
    """Every prediction feeds the next one. ``history`` holds truth and baseline, ``future``
    the baseline of the slots to predict (a bounded number per key)."""
    last = latest_rows(history.where(F.col(y).isNotNull()), keys, ts, n)
    pair = F.struct(F.col(ts).alias("at"), F.col(y).cast("double").alias("w"), (F.col(y) - F.col(base)).cast("double").alias("r"))
    start = last.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(pair)), lambda p: F.struct(p["w"].alias("w"), p["r"].alias("r"))).alias("_start"))
    slot = F.struct(
        F.col(ts).alias("at"), F.col(base).cast("double").alias("base"), F.col(base).cast("double").alias("w"), F.lit(0.0).alias("r")
    )
    f = future.groupBy(*keys).agg(F.array_sort(F.collect_list(slot)).alias("_slots"))
    d = attach(attach(f, start, keys), model.select(*keys, F.col("coef").alias("_coef")), keys)
    d = d.withColumn("_start", F.coalesce("_start", F.array().cast(_PAIR)))
    return _explode_roll(d.withColumn("_out", _roll(F.col("_slots"), F.col("_start"), F.col("_coef"), n, lambda s: F.lit(True))), keys, ts)


def incremental(
    history: DataFrame, future: DataFrame, model: DataFrame, key: str, ts: str, y: str, base: str, root: str, days: Sequence[str], n: int = 48
) -> DataFrame:
    """Day after day: each day uses the readings and the stored predictions of earlier days.

    A day is written before the next one starts, so a broken run resumes and no lineage
    builds up. The history is read once: of what lies before the first of the (ascending) days only the newest
    ``n`` readings per key can enter a forecast. Returns the stored predictions.
    """
    spark = history.sparkSession
    keys = [key]
    if not days:
        raise ValueError("no days to predict")
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    hist = history.select(key, ts, y, base)
    past = latest_rows(hist.where((F.col(ts) < at(days[0])) & F.col(y).isNotNull()), keys, ts, n)
    within = hist.where((F.col(ts) >= at(days[0])) & (F.col(ts) < at(days[-1])))
    hist = stored(past.unionByName(within), "history")
    for i, day in enumerate(days):
        known = hist
        if i:
            done = store.read_store(spark, root, key, ts).select(key, ts, F.col("prediction").alias(y), "baseline")
            known = merge_history(hist, done.withColumnRenamed("baseline", base), [key, ts]).select(key, ts, y, base)
        known = known.where(F.col(ts) < at(day))
        todays = future.where(F.to_date(ts) == F.lit(day).cast("date"))
        p = horizon(known, todays, model, keys, ts, y, base, n)
        rows = p.join(todays.select(key, ts, F.col(base).alias("baseline")), [key, ts]).withColumn("prediction_type", F.lit("incremental"))
        store.upsert(rows, root, key, ts, i)
    return store.read_store(spark, root, key, ts)


def future_slots(
    keys: DataFrame, key: str, ts: str, first_day: Column, days: int, zone: str = "Europe/Zurich", open_t: str = "09:00", close_t: str = "17:30", minutes: int = 30
) -> DataFrame:
    """Slots of the coming days in local opening hours, as UTC stamps with their local time."""
    day = F.explode(F.sequence(first_day, F.date_add(first_day, days - 1), F.expr("INTERVAL 1 DAY")))
    mins = F.sequence(F.lit(cal.hhmm_minutes(open_t)), F.lit(cal.hhmm_minutes(close_t)), F.lit(minutes))
    d = keys.select(key, day.alias("local_date")).select(key, "local_date", F.explode(mins).alias("_m"))
    local = F.col("local_date").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("_m"))
    return d.select(key, cal.to_utc(local, zone).alias(ts), local.alias("local_ts"), "local_date")


def slot_count_check(df: DataFrame, key: str, day: str, expected: int) -> DataFrame:
    g = df.groupBy(key, day).agg(F.count(F.lit(1)).alias("n_slots"))
    return g.withColumn("ok", F.col("n_slots") == expected)


def sample_forecast(df: DataFrame, keys: Sequence[str], pred: str, sigma: Column, n: int = 100, seed: int = 42) -> DataFrame:
    """Mean, 5 and 95 percent points and deviation of ``n`` noisy copies of each forecast.

    A group holds exactly ``n`` samples.
    """
    ks = as_list(keys)
    d = df.withColumn("_sd", sigma).select(*ks, pred, "_sd", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_k"))
    x = F.greatest(F.col(pred) + F.col("_sd") * standard_normal(seed, *[F.col(k) for k in ks], F.col("_k")), F.lit(0.0))
    return d.groupBy(*ks).agg(
        F.avg(x).alias("mean"), F.percentile(x, 0.05).alias("p5"), F.percentile(x, 0.95).alias("p95"), F.stddev_samp(x).alias("std"), F.count(x).alias("n_samples")
    )


# Decay and floor of each schedule.
SCHEDULES = {"linear": (0.02, 0.02), "exponential": (0.95, 0.05), "inverse_sigmoid": (0.3, 0.05), "default": (0.03, 0.05)}
SIGMOID_MIDPOINT = 0.4


def sampling_probability(epoch: Column, total: Column, strategy: str = "linear") -> Column:
    """Share of true values fed during training, by epoch."""
    name = strategy if strategy in SCHEDULES else "default"
    rate, floor = SCHEDULES[name]
    if name == "exponential":
        p = F.pow(F.lit(rate), epoch)
    elif name == "inverse_sigmoid":
        p = 1.0 / (1.0 + F.exp((epoch - total * SIGMOID_MIDPOINT) * rate))
    else:
        p = 1.0 - rate * epoch
    return F.when(total <= 1, 1.0).otherwise(F.greatest(F.lit(floor), p))


def noisy_history(hist: Column, day: Column, opening_hour: int, seed: int, *key: Column) -> Column:
    """Perturb same-day pairs (at, w, r) after opening, as a model would see its own output.

    Deviations are 15 % of the wait (0.1 at least) and 20 % of the residual (0.05 at least).
    """
    def one(p: Column) -> Column:
        same = (p["at"].cast("date") == day) & (F.hour(p["at"]) >= opening_hour)
        sw = F.greatest(F.lit(0.1), p["w"] * 0.15)
        sr = F.greatest(F.lit(0.05), F.abs(p["r"]) * 0.2)
        w = F.greatest(p["w"] + sw * standard_normal(seed, *key, p["at"], F.lit("w")), F.lit(0.0))
        r = p["r"] + sr * standard_normal(seed, *key, p["at"], F.lit("r"))
        return F.struct(p["at"].alias("at"), F.when(same, w).otherwise(p["w"]).alias("w"), F.when(same, r).otherwise(p["r"]).alias("r"))

    return F.transform(hist, one)
