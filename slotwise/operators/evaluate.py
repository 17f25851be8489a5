"""Scores of forecasts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.columns import as_list, attach, micros
from slotwise.functions.order_stats import exact_quantiles, exact_quantiles_of
from slotwise.functions.stats import safe_corr


def metric_columns(y: str, p: str) -> dict[str, Column]:
    """One-pass aggregates: MAE, RMSE, MSE, R2, both sMAPE variants, MAPE, bias, n.

    R2 uses the sums around the mean through ``var_pop``; NULL on a constant target. Both
    sMAPE variants leave out the usual factor two, as the published figures do.
    """
    y, p = F.col(y), F.col(p)
    e = y - p
    smape = F.try_divide(F.abs(e), F.abs(y) + F.abs(p))
    smape8 = F.try_divide(F.abs(e), F.abs(y) + F.abs(p) + F.lit(1e-8))
    both = y.isNotNull() & p.isNotNull()
    yy = F.when(both, y)
    mse = F.avg(e * e)
    return {
        "mae": F.avg(F.abs(e)), "rmse": F.sqrt(mse), "mse": mse,
        "r2": F.lit(1.0) - F.try_divide(mse, F.var_pop(yy)),
        "smape_pos": F.coalesce(F.avg(F.when(y > 0.1, smape)) * 100, F.lit(0.0)),
        "smape_both": F.avg(F.when((y > 0) & (p > 0), smape8)) * 100,
        "mape": F.avg(F.when(y > 0, F.try_divide(F.abs(e), y))) * 100,
        "bias": F.avg(e), "n_samples": F.count(e),
    }


def score(
    df: DataFrame, by: str | Sequence[str], y: str, p: str, names: Sequence[str] | None = None, closed: str | None = None
) -> DataFrame:
    """Metrics per group; ``closed`` rows are left out without losing their group.

    A group with nothing left gets n_samples 0 and infinite errors.
    """
    cols = metric_columns(y, p)
    if closed:
        df = df.withColumn(y, F.when(~F.col(closed), F.col(y)))
    names = list(names or cols)
    out = df.groupBy(*as_list(by)).agg(*[cols[n].alias(n) for n in {**dict.fromkeys(names), "n_samples": None}])
    if closed:
        empty = F.col("n_samples") == 0
        for n in names:
            if n != "n_samples":
                worst = "-Infinity" if n == "r2" else "Infinity"
                out = out.withColumn(n, F.when(empty, F.lit(worst).cast("double")).otherwise(F.col(n)))
    return out.select(*as_list(by), *names)


def error_table(df: DataFrame, ts: str, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.withColumns(
        {
            "error": e, "abs_error": F.abs(e), "pct_error": F.try_divide(F.abs(e) * 100, F.col(y)),
            "hour": F.hour(ts), "weekday": F.weekday(ts), "month": F.month(ts),
        }
    )


def interval_scores(df: DataFrame, by: str | Sequence[str], y: str, lo: str, hi: str, alpha: float = 0.05) -> DataFrame:
    y, lo, hi = F.col(y), F.col(lo), F.col(hi)
    inside = F.when(y.between(lo, hi), 100.0).otherwise(0.0)
    penalty = (2 / alpha) * (F.greatest(F.lit(0.0), lo - y) + F.greatest(F.lit(0.0), y - hi))
    return df.where(y.isNotNull()).groupBy(*as_list(by)).agg(
        F.avg(inside).alias("coverage_rate"), F.avg(hi - lo).alias("avg_width"), F.avg(hi - lo + penalty).alias("interval_score"),
    )


def best_per_key(scores: DataFrame, key: str, model: str = "model", metric: str = "mae") -> DataFrame:
    """Model with the least error per key, by name on ties; partial minimum before the shuffle."""
    best = scores.where(F.col(metric).isNotNull()).groupBy(key).agg(F.min(F.struct(metric, model)).alias("b"))
    return best.select(key, F.col(f"b.{model}").alias(model), F.col(f"b.{metric}").alias(metric))


def win_counts(best: DataFrame, model: str = "model") -> DataFrame:
    return best.groupBy(model).agg(F.count(F.lit(1)).alias("n_wins"))


def summarise(scores: DataFrame, by: str | Sequence[str], metrics: Sequence[str], digits: int = 2) -> DataFrame:
    """Mean, std and median of each metric; infinite and NaN scores do not count."""
    by = as_list(by)
    clean = scores
    for m in metrics:
        ok = F.abs(F.col(m)) < F.lit(float("inf"))
        clean = clean.withColumn(m, F.when(ok & ~F.isnan(m), F.col(m)))
    out = clean.groupBy(*by).agg(
        *[F.round(F.avg(m), digits).alias(f"{m}_mean") for m in metrics],
        *[F.round(F.stddev_samp(m), digits).alias(f"{m}_std") for m in metrics],
    )
    med = exact_quantiles_of(clean, by, {m: {f"{m}_median": 0.5} for m in metrics})
    return attach(out, med, by).withColumns({f"{m}_median": F.round(f"{m}_median", digits) for m in metrics})


def compare_runs(before: DataFrame, after: DataFrame, on: Sequence[str], metric: str, suffixes=("_before", "_after")) -> DataFrame:
    """Same metric of two runs side by side, with difference and improvement in percent."""
    a, b = f"{metric}{suffixes[0]}", f"{metric}{suffixes[1]}"
    j = before.select(*on, F.col(metric).alias(a)).join(after.select(*on, F.col(metric).alias(b)), list(on))
    return j.withColumn("diff", F.col(b) - F.col(a)).withColumn("improvement_pct", F.try_divide(F.col(a) - F.col(b), F.col(a)) * 100)


def drift(scores: DataFrame, by: Sequence[str], metric: str, split: str = "split") -> DataFrame:
    """Validation to test change of a metric."""
    g = scores.groupBy(*by).agg(
        F.max(F.when(F.col(split) == "val", F.col(metric))).alias("val"),
        F.max(F.when(F.col(split) == "test", F.col(metric))).alias("test"),
    )
    return g.withColumn("drift", F.col("test") - F.col("val"))


def forecast_summary(
    df: DataFrame, key: str, ts: str, pred: str, base: str | None = None, resid: str | None = None
) -> DataFrame:
    """Distribution, peak and lowest hour, direction and component correlation per key."""
    aggs = [
        F.avg(pred).alias("mean"), F.stddev_pop(pred).alias("std"), F.min(pred).alias("min"), F.max(pred).alias("max"),
        F.hour(F.max_by(ts, F.struct(F.col(pred), -micros(ts)))).alias("peak_hour"),
        F.hour(F.min_by(ts, F.struct(F.col(pred), micros(ts)))).alias("lowest_hour"),
        F.when(F.max_by(pred, ts) > F.min_by(pred, ts), "increasing").otherwise("decreasing").alias("trend"),
    ]
    if base and resid:
        aggs.append(safe_corr(base, resid).alias("component_corr"))
    out = df.groupBy(key).agg(*aggs)
    return attach(out, exact_quantiles(df, key, pred, {"q25": 0.25, "median": 0.5, "q75": 0.75}), [key])
