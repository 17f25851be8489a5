"""Learned models: ridge and seasonal regression per key, boosted trees over all keys."""
from __future__ import annotations

import itertools
import json
import random
from collections.abc import Iterator, Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.columns import attach, micros
from slotwise.functions import calendar as cal
from slotwise.operators.split import expanding_folds, tiles
from slotwise.session import cut_lineage, stored


def residual(df: DataFrame, y: str, pred: str, out: str = "residual") -> DataFrame:
    return df.withColumn(out, F.col(y) - F.col(pred))


def interval(df: DataFrame, train: DataFrame, key: str, y: str, pred: str, z: float = 1.96) -> DataFrame:
    """Band of ``z`` training deviations around the forecast, not below zero."""
    s = train.groupBy(key).agg(F.stddev_samp(y).alias("_s"))
    d = attach(df, stored(s, "stats"), [key])
    return d.withColumns(
        {f"{pred}_lower": F.greatest(F.col(pred) - z * F.col("_s"), F.lit(0.0)), f"{pred}_upper": F.col(pred) + z * F.col("_s")}
    ).drop("_s")


# ridge by normal equations ---------------------------------------------------------
_FLUSH = 128  # keys held per task before their sums are passed on
_SALTS = 64  # groups of tasks whose sums are added first


def gram(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Per key the sums of products of (1, x, y), upper triangle row by row.

    Each task sums its own rows with numpy and passes one array per key on; arrays are added whole, first within
    ``_SALTS`` groups of tasks, then per key. A hot key is spread over all tasks that hold it, and no task
    adds more of its arrays than there are tasks in a group.
    """
    keys = list(keys)
    d = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).cast("double").alias("_y"))
    schema = T.StructType([d.schema[k] for k in keys] + [T.StructField("_g", T.ArrayType(T.DoubleType()))])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, np.ndarray] = {}

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([*acc], columns=keys)
            out["_g"] = [g[np.triu_indices(len(g))] for g in acc.values()]
            return out

        for pdf in batches:
            m = np.column_stack([np.ones(len(pdf)), np.stack(pdf["_x"].to_numpy()), pdf["_y"].to_numpy()])
            for k, idx in pdf.groupby(keys, dropna=False).indices.items():
                k = k if isinstance(k, tuple) else (k,)
                part = m[idx]
                acc[k] = acc.get(k, 0.0) + part.T @ part
            if len(acc) > _FLUSH:
                yield rows()
                acc.clear()
        if acc:
            yield rows()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Arrays of equal keys added up; rows come sorted by key, so one sum is open at a time."""
        key, names, open_row, total = None, None, None, None

        def row() -> pa.RecordBatch:
            g = pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.array(total))
            return pa.RecordBatch.from_arrays([*open_row, g], names=[*names, "_g"])

        for b in batches:
            names = [n for n in b.schema.names if n != "_g"]
            ids = list(zip(*(b.column(n).to_pylist() for n in names)))
            starts, flat = b.column("_g").offsets.to_numpy(), b.column("_g").values.to_numpy(zero_copy_only=False)
            for i, k in enumerate(ids):
                part = flat[starts[i] : starts[i + 1]]
                if total is not None and k == key:
                    total += part
                    continue
                if total is not None:
                    yield row()
                key, open_row, total = k, [b.column(n).slice(i, 1) for n in names], part.copy()
        if total is not None:
            yield row()

    parts = d.mapInPandas(partial, schema)
    salted = parts.withColumn("_salt", F.spark_partition_id() % _SALTS).select(*keys, "_salt", "_g")
    wide = T.StructType([*(d.schema[k] for k in keys), T.StructField("_salt", T.IntegerType()), schema["_g"]])
    some = salted.repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt").mapInArrow(added, wide).drop("_salt")
    return some.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(added, schema).withColumnRenamed("_g", "gram")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(g: pd.Series, alpha: pd.Series) -> pd.Series:
    """(intercept, coefficients...) of ridge with a free intercept from the matrix of sums."""
    def one(flat, a):
        m = _square(np.asarray(flat))
        p = len(m)
        n, sx, sy = m[0, 0], m[0, 1:-1], m[0, -1]
        sxx = m[1:-1, 1:-1] - np.outer(sx, sx) / n + a * np.eye(p - 2)
        w = np.linalg.lstsq(sxx, m[1:-1, -1] - sx * sy / n, rcond=None)[0]
        return np.concatenate([[(sy - sx @ w) / n], w])

    return pd.Series([one(f, a) for f, a in zip(g, alpha)])


def ridge_solve(grams: DataFrame, alpha: Column) -> DataFrame:
    return grams.withColumn("coef", _solve("gram", alpha)).drop("gram")


def ridge_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, alpha: float = 1.0) -> DataFrame:
    """Ridge per key on an array column; RSS + alpha * sum of squared coefficients."""
    return ridge_solve(gram(df, keys, x, y), F.lit(float(alpha)))


def dot(coef: Column, x: Column) -> Column:
    """Intercept plus the product of coefficients and features, inside the JVM."""
    terms = F.zip_with(F.slice(coef, F.lit(2), F.greatest(F.size(coef) - 1, F.lit(0))), x, lambda a, b: a * b)
    return F.aggregate(terms, F.element_at(coef, 1), lambda s, v: s + v)


def ridge_predict(df: DataFrame, model: DataFrame, keys: Sequence[str], x: str, out: str = "yhat") -> DataFrame:
    d = attach(df, model.select(*keys, F.col("coef").alias("_coef")), keys)
    return d.withColumn(out, dot(F.col("_coef"), F.col(x))).drop("_coef")


def feature_array(cols: Sequence[str | Column]) -> Column:
    return F.array(*[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(0.0)) for c in cols])


# seasonal regression ------------------------------------------------------------------
def fourier(ts: str, yearly: int = 10, weekly: int = 3, daily: int = 4) -> dict[str, Column]:
    """Sine and cosine terms of the year, week and day."""
    days = micros(ts) / F.lit(86_400_000_000.0)
    out: dict[str, Column] = {}
    for name, period, order in (("yearly", 365.25, yearly), ("weekly", 7.0, weekly), ("daily", 1.0, daily)):
        for k in range(1, order + 1):
            s, c = cal.cyclic(days * k, period)
            out[f"{name}_sin_{k}"], out[f"{name}_cos_{k}"] = s, c
    return out


def holiday_windows(holidays: DataFrame, names: Sequence[str], lower: int = 0, upper: int = 0) -> DataFrame:
    """``date, _h``: 0/1 per name and day offset from ``lower`` (not above 0) to ``upper``, from rows (date, name)."""
    offsets = range(lower, upper + 1)
    near = holidays.select(F.col("name").alias("_n"), F.explode(F.array(*[F.lit(o) for o in offsets])).alias("_o"), F.col("date").alias("_d"))
    near = near.select(F.date_add("_d", F.col("_o")).alias("date"), "_n", "_o")
    cells = [F.max(((F.col("_n") == n) & (F.col("_o") == o)).cast("double")) for n in names for o in offsets]
    return near.groupBy("date").agg(F.array(*cells).alias("_h"))


def _map_estimate(laplace: np.ndarray, gauss: np.ndarray, noise: float | None):
    """Solver of one key: (intercept, coefficients...) from its sums of products.

    Minimises RSS / (2 s^2) + sum |w| / laplace + sum w^2 / (2 gauss^2); infinite scales leave a coefficient free.
    The quadratic block is eliminated exactly; the absolute values are met by coordinate descent on what is left.
    Without ``noise``, s^2 is RSS / n, found in a few rounds.
    """
    l1 = np.flatnonzero(np.isfinite(laplace))
    rest = np.flatnonzero(~np.isfinite(laplace))

    def solve(m: np.ndarray) -> np.ndarray:
        n, mean = m[0, 0], m[0] / m[0, 0]
        c = m[1:, 1:] - np.outer(m[0, 1:], mean[1:])
        q, r, yy, p = c[:-1, :-1], c[:-1, -1], c[-1, -1], len(c) - 1
        w, s2 = np.zeros(p), noise**2 if noise else max(yy / n, 1e-12)
        for _ in range(1 if noise else 8):
            a = q[np.ix_(rest, rest)] + np.diag(s2 / gauss[rest] ** 2)
            b = np.linalg.lstsq(a, np.column_stack([q[np.ix_(rest, l1)], r[rest]]), rcond=None)[0]
            left = q[np.ix_(l1, l1)] - q[np.ix_(l1, rest)] @ b[:, :-1]
            target = r[l1] - q[np.ix_(l1, rest)] @ b[:, -1]
            v = w[l1].copy()
            for _ in range(5000):
                change = 0.0
                for j in range(len(l1)):
                    if left[j, j] <= 1e-12 * max(q[l1[j], l1[j]], 1e-300):
                        v[j] = 0.0
                        continue
                    pull = target[j] - left[j] @ v + left[j, j] * v[j]
                    new = np.sign(pull) * max(abs(pull) - s2 / laplace[l1[j]], 0.0) / left[j, j]
                    change, v[j] = max(change, abs(new - v[j])), new
                if change <= 1e-12 * (1.0 + np.abs(v).max(initial=0.0)):
                    break
            w[l1], w[rest] = v, b[:, -1] - b[:, :-1] @ v
            before, s2 = s2, max((yy - 2 * w @ r + w @ q @ w) / n, 1e-12) if not noise else s2
            if abs(before - s2) <= 1e-10 * s2:
                break
        return np.r_[mean[-1] - w @ mean[1:-1], w]

    return solve


def _square(flat: np.ndarray) -> np.ndarray:
    p = int(round((np.sqrt(8 * len(flat) + 1) - 1) / 2))
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = flat
    return np.triu(m) + np.triu(m, 1).T


class SeasonalModel:
    """y = trend (1 + multiplicative terms) + additive terms, one model per key, all keys in one job.

    The trend is linear with ``changepoints`` changes of slope (a number of them spread over the first
    ``changepoint_range`` of the training time, or their stamps) under a Laplace prior. Yearly, weekly and daily Fourier
    terms, holiday windows and regressors have normal priors. Seasons and holidays follow ``mode``, each
    regressor its own (``regressors``: name -> "additive" or "multiplicative"); those in ``standardise`` are centred and
    scaled on the training rows. Prior scales hold for y divided by its largest absolute value per key.

    Everything is fitted from per-key sums of products. A multiplicative term is a column times the trend of the
    pass before, so ``passes`` passes over the training rows are made (one is enough without such
    terms). The band is ``z`` training residual deviations wide; forecasts are not negative.
    """

    def __init__(
        self, keys: Sequence[str], ts: str, y: str, regressors: Mapping[str, str] | None = None, changepoints: int | Sequence[str] = 25,
        orders: tuple[int, int, int] = (10, 3, 4), mode: str = "additive", holidays: DataFrame | None = None, holiday_names: Sequence[str] = (),
        holiday_window: tuple[int, int] = (0, 0), standardise: Sequence[str] = (), changepoint_range: float = 0.95, changepoint_scale: float = 0.05,
        season_scale: float = 12.0, holiday_scale: float = 15.0, regressor_scale: float = 15.0, noise: float | None = None, passes: int = 3, z: float = 1.96,
    ):
        self.keys, self.ts, self.y, self.regressors, self.changepoints, self.orders = list(keys), ts, y, dict(regressors or {}), changepoints, orders
        if bad := {m for m in (mode, *self.regressors.values())} - {"additive", "multiplicative"}:
            raise ValueError(f"mode {bad}")
        self.mode, self.standardise, self.changepoint_range, self.noise, self.z = mode, list(standardise), changepoint_range, noise, z
        self.scales = changepoint_scale, season_scale, holiday_scale, regressor_scale
        self.n_holidays = len(holiday_names) * (holiday_window[1] - holiday_window[0] + 1) if holidays is not None else 0
        self.calendar = holiday_windows(holidays, holiday_names, *holiday_window) if self.n_holidays else None
        self.passes = passes if "multiplicative" in (mode if self._seasons() or self.n_holidays else "", *self.regressors.values()) else 1
        self.coef: DataFrame | None = None

    def _seasons(self) -> int:
        return 2 * sum(self.orders)

    def _parts(self) -> tuple[int, int, int]:
        """Numbers of trend columns, multiplicative and additive ones; the columns come in this order."""
        seasons = self._seasons() + self.n_holidays
        own = [sum(m == kind for m in self.regressors.values()) for kind in ("multiplicative", "additive")]
        return 1 + len(self.stamps), own[0] + (seasons if self.mode == "multiplicative" else 0), own[1] + (seasons if self.mode == "additive" else 0)

    def _x(self, df: DataFrame) -> DataFrame:
        """Columns ``_x``: trend columns, then multiplicative, then additive ones."""
        t = (micros(self.ts) - self.start) / float(self.span)
        d = df
        if self.calendar is not None:
            day = self.calendar.withColumnRenamed("date", "_day")
            d = attach(df.withColumn("_day", F.to_date(self.ts)), day, ["_day"]).drop("_day")
        seasons = list(fourier(self.ts, *self.orders).values()) + [F.coalesce(F.get("_h", F.lit(i)), F.lit(0.0)) for i in range(self.n_holidays)]
        scaled = {n: (F.col(n) - m) / s for n, (m, s) in self.moments.items()}
        own = lambda kind: [scaled.get(n, F.col(n)) for n, m in self.regressors.items() if m == kind]
        by = {kind: (seasons if self.mode == kind else []) + own(kind) for kind in ("multiplicative", "additive")}
        trend = [t, *[F.greatest(t - s, F.lit(0.0)) for s in self.stamps]]
        out = d.withColumn("_x", feature_array([*trend, *by["multiplicative"], *by["additive"]]))
        return out.drop("_h") if self.calendar is not None else out

    def _priors(self) -> tuple[np.ndarray, np.ndarray]:
        change, season, holiday, own = self.scales
        seasons = [season] * self._seasons() + [holiday] * self.n_holidays
        regs = lambda kind: [own for m in self.regressors.values() if m == kind]
        rest = [x for kind in ("multiplicative", "additive") for x in (seasons if self.mode == kind else []) + regs(kind)]
        slopes = len(self.stamps)
        return np.r_[np.inf, np.full(slopes, change), np.full(len(rest), np.inf)], np.r_[np.full(1 + slopes, np.inf), rest]

    def fit(self, train: DataFrame) -> SeasonalModel:
        """Coefficients and residual deviation per key (one small table)."""
        have = train.where(F.col(self.y).isNotNull())
        moments = [e for n in self.standardise for e in (F.avg(n).alias(f"m_{n}"), F.stddev_pop(n).alias(f"s_{n}"))]
        ends = have.agg(F.min(micros(self.ts)).alias("a"), F.max(micros(self.ts)).alias("z"), *moments).first()
        self.start, self.span = ends.a or 0, max((ends.z or 0) - (ends.a or 0), 1)
        self.moments = {n: (ends[f"m_{n}"] or 0.0, ends[f"s_{n}"] or 1.0) for n in self.standardise}
        if isinstance(self.changepoints, int):
            self.stamps = [self.changepoint_range * (i + 1) / self.changepoints for i in range(self.changepoints)]
        else:
            at = [(pd.Timestamp(c) - pd.Timestamp(0)) // pd.Timedelta(1, "us") for c in self.changepoints]
            self.stamps = [(a - self.start) / self.span for a in at]
        trends, mult, _ = self._parts()
        size = have.groupBy(*self.keys).agg(F.greatest(F.max(F.abs(self.y)), F.lit(1e-12)).cast("double").alias("_scale"))
        d = attach(self._x(have), stored(size, "scales"), self.keys).withColumn("_t", F.col(self.y) / F.col("_scale"))
        solve = _map_estimate(*self._priors(), self.noise)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def estimate(g: pd.Series) -> pd.Series:
            return pd.Series([solve(_square(np.asarray(f))) for f in g])

        coef = None
        for _ in range(self.passes):
            step = d
            if coef is not None:
                level = dot(F.slice("_w", 1, trends + 1), F.slice("_x", 1, trends))
                x = F.transform("_x", lambda v, i: F.when((i >= trends) & (i < trends + mult), v * level).otherwise(v))
                step = attach(d, coef, self.keys).withColumn("_x", x)
            coef = stored(gram(step, self.keys, "_x", "_t").select(*self.keys, estimate("gram").alias("_w")), "seasonal")
        fitted = attach(d, coef, self.keys).withColumn("_e", F.col("_t") - self._value())
        sd = fitted.groupBy(*self.keys).agg(F.stddev_samp("_e").alias("sigma"), F.max("_scale").alias("scale"))
        self.coef = stored(attach(coef, sd, self.keys).withColumnRenamed("_w", "coef"), "seasonal")
        return self

    def _value(self) -> Column:
        """Forecast in units of the scale, from ``_w`` and ``_x``."""
        trends, mult, add = self._parts()
        part = lambda a, n: F.aggregate(F.zip_with(F.slice("_w", a + 2, n), F.slice("_x", a + 1, n), lambda w, v: w * v), F.lit(0.0), lambda s, v: s + v) if n else F.lit(0.0)
        trend = F.element_at("_w", 1) + part(0, trends)
        return trend * (1.0 + part(trends, mult)) + part(trends + mult, add)

    def predict(self, future: DataFrame) -> DataFrame:
        model = self.coef.select(*self.keys, F.col("coef").alias("_w"), F.col("sigma").alias("_s"), F.col("scale").alias("_c"))
        d = attach(self._x(future), model, self.keys).withColumn("_f", self._value())
        at = lambda e: F.greatest(e * F.col("_c"), F.lit(0.0))
        known = F.col("_w").isNotNull()
        band = {"yhat": F.col("_f"), "yhat_lower": F.col("_f") - self.z * F.col("_s"), "yhat_upper": F.col("_f") + self.z * F.col("_s")}
        return d.withColumns({n: F.when(known, at(e)) for n, e in band.items()}).drop("_x", "_w", "_s", "_c", "_f")


# boosted trees -----------------------------------------------------------------------
class BoostedModel:
    """One gradient-boosted model over all keys.

    The key enters through its training mean and deviation, so any number of keys fits and
    no per-key loop is needed.
    """

    def __init__(
        self, key: str, y: str, features: Sequence[str], trees: int = 100, depth: int = 4, rate: float = 0.1, leaf: int = 5, seed: int = 42,
        rows: float = 1.0, columns: float = 1.0,
    ):
        """``rows`` and ``columns`` are the shares of rows per tree and of features per split."""
        self.key, self.y, self.features = key, y, list(features)
        self.params = dict(
            maxIter=trees, maxDepth=depth, stepSize=rate, minInstancesPerNode=leaf, seed=seed, subsamplingRate=float(rows),
            featureSubsetStrategy="all" if columns >= 1 else str(float(columns)),
        )
        self.model: GBTRegressionModel | None = None
        self.stats: DataFrame | None = None

    @property
    def inputs(self) -> list[str]:
        return ["key_mean", "key_std", *self.features]

    def _complete(self) -> Column:
        ok = F.lit(True)
        for x in self.features:
            ok = ok & F.col(x).isNotNull()
        return ok

    def _assemble(self, df: DataFrame) -> DataFrame:
        d = attach(df, self.stats, [self.key]).fillna(0.0, subset=["key_mean", "key_std"])
        va = VectorAssembler(inputCols=self.inputs, outputCol="_v", handleInvalid="keep")
        return va.transform(d)

    def fit(self, train: DataFrame) -> BoostedModel:
        """Rows without target or with a NULL feature are left out here, and only here.

        Vectors are rebalanced and checkpointed once, since every level of every tree is a job that reads them all and
        would carry the plan behind them. Without a usable row there is no model: forecasts are NULL and importances 0.
        """
        d = train.where(F.col(self.y).isNotNull() & self._complete())
        stats = d.groupBy(self.key).agg(F.avg(self.y).alias("key_mean"), F.coalesce(F.stddev_samp(self.y), F.lit(0.0)).alias("key_std"))
        self.stats = stored(stats, "key-stats")
        vectors = self._assemble(d).select("_v", self.y)
        learner = GBTRegressor(featuresCol="_v", labelCol=self.y, predictionCol="_p", **self.params)
        self.model = None if self.stats.isEmpty() else learner.fit(cut_lineage(vectors.hint("rebalance")))
        return self

    def predict(self, df: DataFrame, out: str = "yhat") -> DataFrame:
        """Every row of ``df``; the forecast is NULL where a feature is."""
        if self.model is None:
            return df.withColumn(out, F.lit(None).cast("double"))
        d = self.model.transform(self._assemble(df))
        return d.withColumn(out, F.when(self._complete(), F.col("_p"))).drop("_v", "_p", "key_mean", "key_std")

    def importances(self, spark) -> DataFrame:
        """Feature importances, largest first."""
        values = self.model.featureImportances.toArray() if self.model else np.zeros(len(self.inputs))
        rows = sorted(zip(self.inputs, (float(v) for v in values)), key=lambda r: (-r[1], r[0]))
        return spark.createDataFrame(rows, "feature string, importance double")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)


def coefficient_ranking(model: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Coefficients of each key's model with names and rank by size."""
    d = model.select(*keys, F.posexplode(F.slice("coef", F.lit(2), F.size("coef") - 1)).alias("_i", "coefficient"))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_i") + 1)
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.abs("coefficient").desc(), "_i")
    return d.select(*keys, label.alias("feature"), "coefficient", F.row_number().over(w).alias("rank"))


# search ----------------------------------------------------------------------------------
def search_ridge(df: DataFrame, keys: Sequence[str], ts: str, x: str, y: str, alphas: Sequence[float], folds: int = 3) -> DataFrame:
    """Expanding-window errors of every penalty for every key, in one job.

    The sums of each (key, fold) serve all penalties.
    """
    d = expanding_folds(df.where(F.col(y).isNotNull()), keys, ts, folds)
    k = [*keys, "fold"]
    g = gram(d.where("role = 'train'"), k, x, y)
    m = ridge_solve(g.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas]))), F.col("alpha"))
    test = d.where("role = 'test'").join(m, k)
    err = F.abs(F.col(y) - dot(F.col("coef"), F.col(x)))
    per_fold = test.groupBy(*k, "alpha").agg(F.avg(err).alias("mae"))
    return per_fold.groupBy(*keys, "alpha").agg(F.avg("mae").alias("mean_mae"), F.count(F.lit(1)).alias("n_folds"))


def random_candidates(space: dict[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """``n`` different parameter sets drawn from the value lists of ``space``."""
    every = [dict(zip(space, values)) for values in itertools.product(*space.values())]
    return random.Random(seed).sample(every, min(n, len(every)))


def search_boosted(
    df: DataFrame, key: str, ts: str, y: str, features: Sequence[str], grid: Sequence[dict], folds: int = 3, parallel: int = 8
) -> tuple[DataFrame, BoostedModel]:
    """``candidate, params, mean_rmse, n_folds, best`` of every parameter set over expanding windows, and the best set fitted on all rows.

    Usable rows are stored once, with their tile and their features as one vector; fold k trains on the tiles up to k
    and is tested on the next one, so no row is copied. ``parallel`` fits run side by side, those with most levels
    first; the first of equally good sets is the best. A set that some fold could not score has no mean.
    """
    spark = df.sparkSession
    whole = df.where(F.col(y).isNotNull() & BoostedModel(key, y, features)._complete())
    vectors = VectorAssembler(inputCols=list(features), outputCol="_f").transform(tiles(whole, [key], ts, folds + 1))
    d = stored(vectors.select(key, F.col(y).cast("double").alias(y), "tile", "_f").hint("rebalance"), "folds")

    def one(job: tuple[int, int]) -> tuple[int, float]:
        i, fold = job
        m = BoostedModel(key, y, ["_f"], **grid[i]).fit(d.where(F.col("tile") <= fold))
        error = F.col("yhat") - F.col(y)
        return i, m.predict(d.where(F.col("tile") == fold + 1)).agg(F.sqrt(F.avg(error * error))).first()[0]

    levels = [m["maxIter"] * m["maxDepth"] for m in (BoostedModel(key, y, features, **g).params for g in grid)]
    jobs = sorted([(i, f) for f in range(folds, 0, -1) for i in range(len(grid))], key=lambda j: -levels[j[0]])
    with ThreadPool(parallel) as pool:
        scores = pool.map(inheritable_thread_target(spark)(one), jobs, chunksize=1)
    own = {i: [r for j, r in scores if j == i and r is not None] for i in range(len(grid))}
    mean = {i: float(np.mean(v)) if len(v) == folds else None for i, v in own.items()}
    best = min(mean, key=lambda i: (mean[i] is None, mean[i] or 0.0, i))
    rows = [(i, json.dumps(params, sort_keys=True), mean[i], folds, i == best) for i, params in enumerate(grid)]
    return spark.createDataFrame(rows, "candidate int, params string, mean_rmse double, n_folds int, best boolean"), BoostedModel(key, y, features, **grid[best]).fit(whole)
