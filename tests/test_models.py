"""Regression, roll-out and sampling against numpy."""
import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotwise.operators import evaluate, models, rollout
from slotwise.session import shared_folder

K, T, W = "ride_name", "timestamp", "wait_time"


def closed_form(x, y, a):
    xm, ym = x.mean(0), y.mean()
    w = np.linalg.solve((x - xm).T @ (x - xm) + a * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    return np.r_[ym - xm @ w, w]


@pytest.mark.parametrize("alpha", [0.5, 20.0])
def test_ridge_equals_closed_form(spark, alpha):
    rng = np.random.default_rng(2)
    rows, data = [], {}
    for k, n in (("hot", 900), ("b", 60)):
        x = rng.normal(size=(n, 5))
        y = x @ rng.normal(size=5) + 3 + rng.normal(size=n)
        data[k] = (x, y)
        rows += [(k, [float(v) for v in r], float(t)) for r, t in zip(x, y)]
    d = spark.createDataFrame(rows, "k string, x array<double>, y double").repartition(7)
    m = {r.k: r.coef for r in models.ridge_fit(d, ["k"], "x", "y", alpha).collect()}
    for k, (x, y) in data.items():
        np.testing.assert_allclose(m[k], closed_form(x, y, alpha), rtol=1e-8, atol=1e-9)


def series(n_days=6, slots=20, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in ("a", "b"):
        for d in range(n_days):
            for s in range(slots):
                t = dt.datetime(2024, 1, 1 + d, 8) + dt.timedelta(minutes=30 * s)
                rows.append((k, t, float(rng.integers(0, 60)), float(20 + s)))
    return rows


def loop_same_day(rows, coef, n, opening):
    """Row by row, as a caller would write it."""
    out = {}
    for k in ("a", "b"):
        r = [x for x in rows if x[0] == k]
        fed = {}
        for i, (_, t, w, base) in enumerate(r):
            if i < n:
                out[k, t] = (base, 0.0)
                continue
            hist = []
            for j in range(i - n, i):
                tj, wj, bj = r[j][1], r[j][2], r[j][3]
                if j in fed and tj.date() == t.date() and tj.hour >= opening:
                    hist += fed[j]
                else:
                    hist += [wj, wj - bj]
            res = coef[k][0] + float(np.dot(coef[k][1:], hist))
            p = max(0.0, base + res)
            out[k, t] = (p, res)
            fed[i] = [p, res]
    return out


def test_same_day_rollout_equals_loop(spark):
    rows, n = series(), 12
    rng = np.random.default_rng(9)
    coef = {k: [float(v) for v in rng.normal(scale=0.1, size=2 * n + 1)] for k in ("a", "b")}
    d = spark.createDataFrame(rows, f"{K} string, {T} timestamp_ntz, {W} double, base double")
    m = spark.createDataFrame(list(coef.items()), f"{K} string, coef array<double>")
    got = {(r[K], r[T]): (r.prediction, r.residual_prediction) for r in rollout.same_day(d, m, [K], T, W, "base", n, 11).collect()}
    want = loop_same_day(rows, coef, n, 11)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], rel=1e-9), key


def test_horizon_and_incremental_agree_with_loop(spark):
    rows, n = series(3), 10
    rng = np.random.default_rng(4)
    coef = {k: [float(v) for v in rng.normal(scale=0.1, size=2 * n + 1)] for k in ("a", "b")}
    hist = spark.createDataFrame(rows, f"{K} string, {T} timestamp_ntz, {W} double, base double")
    m = spark.createDataFrame(list(coef.items()), f"{K} string, coef array<double>")
    fut = [(k, dt.datetime(2024, 1, d, 8 + s), float(30 + s)) for k in ("a", "b") for d in (4, 5) for s in range(6)]
    future = spark.createDataFrame(fut, f"{K} string, {T} timestamp_ntz, base double")
    want = {}
    for k in ("a", "b"):
        h = [(w, w - b) for kk, _, w, b in rows if kk == k][-n:]
        for kk, t, b in sorted(fut):
            if kk == k:
                r = coef[k][0] + float(np.dot(coef[k][1:], np.ravel(h)))
                p = max(0.0, b + r)
                want[k, t] = p
                h = [*h[1:], (p, r)]
    got = {(r[K], r[T]): r.prediction for r in rollout.horizon(hist, future, m, [K], T, W, "base", n).collect()}
    assert got == pytest.approx(want, rel=1e-9)
    inc = rollout.incremental(hist, future, m, K, T, W, "base", shared_folder(spark, "t"), ["2024-01-04", "2024-01-05"], n)
    day = {(r[K], r[T]): r.prediction for r in inc.collect()}
    first = {x: v for x, v in want.items() if x[1].day == 4}
    assert {x: day[x] for x in first} == pytest.approx(first, rel=1e-9)
    assert len(day) == len(want)


def test_samples_match_the_normal(spark):
    d = spark.range(400).select(F.col("id").alias("k"), F.lit(100.0).alias("p"))
    a = rollout.sample_forecast(d, ["k"], "p", F.lit(10.0), n=100).agg(F.avg("mean"), F.avg("std"), F.avg("p5"), F.avg("p95")).first()
    assert a[0] == pytest.approx(100, abs=0.3) and a[1] == pytest.approx(10, abs=0.2)
    assert a[2] == pytest.approx(100 - 16.45, abs=0.6) and a[3] == pytest.approx(100 + 16.45, abs=0.6)
    again = rollout.sample_forecast(d.repartition(5), ["k"], "p", F.lit(10.0), n=100).agg(F.sum("mean")).first()[0]
    assert again == pytest.approx(400 * a[0], rel=1e-9)


def test_sampling_schedules(spark):
    d = spark.createDataFrame([(0.0, 50.0), (10.0, 50.0), (49.0, 50.0), (3.0, 1.0)], "e double, n double")
    p = lambda s: [r[0] for r in d.select(rollout.sampling_probability(F.col("e"), F.col("n"), s)).collect()]
    assert p("linear") == pytest.approx([1.0, 0.8, 0.02, 1.0])
    assert p("exponential") == pytest.approx([1.0, 0.95**10, 0.95**49, 1.0])
    assert p("inverse_sigmoid")[1] == pytest.approx(1 / (1 + math.exp(-3)))
    assert p("anything")[1] == pytest.approx(0.7)


def test_seasonal_model_recovers_a_weekly_pattern(spark):
    rows = [("a", dt.datetime(2020, 1, 1) + dt.timedelta(days=i), 50 + 10 * math.sin(2 * math.pi * i / 7) + 0.01 * i) for i in range(800)]
    d = spark.createDataFrame(rows, f"{K} string, {T} timestamp_ntz, {W} double")
    cut = F.lit(dt.datetime(2021, 12, 1)).cast("timestamp_ntz")
    m = models.SeasonalModel([K], T, W, orders=(2, 3, 0), changepoints=3).fit(d.where(F.col(T) < cut))
    s = evaluate.score(m.predict(d.where(F.col(T) >= cut)), K, W, "yhat", ["mae"]).first()
    assert s.mae < 0.5


def test_boosted_trees_beat_the_mean_and_rank_features(spark, tmp_path):
    rng = np.random.default_rng(1)
    p = pd.DataFrame({K: rng.choice(["a", "b"], 800), "x": rng.random(800), "z": rng.random(800)})
    p[W] = 40 * p.x + 10 * (p[K] == "a")
    d = spark.createDataFrame(p)
    m = models.BoostedModel(K, W, ["x", "z"], trees=10, depth=3).fit(d)
    s = evaluate.score(m.predict(d), K, W, "yhat", ["r2"]).collect()
    assert all(r.r2 > 0.9 for r in s)
    assert m.importances(spark).first().feature == "x"


def test_metrics_edge_cases(spark):
    d = spark.createDataFrame([("a", 0.0, 0.0), ("a", 4.0, 0.0), ("a", 2.0, -1.0), ("c", 5.0, 4.0), ("c", 5.0, 6.0)], "k string, y double, p double")
    s = {r.k: r for r in evaluate.score(d, "k", "y", "p").collect()}
    assert s["a"].smape_pos == pytest.approx(100.0) and s["a"].smape_both is None
    assert s["c"].r2 is None and s["c"].mae == 1.0


def test_boosted_prediction_keeps_every_row(spark):
    from slotwise.operators.models import BoostedModel

    rows = [("a", float(i % 7), float(i)) for i in range(60)] + [("a", 3.0, None), ("b", 2.0, 1.0)]
    d = spark.createDataFrame(rows, "k string, y double, x double")
    got = BoostedModel("k", "y", ["x"], trees=2, depth=2).fit(d).predict(d)
    assert got.count() == len(rows)
    assert got.where("yhat IS NULL").count() == 1 and got.where("x IS NULL AND yhat IS NULL").count() == 1


def plain_map(x, y, laplace, gauss, noise, sweeps=4000):
    """Coordinate descent on every column of the centred design, as a check of the solver."""
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.zeros(x.shape[1])
    ridge, l1 = noise**2 / gauss**2, np.where(np.isfinite(laplace), noise**2 / laplace, 0.0)
    q, r = xc.T @ xc, xc.T @ yc
    for _ in range(sweeps):
        for j in range(len(w)):
            pull = r[j] - q[j] @ w + q[j, j] * w[j]
            w[j] = np.sign(pull) * max(abs(pull) - l1[j], 0) / (q[j, j] + ridge[j])
    return np.r_[y.mean() - x.mean(0) @ w, w]


def test_seasonal_model_equals_plain_estimate(spark):
    """Slope changes, weekly terms, holiday windows, an additive and a multiplicative regressor, three passes."""
    rng = np.random.default_rng(6)
    n, noise = 420, 0.05
    start = dt.datetime(2022, 1, 1)
    stamps = [start + dt.timedelta(days=i) for i in range(n)]
    temp, rain = rng.normal(20, 5, n), (rng.random(n) < 0.3).astype(float)
    off = {dt.date(2022, 3, 1): "A", dt.date(2022, 8, 15): "A", dt.date(2022, 12, 25): "B"}
    rows = {}
    for k, level in (("p", 40.0), ("q", 9.0)):
        trend = level + np.arange(n) * 0.02 + np.maximum(np.arange(n) - 200, 0) * 0.05
        week = np.sin(2 * np.pi * np.arange(n) / 7)
        rows[k] = trend * (1 + 0.2 * week + 0.3 * rain) + 0.4 * temp + rng.normal(0, 0.5, n)
    data = [(k, t, float(v), float(c), float(r)) for k, ys in rows.items() for t, v, c, r in zip(stamps, ys, temp, rain)]
    d = spark.createDataFrame(data, f"{K} string, {T} timestamp_ntz, {W} double, temp double, rain double").repartition(5)
    days = spark.createDataFrame([(day, name) for day, name in off.items()], "date date, name string")
    cut = 400
    train = d.where(F.col(T) < F.lit(stamps[cut]).cast("timestamp_ntz"))
    m = models.SeasonalModel(
        [K], T, W, {"temp": "additive", "rain": "multiplicative"}, changepoints=6, orders=(1, 2, 0), mode="multiplicative",
        holidays=days, holiday_names=["A", "B"], holiday_window=(0, 1), standardise=["temp"], noise=noise, passes=3,
    ).fit(train)
    got = {(r[K], r[T]): r.yhat for r in m.predict(d).collect()}

    t = np.arange(n) / (cut - 1)
    trends = np.column_stack([t, *[np.maximum(t - 0.95 * (i + 1) / 6, 0) for i in range(6)]])
    at = np.array([(s - dt.datetime(1970, 1, 1)).total_seconds() / 86400 for s in stamps])
    seasons = np.column_stack([f(2 * np.pi * h * at / p) for p, o in ((365.25, 1), (7.0, 2)) for h in range(1, o + 1) for f in (np.sin, np.cos)])
    windows = np.column_stack([[off.get((s - dt.timedelta(days=o)).date()) == name for s in stamps] for name in "AB" for o in (0, 1)]).astype(float)
    std = (temp - temp[:cut].mean()) / temp[:cut].std()
    mult = np.column_stack([seasons, windows, rain])
    laplace = np.r_[np.inf, np.full(6, 0.05), np.full(mult.shape[1] + 1, np.inf)]
    gauss = np.r_[np.full(7, np.inf), np.full(seasons.shape[1], 12.0), np.full(4, 15.0), 15.0, 15.0]
    for k, y in rows.items():
        scale = np.abs(y[:cut]).max()
        level = np.ones(n)
        for _ in range(3):
            x = np.column_stack([trends, mult * level[:, None], std])
            w = plain_map(x[:cut], y[:cut] / scale, laplace, gauss, noise)
            level = w[0] + trends @ w[1:8]
        want = np.maximum(scale * (level * (1 + mult @ w[8:-1]) + std * w[-1]), 0)
        np.testing.assert_allclose([got[k, s] for s in stamps], want, rtol=2e-5)
    assert np.abs([got["p", s] - v for s, v in zip(stamps, rows["p"])]).mean() < 1.5


def test_sums_of_products_add_whole_arrays(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(3000, 4)), rng.normal(size=3000)
    keys = np.where(rng.random(3000) < 0.8, "hot", rng.choice([f"k{i}" for i in range(300)], 3000))
    lost, other = (str(k) for k in sorted(set(keys))[5:7])
    d = spark.createDataFrame([(str(k), [float(v) for v in r], float(t)) for k, r, t in zip(keys, x, y)], "k string, x array<double>, y double").repartition(90)
    g = models.gram(d.withColumn("k", F.when(F.col("k") != lost, F.col("k"))), ["k"], "x", "y")
    assert "posexplode" not in g._jdf.queryExecution().toString() and "explode" not in g._jdf.queryExecution().toString()
    got = {r.k: r.gram for r in g.collect()}
    assert len(got) == len(set(keys)) and None in got
    for k in ("hot", other, None):
        m = np.column_stack([np.ones(3000), x, y])[keys == (lost if k is None else k)]
        np.testing.assert_allclose(got[k], (m.T @ m)[np.triu_indices(6)], rtol=1e-10, atol=1e-10)


def test_no_usable_row_gives_no_model(spark):
    d = spark.createDataFrame([("a", dt.datetime(2024, 1, i), float(i), None) for i in range(1, 9)], f"{K} string, {T} timestamp_ntz, {W} double, x double")
    m = models.BoostedModel(K, W, ["x"], trees=2).fit(d)
    assert [r.yhat for r in m.predict(d).collect()] == [None] * 8
    assert {r.importance for r in m.importances(spark).collect()} == {0.0}
    found, best = models.search_boosted(d, K, T, W, ["x"], [{"trees": 2}, {"trees": 3}], folds=2)
    assert [(r.mean_rmse, r.best) for r in found.orderBy("candidate").collect()] == [(None, True), (None, False)] and best.model is None


def test_tree_jobs_do_not_carry_the_plan_of_their_vectors(spark, monkeypatch):
    seen = []
    fit = models.GBTRegressor.fit
    monkeypatch.setattr(models.GBTRegressor, "fit", lambda self, d: seen.append(d) or fit(self, d))
    d = spark.createDataFrame([("ab"[i % 2], float(i % 7), float(i)) for i in range(60)], "k string, y double, x double")
    models.BoostedModel("k", "y", ["x"], trees=2, depth=2).fit(d)
    (d,) = seen
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert d.count() == 60 and "ExistingRDD" in plan and not [w for w in ("Exchange", "Join", "Rebalance", "AQE") if w in plan]
    assert spark.sparkContext.getCheckpointDir()  # else Spark does not cut the errors' lineage every ten trees either


def test_search_starts_the_longest_fits_first(spark, monkeypatch):
    begun = []
    fit = models.BoostedModel.fit
    monkeypatch.setattr(models.BoostedModel, "fit", lambda self, d: begun.append(self.params["maxIter"] * self.params["maxDepth"]) or fit(self, d))
    d = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, i), float(i % 5), float(i)) for i in range(24)], f"{K} string, {T} timestamp_ntz, {W} double, x double")
    grid = [{"trees": 1, "depth": 1}, {"trees": 2, "depth": 3}, {"trees": 2, "depth": 1}]
    found, _ = models.search_boosted(d, K, T, W, ["x"], grid, folds=2, parallel=1)
    assert begun[:6] == [6, 6, 2, 2, 1, 1]
    assert [(r.candidate, r.n_folds) for r in found.orderBy("candidate").collect() if r.mean_rmse is not None] == [(0, 2), (1, 2), (2, 2)]
