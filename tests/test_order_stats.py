"""Order statistics against numpy and pandas."""
import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from slotwise.functions.order_stats import exact_quantiles, exact_quantiles_of, leading_bits, rank_table

PROBS = {"q0": 0.0, "q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99, "q1": 1.0}


def frames(spark, pdf):
    return spark.createDataFrame(pdf).repartition(16)


@pytest.mark.parametrize("kind", ["continuous", "ties", "outlier"])
def test_large_groups(spark, kind):
    rng = np.random.default_rng(5)
    n = 60_000
    v = {"continuous": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float), "outlier": np.r_[rng.exponential(size=n - 1), 1e12]}[kind]
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.7, "hot", "b"), "v": v})
    got = exact_quantiles(frames(spark, pdf), "k", "v", PROBS).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        for name, p in PROBS.items():
            assert got.loc[k, name] == pytest.approx(np.quantile(g.v, p), rel=1e-12), (k, name)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 50, 101, 999])
def test_small_groups(spark, n):
    v = np.random.default_rng(n).normal(size=n)
    pdf = pd.DataFrame({"v": v})
    got = exact_quantiles(frames(spark, pdf), [], "v", PROBS).first()
    for name, p in PROBS.items():
        assert got[name] == pytest.approx(np.quantile(v, p), rel=1e-12), name


def test_null_key_and_null_values(spark):
    d = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", 5.0), ("b", None)], "k string, v double")
    got = {r.k: r.m for r in exact_quantiles(d, "k", "v", {"m": 0.5}).collect()}
    assert got == {None: 2.0, "b": 5.0}


def test_several_columns(spark):
    d = spark.createDataFrame([("a", 1.0, 10.0), ("a", 2.0, 30.0), ("b", 7.0, 0.0)], "k string, x double, y double")
    got = {r.k: (r.mx, r.my) for r in exact_quantiles_of(d, "k", {"x": {"mx": 0.5}, "y": {"my": 0.5}}).collect()}
    assert got == {"a": (1.5, 20.0), "b": (7.0, 0.0)}


def test_rank_table(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 4000, p=[0.9, 0.1]), "v": rng.integers(0, 500, 4000).astype(float)})
    got = rank_table(frames(spark, pdf), ["k"], "v", "r").toPandas()
    pdf["r"] = pdf.groupby("k")["v"].rank(pct=True)
    want = pdf.drop_duplicates().merge(got, on=["k", "v"], suffixes=("", "_got"))
    assert len(want) == len(got)
    np.testing.assert_allclose(want["r"], want["r_got"], rtol=1e-12)


def odd_doubles():
    rng = np.random.default_rng(9)
    v = np.r_[rng.normal(size=2000), 10.0 ** rng.uniform(-320, 308, 2000), -(10.0 ** rng.uniform(-320, 308, 1000)), 1 + np.arange(3000) * 2.0**-52, 2.0 ** np.arange(-1074, 1024)]
    v = np.r_[v, np.nextafter(v, np.inf), np.nextafter(v, -np.inf), 0.0, 5e-324, 1.7976931348623157e308, -1.7976931348623157e308]
    return v[np.isfinite(v)]


@pytest.mark.parametrize("bits", [12, 33])
def test_leading_bits_never_decrease(spark, bits):
    v = np.sort(odd_doubles())
    d = frames(spark, pd.DataFrame({"i": np.arange(len(v)), "v": v})).select("i", leading_bits(F.col("v"), bits).alias("h")).toPandas().sort_values("i")
    h = d["h"].to_numpy()
    assert not np.isnan(h).any() and (np.diff(h) >= 0).all()
    near = (np.abs(v) > 1e-300) & (np.abs(v) < 1e300)
    assert (np.abs(h - v)[near] <= np.abs(v)[near] * 2.0 ** (1 - bits)).all()


def test_extreme_values(spark):
    v = np.r_[odd_doubles(), np.inf, -np.inf, np.inf]
    got = exact_quantiles(frames(spark, pd.DataFrame({"v": v})), [], "v", {"a": 0.0, "m": 0.5, "z": 1.0}).first()
    assert (got.a, got.z) == (-np.inf, np.inf) and got.m == np.median(v)


def test_neighbouring_doubles(spark):
    """Values that agree in all but the last bits."""
    v = 1.0 + np.random.default_rng(4).permutation(4097) * 2.0**-52
    got = exact_quantiles(frames(spark, pd.DataFrame({"v": v})), [], "v", PROBS).first()
    assert [got[n] for n in PROBS] == [np.quantile(v, p) for p in PROBS.values()]


def test_no_window_orders_a_large_share_of_a_hot_key(spark):
    """Largest partition of each window of the plan, for one key with an outlier."""
    n = 40_000
    v = np.r_[np.random.default_rng(3).normal(100, 10, n - 1), 1e15]
    d = frames(spark, pd.DataFrame({"k": "hot", "v": v}))
    b, s = leading_bits(F.col("v"), 12).alias("b"), leading_bits(F.col("v"), 33).alias("s")
    bins = d.select(b, s, "v").distinct()
    assert bins.select("b").distinct().count() < n / 10
    assert bins.groupBy("b").agg(F.countDistinct("s").alias("c")).agg(F.max("c")).first()[0] < n / 50
    assert bins.groupBy("b", "s").count().agg(F.max("count")).first()[0] < n / 1000
    for q, deep in ((exact_quantiles(d, "k", "v", PROBS), {"_b", "_s"}), (rank_table(d, ["k"], "v", "r"), {"_b", "_s"})):
        plan = q._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window" in line]
        by_value = [line for line in windows if "_v#" in line.split("windowspecdefinition(")[1].split("ASC")[0].split(",")[-1]]
        assert by_value and all(x + "#" in line for line in by_value for x in deep)
    got = rank_table(d, ["k"], "v", "r").toPandas().sort_values("v")["r"].to_numpy()
    assert np.allclose(got, np.arange(1, n + 1) / n)
