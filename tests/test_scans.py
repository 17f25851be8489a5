"""Two-level scans against pandas, with a hot key, NULL keys and gaps."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotwise.operators import scans
from slotwise.operators.split import tiles


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    parts = []
    for key, n in (("hot", 3000), ("b", 700), (None, 300), ("c", 1)):
        mins = np.sort(rng.choice(60 * 24 * 40, n, replace=False))
        parts.append(pd.DataFrame({"k": key, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(mins, "min"), "v": rng.normal(size=n)}))
    d = pd.concat(parts, ignore_index=True)
    d.loc[rng.random(len(d)) < 0.7, "v"] = np.nan
    return d


def to_spark(spark, pdf):
    rows = [(None if pd.isna(k) else k, t.to_pydatetime(), None if pd.isna(v) else float(v)) for k, t, v in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double").repartition(16)


def by_key(sdf, col):
    p = sdf.toPandas().sort_values(["k", "ts"], na_position="last").reset_index(drop=True)
    return p[col]


def ordered(pdf):
    return pdf.sort_values(["k", "ts"], na_position="last").reset_index(drop=True)


def test_row_index(spark, series):
    got = by_key(scans.row_index(to_spark(spark, series), "k", "ts", scans.day_chunk("ts"), "i", total="n"), ["i", "n"])
    p = ordered(series)
    g = p.groupby("k", dropna=False)["ts"]
    assert (got["i"].to_numpy() == g.cumcount().to_numpy()).all()
    assert (got["n"].to_numpy() == g.transform("size").to_numpy()).all()


@pytest.mark.parametrize("inclusive", [True, False])
def test_carry_forward(spark, series, inclusive):
    got = by_key(scans.carry_forward(to_spark(spark, series), "k", "ts", {"v": "f"}, inclusive=inclusive), "f").astype(float)
    p = ordered(series)
    want = p.groupby("k", dropna=False)["v"].transform(lambda s: (s if inclusive else s.shift(1)).ffill())
    if not inclusive:
        want = p.groupby("k", dropna=False)["v"].transform(lambda s: s.ffill().shift(1))
    np.testing.assert_array_equal(got.to_numpy(), want.to_numpy())


def test_carry_backward(spark, series):
    got = by_key(scans.carry_backward(to_spark(spark, series), "k", "ts", {"v": "f"}), "f").astype(float)
    want = ordered(series).groupby("k", dropna=False)["v"].transform(lambda s: s.bfill())
    np.testing.assert_array_equal(got.to_numpy(), want.to_numpy())


@pytest.mark.parametrize("block", [None, 7])
def test_previous_rows_cross_blocks(spark, series, block):
    d = scans.over_previous_rows(
        to_spark(spark, series), "k", "ts", 7, lambda w: {"l": F.lag("ts", 7).over(w), "m": F.count("v").over(w.rowsBetween(-7, -1))}, scans.day_chunk("ts"), block
    )
    got = by_key(d, ["l", "m"])
    p = ordered(series)
    g = p.groupby("k", dropna=False)
    pd.testing.assert_series_equal(pd.to_datetime(got["l"]).astype("datetime64[ns]"), g["ts"].shift(7).astype("datetime64[ns]"), check_names=False)
    want = g["v"].transform(lambda s: s.shift(1).rolling(7, min_periods=0).count())
    np.testing.assert_array_equal(got["m"].to_numpy(), want.fillna(0).to_numpy())


def test_previous_time(spark, series):
    d = scans.over_previous_time(to_spark(spark, series), "k", "ts", 6 * 3600, lambda w: {"n": F.count(F.lit(1)).over(w)})
    got = by_key(d, "n")
    p = ordered(series).assign(one=1.0)
    want = pd.concat(
        [g.set_index("ts")["one"].rolling("6h").sum().reset_index(drop=True) for _, g in p.groupby("k", dropna=False, sort=True)], ignore_index=True
    )
    np.testing.assert_array_equal(got.to_numpy(), want.to_numpy())


@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, series, strict):
    right = series.dropna().sort_values("ts")
    left = series[["k", "ts"]].dropna().sort_values("ts")
    got = scans.as_of(to_spark(spark, series).select("k", "ts"), to_spark(spark, right), "k", "ts", {"v": "f"}, strict)
    got = by_key(got.where("k IS NOT NULL"), "f").astype(float)
    want = pd.merge_asof(left, right, on="ts", by="k", allow_exact_matches=not strict).sort_values(["k", "ts"])["v"]
    np.testing.assert_array_equal(got.to_numpy(), want.to_numpy())


def test_tiles_match_ntile(spark, series):
    from pyspark.sql import Window

    d = tiles(to_spark(spark, series), "k", "ts", 6).withColumn("want", F.ntile(6).over(Window.partitionBy("k").orderBy("ts")))
    assert d.where("tile <> want").count() == 0


def test_partition_count_does_not_matter(spark, series):
    runs = []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        runs.append(by_key(scans.carry_forward(to_spark(spark, series), "k", "ts", {"v": "f"}), "f"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    pd.testing.assert_series_equal(*runs)


def busy_day(n=20_000):
    """One key-day with 90 % of the rows, some stamps shared, and quiet days around it."""
    rng = np.random.default_rng(8)
    us = np.r_[rng.integers(0, 86_400, int(n * 0.9)) * 1_000_000, rng.integers(-40 * 86_400, 40 * 86_400, n // 10) * 1_000_000]
    ts = pd.Timestamp("2024-01-15") + pd.to_timedelta(us, "us")
    return pd.DataFrame({"k": np.where(np.arange(n) % 50 == 0, "quiet", "hot"), "ts": ts, "v": np.where(rng.random(n) < 0.5, np.nan, rng.integers(1, 1000, n) / 8)})


def largest_partition(df):
    return df.groupBy("k", "_chunk").count().agg(F.max("count")).first()[0]


def test_busy_day_is_split_evenly(spark):
    p = busy_day()
    d = scans.with_even_chunks(to_spark(spark, p), ["k"], "ts", rows=500)
    assert 300 < largest_partition(d) < 800
    capped = scans.with_even_chunks(to_spark(spark, p), ["k"], "ts", rows=10, most=20)
    assert len(p) / 40 < largest_partition(capped) < len(p) / 15
    bounds = d.groupBy("k", "_chunk").agg(F.min("ts").alias("a"), F.max("ts").alias("z")).toPandas().sort_values(["k", "a"])
    same = bounds.k.to_numpy()[1:] == bounds.k.to_numpy()[:-1]
    assert (bounds.a.to_numpy()[1:] > bounds.z.to_numpy()[:-1])[same].all()
    assert scans.with_even_chunks(to_spark(spark, p), ["k"], "ts").select(F.count_distinct("k", "_chunk")).first()[0] == p.assign(d=p.ts.dt.date).groupby(["k", "d"]).ngroups


@pytest.mark.parametrize("even", [500, 10**9])
def test_trailing_time_mean(spark, even):
    p = busy_day()
    got = scans.trailing_time_mean(to_spark(spark, p), "k", "ts", "v", 6 * 3600, "m", even=even)
    assert got.columns == ["k", "ts", "v", "m"]
    got = got.toPandas().sort_values(["k", "ts", "v"]).reset_index(drop=True)
    want = []
    for k, g in p.groupby("k"):
        us, v = g.ts.astype("datetime64[us]").astype("int64").to_numpy(), g.v.to_numpy()
        order = np.argsort(us, kind="stable")
        us, v = us[order], v[order]
        total, seen = np.r_[0, np.nancumsum(v)], np.r_[0, np.cumsum(~np.isnan(v))]
        lo, hi = np.searchsorted(us, us - 6 * 3600 * 10**6, "right"), np.searchsorted(us, us, "right")
        with np.errstate(invalid="ignore", divide="ignore"):
            want.append(pd.DataFrame({"k": k, "ts": us, "v": v, "m": (total[hi] - total[lo]) / (seen[hi] - seen[lo])}))
    want = pd.concat(want).sort_values(["k", "ts", "v"]).reset_index(drop=True)
    np.testing.assert_allclose(got["m"].to_numpy(dtype=float), want["m"].to_numpy(), rtol=1e-11)


def test_as_of_over_split_days_is_the_same(spark):
    left, right = busy_day(), busy_day(4000).rename(columns={"v": "w"})
    right = to_spark(spark, right).withColumnRenamed("v", "w")
    plain = scans.as_of(to_spark(spark, left), right, "k", "ts", {"w": "o"})
    split = scans.as_of(to_spark(spark, left), right, "k", "ts", {"w": "o"}, even=300)
    assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0
