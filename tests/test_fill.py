"""Grid and gap filling on awkward cases, and the chained fill against brute force."""
import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from slotwise.operators import fill, grid, quality

K, T, W, C = "ride_name", "timestamp", "wait_time", "closed"
S = f"{K} string, {T} timestamp_ntz, {W} double, {C} boolean"


def day(h, m=0, d=1):
    return dt.datetime(2024, 1, d, h, m)


def test_grid_size_and_no_lost_values(make):
    rows = [("a", day(9, 0), 5.0), ("a", day(9, 3), 15.0), ("b", day(20, 59, 3), 7.0)]
    facts = make(rows, f"{K} string, {T} timestamp_ntz, {W} double")
    g = grid.densify(facts, K, T, W, "09:00", "21:00", 5)
    assert g.count() == 2 * 3 * 145
    assert {(r[0], r[1], r[3]) for r in g.where(f"{W} IS NOT NULL").collect()} == {("a", day(9), 10.0), ("b", day(20, 55, 3), 7.0)}


def test_days_without_data_are_closed(make):
    facts = make([("a", day(10), 5.0), ("a", day(12, 0, 3), 5.0)], f"{K} string, {T} timestamp_ntz, {W} double")
    g = grid.mark_closed(grid.densify(facts, K, T, W, "09:00", "13:00", 60), facts, T)
    opened = {r[0] for r in g.where(f"NOT {C}").select(T).collect()}
    assert opened == {day(10), day(12, 0, 3)}


def test_fill_never_changes_known_values_and_reports_rules(make):
    rows = []
    for d in (1, 8):
        for m in range(0, 60, 10):
            rows.append(("a", day(10, m, d), None if (d == 8 and m < 20) or m == 30 else float(d * 100 + m), False))
    rows.append(("a", day(10, 55, 8), None, True))
    out = {r[T]: (r[W], r.fill_rule) for r in fill.fill_gaps(make(rows, S), K, T, W, C).collect()}
    assert out[day(10, 0, 8)] == (100.0, "prior_period")
    assert out[day(10, 10, 8)] == (110.0, "prior_period")
    assert out[day(10, 30, 8)] == (820.0, "same_bucket")
    assert out[day(10, 20, 8)] == (820.0, "kept")
    assert out[day(10, 55, 8)] == (None, "open")


def test_equidistant_prior_values_take_the_earlier(make):
    rows = [("a", day(10, 0, 1), 1.0, False), ("a", day(10, 20, 1), 2.0, False), ("a", day(10, 10, 8), None, False)]
    out = fill.fill_from_prior_period(make(rows, S), K, T, W, C).where(F.col(T) == F.lit(day(10, 10, 8)).cast("timestamp_ntz"))
    assert out.first()[W] == 1.0


def brute_chain(p):
    p = p.sort_values([K, T]).reset_index(drop=True)
    v = dict(zip(zip(p[K], p[T]), p[W]))
    shut = dict(zip(zip(p[K], p[T]), p[C]))
    for k, t in list(v):
        if shut[k, t] or not np.isnan(v[k, t]):
            continue
        start = t.replace(minute=0)
        hour = [start + dt.timedelta(minutes=m) for m in range(60)]
        before = [x for x in hour if x < t and (k, x) in v and not shut[k, x] and not np.isnan(v[k, x])]
        if before:
            v[k, t] = v[k, before[-1]]
            continue
        week = dt.timedelta(days=7)
        known = [x - week for x in hour if (k, x - week) in v and not shut[k, x - week] and not np.isnan(v[k, x - week])]
        if known:
            v[k, t] = v[k, min(known, key=lambda x: (abs(x + week - t), x))]
    return v


def test_chained_fill_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    stamps = [dt.datetime(2024, 1, 1) + dt.timedelta(days=d, minutes=m) for d in range(35) for m in range(9 * 60, 12 * 60, 15)]
    p = pd.DataFrame([(k, t) for k in ("a", "b") for t in stamps], columns=[K, T])
    p[W] = np.where(rng.random(len(p)) < 0.55, np.nan, rng.integers(0, 90, len(p)).astype(float))
    p[C] = rng.random(len(p)) < 0.1
    rows = [(k, t.to_pydatetime(), None if np.isnan(w) else float(w), bool(c)) for k, t, w, c in p.itertuples(index=False)]
    got = fill.fill_gaps_chained(spark.createDataFrame(rows, S), K, T, W, C).collect()
    want = brute_chain(p)
    assert len(got) == len(p)
    for r in got:
        x = want[r[K], pd.Timestamp(r[T])]
        assert (r[W] is None and np.isnan(x)) or r[W] == x


def test_zero_denominator_means_drop(make):
    rows = [("a", day(10), None, False), ("a", day(11), None, False), ("b", day(10), 5.0, False), ("b", day(11), None, False)]
    s = {r[K]: (r.missing_pct, r["drop"]) for r in quality.missing_day_stats(make(rows, S), K, T, W, C, max_pct=150).collect()}
    assert s == {"a": (None, True), "b": (100.0, False)}


def test_null_runs_stop_at_entity_borders(make):
    rows = [("a", day(10), 1.0), ("a", day(11), None), ("b", day(9), None), ("b", day(10), None), ("b", day(11), 2.0)]
    r = quality.null_runs(make(rows, f"{K} string, {T} timestamp_ntz, {W} double"), K, T, W)
    assert {tuple(x) for x in r.collect()} == {("a", 1, 1), ("b", 2, 1)}


def test_rounding_half_to_even(make):
    d = make([(2.5,), (7.5,), (12.5,), (17.5,), (None,)], "w double")
    assert [r[0] for r in d.select(quality.round_to("w", 5)).collect()] == [0.0, 10.0, 10.0, 20.0, None]


def test_smooth_interpolation_stays_between_known_values(make):
    """Gaps on either side of a peak, a plateau and single values; nothing overshoots, known values stay."""
    v = {0: 10.0, 4: 20.0, 9: 20.0, 10: 5.0, 20: 6.0}
    rows = [("a", day(9) + dt.timedelta(minutes=5 * (i - 2)), v.get(i - 2)) for i in range(27)] + [("one", day(9), 3.0), ("one", day(10), None), ("none", day(9), None)]
    out = grid.interpolate_smooth(make(rows, f"{K} string, {T} timestamp_ntz, {W} double").repartition(5), K, T, [W])
    got = {(r[0], r[1]): r[2] for r in out.collect()}
    a = [got["a", day(9) + dt.timedelta(minutes=5 * (i - 2))] for i in range(27)]
    assert a[:2] == [None, None] and a[23:] == [6.0] * 4
    for (i, x), (j, y) in zip(list(v.items())[:-1], list(v.items())[1:]):
        part = a[i + 2 : j + 3]
        assert part[0] == x and part[-1] == y and sorted(part, reverse=x > y) == part
    assert len(set(a[6:12])) == 1 and got["one", day(10)] == 3.0 and got["none", day(9)] is None
    assert out.columns == [K, T, W]
