"""Names, bins, calendar edges."""
import datetime as dt

from pyspark.sql import functions as F

from slotwise.functions import arrays, calendar as cal, text, weather as wx


def one(d, e):
    return [r[0] for r in d.select(e).collect()]


def test_names(make):
    d = make([("Red Baron – Flyer",), ("Wa-a-y Express",), ("Madame Tortue Curiosités",), ("",), (None,)], "n string")
    assert one(d, text.service_key("n")) == ["red_baron_flyer", "wa_a_y_express", "madame_tortue_curiosités", "unknown_ride", "unknown_ride"]
    assert one(d, text.training_key("n"))[:3] == ["red baron  flyer", "waay express", "madame tortue curiosits"]
    e = make([("The Flying  Dutch – Tour! powered by Gas",)], "n string")
    assert one(e, text.display_key("n")) == ["flying dutch-tour"]


def test_right_closed_bins(make):
    d = make([(0.0,), (0.001,), (1.0,), (2.5,), (100.0,), (101.0,), (None,)], "r double")
    assert one(d, wx.rain_intensity("r")) == [None, "none", "light", "moderate", "extreme", None, None]
    assert one(d, wx.rain_intensity("r", zero_is_none=True))[0] == "none"


def test_same_weekday_last_year(make):
    d = make([(dt.datetime(2020, 2, 29, 10),), (dt.datetime(2021, 3, 1, 9),)], "t timestamp_ntz")
    got = one(d, cal.same_weekday_last_year("t"))
    assert [g.weekday() for g in got] == [5, 0]
    assert got[0] == dt.datetime(2019, 3, 2, 10)


def test_daylight_saving(make):
    d = make([(dt.datetime(2024, 3, 31, 0, 30),), (dt.datetime(2024, 3, 31, 1, 30),), (dt.datetime(2024, 10, 27, 1, 30),)], "t timestamp_ntz")
    assert one(d, cal.to_local("t", "Europe/Zurich")) == [dt.datetime(2024, 3, 31, 1, 30), dt.datetime(2024, 3, 31, 3, 30), dt.datetime(2024, 10, 27, 2, 30)]


def test_cyclic_round_trip_and_unit_circle(spark):
    d = spark.range(1, 13).select(F.make_timestamp_ntz(F.lit(2024), F.col("id").cast("int"), F.lit(9), F.lit(1), F.lit(2), F.lit(0)).alias("t"))
    f = cal.cyclic_features("t")
    r = d.select(F.month("t").alias("m"), cal.inverse_cyclic(f["month_sin"], f["month_cos"], 12, 1).alias("b"), (f["doy_sin"] ** 2 + f["doy_cos"] ** 2).alias("u"))
    assert all(x.m == x.b and abs(x.u - 1) < 1e-12 for x in r.collect())


def test_floor_and_ceil(make):
    d = make([(dt.datetime(2024, 1, 1, 23, 45, 1),), (dt.datetime(2024, 1, 1, 12, 30),)], "t timestamp_ntz")
    assert one(d, cal.ceil_to("t", 30)) == [dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1, 12, 30)]


def test_sequences(make):
    d = make([([1, 2, 3],), ([],), ([1, 2, 3, 4, 5],)], "s array<int>")
    assert one(d, arrays.pad_sequence("s", 4, F.lit(0))) == [[0, 1, 2, 3], [0, 0, 0, 0], [2, 3, 4, 5]]
    assert one(d, arrays.shift_append("s", F.lit(9))) == [[2, 3, 9], [9], [2, 3, 4, 5, 9]]


def test_truth_values(make):
    d = make([("True",), ("false",), ("1",), ("?",), (None,)], "x string")
    assert one(d, wx.truth_int("x")) == [1, 0, 1, None, None]


def test_feature_lists_fail_when_short_and_trim_when_long(make):
    import pytest

    from slotwise.operators.filters import conform_features

    d = make([("Monday", True, 2.5, 7)], "day_of_week string, closed boolean, temperature double, extra int")
    got = conform_features(d, ["closed", "day_of_week", "temperature", "extra"], size=3)
    assert got.columns == ["closed", "day_of_week", "temperature"] and tuple(got.first()) == (1.0, 0.0, 2.5)
    with pytest.raises(ValueError, match="rain"):
        conform_features(d, ["closed", "rain"])


def test_categories_have_no_limit(spark):
    from slotwise.operators.features import categories, one_hot_columns, one_hot_vector

    d = spark.range(20).select(F.col("id").cast("string").alias("k"))
    assert len(categories(d, "k")) == 20
    many = spark.range(3000).selectExpr("CAST(id AS STRING) AS k").union(spark.sql("SELECT CAST(NULL AS STRING)"))
    v = one_hot_vector(many, "k", "v").collect()
    assert len(v) == 3001 and len({int(r.v.indices[0]) for r in v}) == 3001 and all(r.v.values.tolist() == [1.0] for r in v)
    h = one_hot_columns(d, "k")
    assert h.select(sum((F.col(c) for c in h.columns if c != "k"), F.lit(0)).alias("s")).distinct().collect()[0].s == 1


def test_micros_know_no_time_zone(spark):
    from slotwise.columns import micros

    d = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-31 01:30:00' AS a, TIMESTAMP_NTZ'2024-03-31 02:30:00.000001' AS b, CAST(NULL AS TIMESTAMP_NTZ) AS n, TIMESTAMP_NTZ'1969-12-31 23:59:59.5' AS old")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Europe/Zurich"):
            spark.conf.set("spark.sql.session.timeZone", z)
            r = d.select((micros("b") - micros("a")).alias("d"), micros("a").alias("a"), micros("n").alias("n"), micros("old").alias("o")).first()
            assert (r.d, r.a, r.n, r.o) == (3_600_000_001, 1_711_848_600_000_000, None, -500_000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_places_of_one_hot_vectors_are_read_without_filling_them_up(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(i, 1 if i % 2 else 7, i // 2 * 2 + 1) for i in range(4000)] + [(4000, 7, 10**6), (4001, 1, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    d = entry.queries()["fea5_one_hot_vector"](spark, str(tmp_path))
    place = {s: p for p, s in enumerate(sorted({str(s) for _, n, s in rows if n < 7 and s}))}
    assert {(r.l_orderkey, r.l_linenumber): (r.place, r.size) for r in d.collect()} == {(o, n): (place.get(str(s), 2000), 2001) for o, n, s in rows}
    text = d._jdf.queryExecution().optimizedPlan().toString()
    assert "unwrap_udt" in text.lower() or "unwrapudt" in text.lower(), text
    assert "array_position" not in text
