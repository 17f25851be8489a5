"""Stored tables and the streaming path."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from slotwise.columns import wall_clock
from slotwise.plans.q_sources import snapshots
from slotwise.session import shared_folder
from slotwise.sources import store
from slotwise.streaming import ingest

K, T, W = "ride_name", "timestamp", "wait_time"
S = f"{K} string, {T} timestamp_ntz, {W} double"


def at(d, h):
    return dt.datetime(2024, 1, d, h)


def test_last_write_wins_and_retry_is_idempotent(spark, make):
    root = shared_folder(spark, "s")
    store.upsert(make([("a", at(1, 9), 1.0), ("a", at(2, 9), 2.0)], S), root, K, T, 0)
    for _ in range(2):
        store.upsert(make([("a", at(2, 9), 5.0), ("b", at(2, 9), None)], S), root, K, T, 1)
    got = {(r[K], r[T]): r[W] for r in store.read_store(spark, root, K, T).collect()}
    assert got == {("a", at(1, 9)): 1.0, ("a", at(2, 9)): 5.0, ("b", at(2, 9)): None}
    assert store.read_store(spark, root, K, T, "2024-01-02", "2024-01-02").count() == 2
    new = shared_folder(spark, "s")
    store.compact(spark, root, new, K, T, cutoff="2024-01-02 00:00:00")
    assert store.read_store(spark, new, K, T).count() == 2


def test_writers_that_share_numbers_lose_nothing(spark, make):
    root = shared_folder(spark, "s")
    for who, ride in (("a", "x"), ("b", "y"), ("c", "x")):
        store.upsert(make([(ride, at(1, 9), float(ord(who))), (who, at(2, 9), 1.0)], S), root, K, T, 0, writer=who)
    got = {(r[K], r[T]): r[W] for r in store.read_store(spark, root, K, T).collect()}
    assert got == {("x", at(1, 9)): 99.0, ("y", at(1, 9)): 98.0, **{(w, at(2, 9)): 1.0 for w in "abc"}}


def test_retry_drops_dates_it_lost_and_keeps_its_place(spark, make):
    root = shared_folder(spark, "s")
    store.upsert(make([("a", at(1, 9), 1.0), ("a", at(2, 9), 1.0)], S), root, K, T, 7, writer="a")
    store.upsert(make([("a", at(1, 9), 2.0)], S), root, K, T, 1, writer="b")
    store.upsert(make([("a", at(1, 9), 3.0), ("a", at(3, 9), 3.0)], S), root, K, T, 7, writer="a")
    rows = lambda: {(r[T], r[W]) for r in store.read_store(spark, root, K, T).collect()}
    assert rows() == {(at(1, 9), 2.0), (at(3, 9), 3.0)}
    store.upsert(make([("a", at(1, 9), 4.0)], S), root, K, T, 7, writer="a", keep_order=False)
    assert rows() == {(at(1, 9), 4.0)}


def test_equal_keys_in_a_batch_have_one_answer(spark, make):
    for order in (1, -1):
        root = shared_folder(spark, "s")
        store.upsert(make([("a", at(1, 9), v) for v in (1.0, 5.0, 3.0)][::order], S), root, K, T, 0)
        assert [r[W] for r in store.read_store(spark, root, K, T).collect()] == [5.0]


def test_writer_names_must_read_back_as_text(spark, make):
    for name in ("1", "", "a/b", "NaN"):
        with pytest.raises(ValueError):
            store.upsert(make([("a", at(1, 9), 1.0)], S), shared_folder(spark, "s"), K, T, 0, writer=name)


def test_retention_in_place(spark, make):
    root = shared_folder(spark, "s")
    for i in range(3):
        store.upsert(make([("a", at(d, h), float(i)) for d in range(1, 6) for h in range(9, 12) if (d + h + i) % 2], S), root, K, T, i)
    store.upsert(make([("a", at(3, 9), 9.0)], S), root, K, T, 9)
    before = {(r[T], r[W]) for r in store.read_store(spark, root, K, T).collect()}
    files = lambda: {r.f for r in spark.read.parquet(root).where("date > '2024-01-03'").select(F.input_file_name().alias("f")).distinct().collect()}
    later = files()
    for _ in range(2):
        store.retain(spark, root, K, T, "2024-01-03 10:30:00")
        assert {(r[T], r[W]) for r in store.read_store(spark, root, K, T).collect()} == {x for x in before if x[0] >= dt.datetime(2024, 1, 3, 10, 30)}
        assert files() == later
    assert {r.d for r in spark.read.parquet(root).select(F.col("date").cast("string").alias("d")).distinct().collect()} == {"2024-01-03", "2024-01-04", "2024-01-05"}
    assert spark.read.parquet(root).where("batch_id = 9").count() == 0


def test_span_reads_only_its_days(spark, make):
    root = shared_folder(spark, "s")
    store.upsert(make([("a", at(d, h), 1.0) for d in range(1, 8) for h in range(9, 12)], S), root, K, T, 0)
    d = store.read_span(spark, root, K, T, "a", "2024-01-03 10:00:00", 24)
    assert sorted(r[T] for r in d.collect()) == [at(3, 10), at(3, 11), at(4, 9)]
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_stream_over_two_deliveries_equals_batch(spark):
    """The same files twice, drained in two runs of one query, leave every reading once."""
    from slotwise.sources.stand_ins import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    land, root, ck = (shared_folder(spark, n) for n in ("land", "root", "ck"))
    docs = snapshots(t.events)
    for _ in range(2):
        docs.write.mode("append").json(land)
        q = ingest.to_store(ingest.open_readings(ingest.read_snapshots(spark, land)), root, ck)
        q.awaitTermination()
    n = docs.where("status.http_code = 200")
    want = t.events.where("value >= 5 AND floor(event_id / 40) % 11 <> 5").count()
    assert n.count() > 0 and store.read_store(spark, root, K, T).count() == want


def test_json_dimension_document(spark, tmp_path):
    from slotwise.sources.readers import read_dimension_json

    p = tmp_path / "dim.json"
    p.write_text('{"attractions_features": [{"name": "A", "category": "water", "min_age": 4, "max_speed": null}, {"name": "B", "max_height": 73.5}]}')
    rows = {r.name: r for r in read_dimension_json(spark, str(p), "attractions_features").collect()}
    assert rows["A"].min_age == 4 and rows["A"].max_speed is None and rows["B"].max_height == 73.5


def test_bad_snapshots_give_no_rows(spark, make):
    from slotwise.sources.payloads import flatten_snapshot

    d = spark.createDataFrame(
        [((200,), '{"lands": [], "rides": []}'), ((200,), "no json"), ((200,), '{"lands": [{"name": "x"}], "rides": [{"id": 1, "name": "R", "is_open": true, "wait_time": 5, "last_updated": "nonsense"}]}')],
        "status struct<http_code:int>, contents string",
    )
    assert [(r.ride_name, r.timestamp) for r in flatten_snapshot(d).collect()] == [("R", None)]
    assert flatten_snapshot(d).where(F.col("land").isNotNull()).count() == 0


def shuffled_files(spark, n):
    """A landing folder of ``n`` files, each with snapshots of all times, every file twice; and the readings in it."""
    from slotwise.sources.stand_ins import Tables

    land = shared_folder(spark, "land")
    docs = snapshots(Tables(spark, "/root/testdata/sf0.001").events).repartition(n, F.xxhash64("contents"))
    for _ in range(2):
        docs.write.mode("append").json(land)
    return land, ingest.readings(docs)


def means_of(live, length, slide):
    w = F.window(F.col(T).cast("timestamp"), f"{length} minutes", f"{slide} minutes")["start"].cast("timestamp_ntz")
    rows = live.groupBy(K, w.alias(T)).agg(F.avg(W).alias(W), F.count("*").alias("n")).collect()
    return {(r[K], r[T]): (round(r[W], 9), r.n) for r in rows}


def test_means_are_exact_over_shuffled_and_repeated_files_and_a_new_checkpoint(spark):
    land, live = shuffled_files(spark, 3)
    root = shared_folder(spark, "exact")
    kinds = {"half": (30, 30), "long": (360, 30)}
    for _ in range(2):
        stream = ingest.readings(ingest.read_snapshots(spark, land, 1))
        q = ingest.keep_exact(stream, root, shared_folder(spark, "ck"), kinds)
        q.awaitTermination()
        assert len(q.recentProgress) >= 6
        stored = store.read_store(spark, f"{root}/readings", K, T)
        assert sorted((r[K], r[T], r[W]) for r in stored.collect()) == sorted((r[K], r[T], r[W]) for r in live.collect())
        for name, (length, slide) in kinds.items():
            got = store.read_store(spark, f"{root}/{name}", K, T).collect()
            assert {(r[K], r[T]): (round(r[W], 9), r.data_points) for r in got} == means_of(live, length, slide)


def test_recent_state_forgets_idle_rides_and_ignores_old_intervals(spark, tmp_path):
    own, land = ingest.state_session(spark), tmp_path / "land"
    land.mkdir()
    out, ck = shared_folder(spark, "state"), shared_folder(spark, "ck")

    def send(i, *rows):
        rides = [{"id": 1, "name": n, "is_open": True, "wait_time": w, "last_updated": s} for n, s, w in rows]
        (land / f"{i}.json").write_text(json.dumps({"status": {"http_code": 200}, "contents": json.dumps({"lands": [], "rides": rides})}))
        s = ingest.recent_state(ingest.readings(ingest.read_snapshots(own, str(land), 1)), keep=2, idle=dt.timedelta(seconds=idle))
        ingest.to_files(s, out, ck).awaitTermination()
        return {(r[K], str(r[T])[5:16]): (r[W], r.data_points) for r in ingest.latest_state(spark.read.parquet(out)).collect()}

    idle = 3600
    got = send(1, ("A", "2024-01-01T09:05:00", 10), ("A", "2024-01-01T10:05:00", 20), ("A", "2024-01-01T11:05:00", 30))
    assert got == {("A", "01-01 10:00"): (20.0, 1), ("A", "01-01 11:00"): (30.0, 1)}
    got = send(2, ("A", "2024-01-01T09:10:00", 99), ("A", "2024-01-01T10:20:00", 40), ("A", "2024-01-01T11:05:00", 30), ("B", "2024-01-01T09:00:00", 1))
    assert got == {("A", "01-01 10:00"): (30.0, 2), ("A", "01-01 11:00"): (30.0, 1), ("B", "01-01 09:00"): (1.0, 1)}
    idle = 0
    send(3, ("B", "2024-01-01T09:40:00", 3))
    send(4, ("C", "2024-01-01T09:00:00", 5))  # B's timer has run out
    got = send(5, ("B", "2024-01-01T12:00:00", 7))
    assert got[("B", "01-01 12:00")] == (7.0, 1) and [k for k in got if k[0] == "B"] == [("B", "01-01 12:00")]
    assert got[("A", "01-01 10:00")] == (30.0, 2)


def test_stamps_do_not_depend_on_the_session_time_zone(spark):
    from slotwise.sources.stand_ins import Tables

    docs = snapshots(Tables(spark, "/root/testdata/sf0.001").events)
    want = sorted((r[K], r[T]) for r in ingest.readings(docs).collect())
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        d = ingest.open_readings(docs)
        again = sorted((r[K], r[T]) for r in d.select(K, wall_clock(F.col("event_time")).alias(T)).collect())
        instants = d.agg(F.min(F.unix_micros("event_time")).alias("us")).first().us
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    first = min(t for _, t in want)
    assert again == want and instants == (first - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def test_late_snapshots_reach_the_store_by_backfill(spark):
    """A delivery far behind the watermark is dropped by the stream and repaired in batch."""
    from slotwise.sources.stand_ins import Tables

    e = Tables(spark, "/root/testdata/sf0.001").events
    cut = F.lit(dt.datetime(2024, 1, 15)).cast("timestamp_ntz")
    land, root, ck = (shared_folder(spark, n) for n in ("land", "root", "ck"))

    def run():
        s = ingest.tumbling_mean(ingest.open_readings(ingest.read_snapshots(spark, land)))
        ingest.to_store(s, root, ck, "update").awaitTermination()

    for part in (e.where(F.col("ts") >= cut), e.where(F.col("ts") < cut)):
        snapshots(part).write.mode("append").json(land)
        run()
    before = store.read_store(spark, root, K, T)
    assert before.where(F.col(T) < F.lit(dt.datetime(2024, 1, 14, 22)).cast("timestamp_ntz")).count() == 0
    ingest.backfill_intervals(spark, land, root, 1000, "2024-01-01", "2024-01-31")
    got = {(r[K], r[T]): (round(r[W], 9), r.data_points) for r in store.read_store(spark, root, K, T).collect()}
    ok = snapshots(e.where(F.col("ts") >= cut)).unionByName(snapshots(e.where(F.col("ts") < cut)))
    live = ingest.open_readings(ok)
    want = live.groupBy(K, F.window("event_time", "30 minutes")["start"].cast("timestamp_ntz").alias(T)).agg(F.avg(W).alias(W), F.count("*").alias("n"))
    assert got == {(r[K], r[T]): (round(r[W], 9), r.n) for r in want.collect()}
