"""Streams against the batch forms, over micro-batches."""

import datetime as dt

import pytest

from framelog.operators import events, quality
from framelog.streaming import frames as S

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def folder(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    for k, ids in enumerate(([0, 1, 5], [6, 9], [10])):
        rows = [(i, at + dt.timedelta(seconds=i), 1 + i % 2 if k == 2 else 1, "view" if i != 6 else "error", float(i), "{}") for i in ids]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return tmp_path


def run(spark, df, folder, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_gaps_across_batches(spark, folder):
    got = run(spark, S.sequence_gaps(S.stream(spark, str(folder / "in"))), folder, "gaps").orderBy("seq").collect()
    assert [(r.seq, r.dropped_before, r.flags) for r in got] == [(0, 0, 0), (1, 0, 0), (5, 3, 4), (6, 0, 1), (9, 2, 4), (10, 0, 0)]


def test_counters_and_latest(spark, folder):
    c = run(spark, S.counters(S.stream(spark, str(folder / "in"))), folder, "counted", "complete").collect()
    assert sum(r.frames for r in c) == 6 and sum(r.driver_errors for r in c) == 1
    slots = run(spark, S.latest(S.stream(spark, str(folder / "in"))), folder, "newest", "complete")
    (r,) = slots.where("generation > 1").collect()
    assert r.generation >= 5 and r.overwritten == r.generation - 1 and r.seq in (9, 10)
    since = spark.createDataFrame([(r.session, r.generation)], "session long, since long")
    assert S.newer_than(slots, since).where(f"session = {r.session}").count() == 0


def test_changes_as_in_batch(spark, tmp_path):
    import random

    rng, at = random.Random(1), dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(seconds=i), 7, "view", rng.choice([10.0, 10.1]) if i < 30 or i % 9 else 90.0, "{}") for i in range(90)]
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # files are taken in the order of their modification; equal times may mix, so one batch is compared
    got = run(spark, S.changes(S.stream(spark, str(tmp_path / "in"), 10), learn=20, settle_ns=3_000_000_000), tmp_path, "changed").orderBy("seq").collect()
    f = spark.createDataFrame([(7, i, i * 10**9, i, round(v * 100), 0) for i, (_, _, _, _, v, _) in enumerate(rows)], "session long, index long, ts_ns long, seq long, length long, flags long")
    want = events.debounced(events.size_changes(f, learn=20), settle_ns=3_000_000_000, count=None).orderBy("seq").collect()
    assert [r.seq for r in got] == [r.seq for r in want] and len(want) > 3


def test_silence(spark, folder):
    df = S.silences(S.stream(spark, str(folder / "in"), 10), 500)
    q = df.writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(folder / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            if spark.table("silent").count():
                break
            q.awaitTermination(0.5)
        assert spark.table("silent").count() >= 1
    finally:
        q.stop()


def test_flag_gap_matches_batch(spark):
    f = spark.createDataFrame([(1, i, i, s, 0, 1) for i, s in enumerate([3, 4, 8])], "session long, index long, ts_ns long, seq long, flags long, length long")
    assert [r.dropped_before for r in quality.sequence_gaps(f).orderBy("index").collect()] == [0, 0, 3]


def test_ingest_is_lossless(spark, folder):
    for _ in range(2):  # a second start finds nothing new
        S.ingest(S.stream(spark, str(folder / "in")), str(folder / "out"), str(folder / "cp-in"), trigger={"availableNow": True}).awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(str(folder / "out")).collect()) == [0, 1, 5, 6, 9, 10]
