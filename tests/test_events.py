"""Roll-ups, the streamed roll-up, windows finer than a day, and the global shuffle."""

import hashlib
import os
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rollup, shuffle
from tidemark.operators.trailing_time import TimeMeasure, trailing_time, with_trailing_time
from tidemark.streaming import rollup as streamed
from tidemark.streaming.shard_scoring import shard_stream

SCHEMA = "event_id long, ts timestamp, kind string, value double"
START = datetime(2024, 3, 1)


def event(i, hours, kind="a", value=1.0):
    return (i, START + timedelta(hours=hours), kind, value)


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_late_rows_rewrite_their_days_only(spark, tmp_path):
    events = [event(i, 5 * i, "ab"[i % 2], i / 4) for i in range(60)]
    late = [event(100, 30, "c", 7.0), event(101, 31, None, 1.0), (102, None, "a", 1.0), event(103, 200, "a", None)]
    store = rollup.DailyStore(spark, str(tmp_path), "kind", "ts", "value")
    store.take_in(spark.createDataFrame(events, SCHEMA), 0)
    before = files_of(store.daily_path)
    days = store.take_in(spark.createDataFrame(late, SCHEMA), 1)
    assert [d.isoformat() for d in days] == ["2024-03-02"]
    after = files_of(store.daily_path)
    kept = {f for f in before if "day=2024-03-02" not in f}
    assert kept and all(after[f] == before[f] for f in kept)
    assert {f for f in after if f not in before} and all("day=2024-03-02" in f for f in after if f not in before)

    both = spark.createDataFrame(events + late, SCHEMA)
    kind = both.schema["kind"].dataType
    want = sorted(map(tuple, rollup.daily_rollup(both, "kind", "ts", "value").collect()), key=repr)

    def stored():
        return sorted(map(tuple, store.daily(kind).select("day", "entity", "n", "total").collect()), key=repr)

    assert stored() == want
    # The same batch again changes nothing, nor does an empty one.
    store.take_in(spark.createDataFrame(late, SCHEMA), 1)
    assert store.take_in(spark.createDataFrame([], SCHEMA), 2) == []
    assert stored() == want
    plan = store.daily(kind).where("day = date'2024-03-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_streamed_days_come_once_and_late_rows_are_counted(spark, tmp_path):
    raw, out, state = (str(tmp_path / n) for n in ("raw", "out", "state"))
    kind = spark.createDataFrame([], SCHEMA).schema["kind"].dataType

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(raw)
        stream = shard_stream(spark, raw, streamed.shard_schema(spark, raw))
        streamed.start_rollup(streamed.rolled_stream(stream, "kind", "ts", "value"), out, state).awaitTermination()
        return sorted((r.day.day, r.entity, r.n, r.total) for r in rollup.stored_days(spark, out, kind).collect())

    first = arrive([event(i, 6 * i) for i in range(13)])  # four days; the watermark stands at the third's beginning
    assert first == [(1, "a", 4, 4.0), (2, "a", 4, 4.0)]
    before = files_of(out)
    second = arrive([event(20, 3, value=9.0), event(21, 75, "b"), event(22, 130), (23, None, "a", 1.0)])
    assert second[:2] == first and (3, "a", 4, 4.0) in second and len(second) == 5 - (second[-1][0] != 4)
    assert all(files_of(out)[f] == t for f, t in before.items())
    closed = rollup.stored_days(spark, out, kind)
    late = streamed.late_rows(spark.read.parquet(raw), closed, "kind", "ts", "value").where("late > 0").collect()
    assert [(r.day.day, r.arrived, r.counted, r.late) for r in late] == [(1, 5, 4, 1)]


def windows(rows, feed, seconds):
    out = {}
    for key, at in {(r[2], r[1]) for r in rows if r[1] and r[2]}:
        own = [f for f in feed if f[2] == key and f[1] and at - timedelta(seconds=seconds) <= f[1] < at]
        out[key, at] = (len(own), sum(f[3] or 0 for f in own))
    return out


@pytest.mark.parametrize("bucket", [None, 3600, 50_000, 500_000])
def test_trailing_time_against_plain_windows(spark, bucket):
    feed = [event(i, (i * i * 7 % 400) / 3, "abc"[i % 3], i / 8) for i in range(300)] + [(900, None, "a", 1.0), event(901, 2, None), event(902, 5, "a", None)]
    rows = [event(i, i / 2, "abcd"[i % 4]) for i in range(250)] + [event(500, 10, "a"), event(501, 10, "a")]
    measures = [TimeMeasure("n", 86_400), TimeMeasure("v", 86_400, "sum", "value"), TimeMeasure("hour", 3600)]
    got = trailing_time(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(feed, SCHEMA), measures, "kind", "ts", bucket_seconds=bucket).collect()
    day, hour = windows(rows, feed, 86_400), windows(rows, feed, 3600)
    assert len(got) == len(day)
    for r in got:
        assert (r.n, r.hour) == (day[r.kind, r.ts][0], hour[r.kind, r.ts][0]) and r.v == pytest.approx(day[r.kind, r.ts][1])


def test_every_record_is_kept(spark):
    rows = spark.createDataFrame([event(1, 1), event(2, 2), event(2, 2), (3, None, "a", 1.0), event(4, 5, None)], SCHEMA)
    got = with_trailing_time(rows, rows, [TimeMeasure("n", 7200)], "kind", "ts")
    assert sorted((r.event_id, r.n) for r in got.collect()) == [(1, 0), (2, 1), (2, 1), (3, 0), (4, 0)]
    nothing = rows.limit(0)
    assert [r.n for r in with_trailing_time(rows, nothing, [TimeMeasure("n", 7200)], "kind", "ts").collect()] == [0] * 5
    with pytest.raises(ValueError):
        TimeMeasure("v", 60, "sum")


def test_a_busy_entity_is_many_tasks(spark):
    """Two thirds of all rows are one entity's; its windows are worked out in most of the tasks."""
    rows = spark.range(6000).selectExpr(
        "id as event_id", "timestamp_seconds(1700000000 + id * 97) as ts", "if(id % 3 < 2, 'hot', concat('k', id % 40)) as kind", "1.0D as value"
    )
    found = trailing_time(rows, rows, [TimeMeasure("n", 3600)], "kind", "ts")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = found.where("kind = 'hot'").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) >= 6 and max(r["count"] for r in tasks) < 1500


def test_places_are_the_sorted_order_in_any_layout(spark):
    ids = list(range(0, 5000, 3))
    want = {i: p for p, i in enumerate(sorted(ids, key=lambda i: hashlib.md5(f"shuffle:42:{i}".encode()).hexdigest()))}
    for parts in (1, 5):
        rows = spark.createDataFrame([(i,) for i in ids], "k long").repartition(parts)
        found = shuffle.with_places(rows, "k")
        assert {r.k: r.place for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    assert shuffle.with_places(rows, "k", seed=1).where("place = 0").first().k != min(want, key=want.get)
    assert shuffle.with_places(rows.limit(0), "k").isEmpty()


def test_shuffled_shards_hold_consecutive_places(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id as k", "concat('text ', id) as body")
    stored = shuffle.export_shuffled(rows, "k", str(tmp_path / "out"), 300)
    by = defaultdict(list)
    for r in stored.collect():
        assert r.body == f"text {r.k}"
        by[r.shard].append(r.place)
    assert {s: (min(p), max(p), len(p)) for s, p in by.items()} == {0: (0, 299, 300), 1: (300, 599, 300), 2: (600, 899, 300), 3: (900, 999, 100)}
    first = spark.read.parquet(str(tmp_path / "out" / "shard=0"))
    assert [r.place for r in first.collect()] == list(range(300))
