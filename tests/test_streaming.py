"""Streams over several files give what one batch gives, and state carries over from batch to batch."""

import datetime
import random
import time

from pyspark.sql import Row
from pyspark.sql import functions as F

from panelwright.plans import catalog
from panelwright.streaming import feeds


def test_write_once_over_several_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    for k, rows in enumerate(([(1, 5), (1, 4), (2, 9)], [(1, 1), (3, 2)], [(2, 0)])):
        spark.createDataFrame(rows, "k long, n long").coalesce(1).write.mode("append").parquet(path)
    out = feeds.write_once(feeds.stream_table(spark, path, 1), ["k"], "n")
    assert {r.k for r in out.collect()} == {1, 2, 3} and out.count() == 3
    assert feeds.write_once(feeds.stream_table(spark, path), ["k"], "n").orderBy("k").collect() == [(1, 1), (2, 0), (3, 2)]


HOUR = datetime.timedelta(hours=1)


def plain_alerts(batches, cooldown=12.0, keep=504.0, most=36.0):
    """Alerts of batches of (user, time, item, reason), row by row."""
    out, known, since, last, newest = [], {}, {}, {}, None
    for rows in batches:
        oldest = None if newest is None else newest - most * HOUR
        for user, ts, item, why in sorted(rows, key=lambda r: (r[1], r[2])):
            old = lambda d, k: k not in d or d[k] <= ts - keep * HOUR  # noqa: B023, E731
            if oldest is not None and ts < oldest or not old(known, (user, item)):
                continue
            if user in last and ts - last[user] < cooldown * HOUR and not old(since, (user, why)):
                continue
            known[user, item], since[user, why], last[user] = ts, ts, ts
            out.append((user, ts, item, why))
        newest = max([r[1] for r in rows] + ([newest] if newest else []))
    return sorted(out)


def test_alerts_equal_a_plain_loop(spark, sf):
    rows = [(r.user_id, r.ts, r.event_id, r.event_type) for r in spark.read.parquet(f"{sf}/events.parquet").collect()]
    got = sorted(tuple(r) for r in catalog.queries()["sm03_alerts"](spark, sf).collect())
    assert got == plain_alerts([rows]) and 0 < len(got) < len(rows)


def batched(spark, path, batches, schema):
    """A stream of a file for each batch, in their order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)  # files are taken by their time
    return feeds.stream_table(spark, path, 1)


def test_alerts_over_batches_drop_old_news_and_forget_silent_keys(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 3, 1) + h * HOUR
    batches = [
        [(1, at(0), 10, "a"), (1, at(1), 11, "a"), (1, at(2), 12, "b"), (2, at(0), 20, "a"), (3, at(0), 30, "a")],
        [(1, at(14.5), 13, "a"), (1, at(14.5), 10, "c"), (2, at(50), 21, "a"), (1, None, 15, "a"), (1, at(50), 16, None)],
        [(1, at(13), 14, "d"), (2, at(14.5), 22, "z"), (2, at(51), 20, "z"), (4, at(51), 40, "a")],
        [(2, at(300), 20, "a"), (2, at(301), 23, "q")],
        [(2, at(302), 24, "a"), (2, at(320), 23, "a")],
    ]
    stream = batched(spark, str(tmp_path / "in"), batches, "k long, at timestamp, item long, why string")
    states = []

    def put(batch, number):
        batch.write.mode("overwrite").parquet(str(tmp_path / f"out/n={number}"))

    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, feeds.TIMERS)
    try:
        query = feeds.alerts(stream, "k", "at", "item", "why", keep_hours=100).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(put).start()
    finally:
        spark.conf.set(setting, before)
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    got = sorted((r.k, r.at, r.item, r.why) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    known = [[r for r in rows if r[1] is not None and r[3] is not None] for rows in batches]
    assert got == plain_alerts(known, keep=100)
    assert (1, at(13), 14, "d") not in got and (2, at(300), 20, "a") in got
    assert states[-1] < max(states)  # what keys 1, 3 and 4 left is gone, though they never spoke again


def test_refusals_are_counted_batch_by_batch(spark, tmp_path):
    day = datetime.datetime(2024, 1, 10)
    batches = [[(1, day), (2, day - HOUR), (3, None)], [(4, day + HOUR), (5, day)], [(6, day - HOUR), (7, day - HOUR)]]
    stream = batched(spark, str(tmp_path / "in"), batches, "id long, at timestamp_ntz")
    rows, counts = feeds.refusals(stream, F.col("at"), F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00")))
    assert sorted(r.id for r in rows.collect()) == [1, 4, 5] and rows.columns == ["id", "at"]
    per = {}
    for r in counts.collect():
        if r.n:
            per.setdefault(r.batch, {})[r.reason] = r.n
    assert [per[b] for b in sorted(per)] == [{"taken": 1, "late": 1, "undated": 1}, {"taken": 2}, {"late": 2}]


class _Handle:
    """State in memory that counts the calls made of it."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def getValueState(self, name, schema):
        handle = self

        class Value:
            def get(self):
                handle.calls += 1
                return getattr(self, "value", None)

            def exists(self):
                return self.get() is not None

            def update(self, value):
                handle.calls, self.value = handle.calls + 1, value

            def clear(self):
                handle.calls, self.value = handle.calls + 1, None

        return Value()

    def getMapState(self, name, key, value):
        handle, own = self, {}

        class Map:
            def __getattr__(self, call):
                handle.calls += 1
                return {"containsKey": own.__contains__, "getValue": own.__getitem__, "updateValue": own.__setitem__, "removeKey": own.pop, "iterator": lambda: iter(list(own.items())), "clear": own.clear}[call]

        return Map()

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


class _Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_alerts_ask_the_state_once_for_a_key_and_its_rows(spark):
    start = datetime.datetime(2024, 3, 1)
    draw = random.Random(7)
    batches = [[(1, start + datetime.timedelta(minutes=40 * (200 * b + i) + draw.randrange(40)), draw.randrange(2500), draw.choice("abcde")) for i in range(200)] for b in range(6)]
    micros = lambda t: (t - start) // datetime.timedelta(microseconds=1)
    wanted = plain_alerts(batches, keep=100)
    assert len(wanted) > 50
    for together in (256, 3):  # as one value, and moved to the maps
        handle, got, most, newest = _Handle(), [], 0, None
        processor = feeds._Alerts(int(12 * 3.6e9), int(100 * 3.6e9), together)
        processor.init(handle)
        for rows in batches:
            water, before = 0 if newest is None else max(0, (newest - int(36 * 3.6e9)) // 1000), handle.calls
            got += processor.handleInputRows((1,), iter([Row(at=micros(t), item=i, reason=w) for _, t, i, w in rows]), _Clock(water))
            most, newest = max(most, handle.calls - before), max(micros(r[1]) for r in rows)
            for at in [t for t in handle.timers if t <= (newest - int(36 * 3.6e9)) // 1000]:
                handle.timers.remove(at)
                list(processor.handleExpiredTimer((1,), None, _Clock(at)))
        assert [(r.at, r.item, r.reason) for r in got] == [(micros(t), i, w) for _, t, i, w in wanted]
        assert together == 3 or most <= 4  # 200 rows
