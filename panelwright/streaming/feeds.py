"""Feeds as Structured Streaming jobs: late rows refused with a reason, write-once logs, first and last seen,
alerts with a cooldown, freshness, and event-time windows.

Each function takes and gives a DataFrame that streams or not; `drain` runs a stream over all that is there
and gives the table that it wrote.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..sources.work import work_folder
from ..sources.writers import anti_by, first_of


#: The state store that keeps timers.
TIMERS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The Parquet file or files at a path as a stream; read through a pattern, as a stream takes no single file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, mode: str = "append", keep: Callable[[DataFrame | None, DataFrame], DataFrame] | None = None, store: str | None = None) -> DataFrame:
    """What the stream writes once it has read all there is now, as a table.

    append: the rows of every batch, or what keep(table so far, batch) leaves of them. complete: the last batch.
    Batches are written to folders of their own by their number, so that a batch which is run again replaces
    its own rows only, and no batch writes what others have written. store names the provider of its state.
    """
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession, "stream")
    last = {"id": -1}
    so_far = lambda n: spark.read.schema(stream.schema).parquet(*(f"{folder}/rows/n={i}" for i in range(n))) if n else None

    def put(batch: DataFrame, batch_id: int) -> None:
        batch = batch if keep is None else keep(so_far(batch_id), batch)
        batch.write.mode("overwrite").parquet(f"{folder}/rows/n={batch_id}")
        last["id"] = batch_id

    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, store or before)  # is read when the query starts
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    finally:
        spark.conf.set(setting, before)
    query.awaitTermination()
    if last["id"] < 0:
        return spark.createDataFrame([], stream.schema)
    return so_far(last["id"] + 1) if mode == "append" else spark.read.schema(stream.schema).parquet(f"{folder}/rows/n={last['id']}")


def with_refusal(df: DataFrame, as_of: Column, today: Column) -> DataFrame:
    """df with refused: why a row may not be written any more (null if it may)."""
    return df.withColumn("refused", F.when(as_of.isNull(), "undated").when(as_of < today, "late"))


def write_once(stream: DataFrame, key: list[str], order: str) -> DataFrame:
    """The log in which the first row of each key stays, whatever comes later; drained. A batch adds its own first rows
    of the keys that the log lacks, and leaves the log as it is."""
    return drain(stream, keep=lambda log, batch: first_of(batch if log is None else anti_by(batch, log, key), key, order))


def append_once(stream: DataFrame, day: str, key: list[str], late: str = "3 days") -> DataFrame:
    """The first row of each key and day, the day a timestamp; rows later than `late` are dropped, and so is the state
    of days before that. Drained."""
    once = stream.withWatermark(day, late).dropDuplicates([day, *key])
    return drain(once)


def windows_of(schedule: DataFrame, at: str, boundary: str = "15:00", lead_minutes: int = 60) -> DataFrame:
    """(day, name, kickoff, opens, games) of each day's early and late games: the first start of each, when reading
    becomes worth while, and how many start with it."""
    day, clock = F.to_date(at).alias("day"), F.date_format(at, "HH:mm")
    rows = schedule.select(day, F.when(clock >= boundary, "late").otherwise("early").alias("name"), F.col(at).alias("start"))
    first = F.min("start").over(Window.partitionBy("day", "name"))
    out = rows.withColumn("kickoff", first).where("start = kickoff").groupBy("day", "name", "kickoff").agg(F.count("*").alias("games"))
    return out.select("day", "name", "kickoff", (F.col("kickoff") - F.expr(f"interval {lead_minutes} minutes")).alias("opens"), "games")


def locked(stream: DataFrame, at: str, windows: DataFrame) -> DataFrame:
    """The rows of a stream with the window of their day that is open then, if any: from its opening to its kickoff,
    and how many windows of the day have kicked off. A stream-static join; a day has two windows at most."""
    early, late = (windows.where(F.col("name") == n).select(F.col("day").alias("__day"), F.col("opens").alias(f"__{n}_opens"), F.col("kickoff").alias(f"__{n}_kickoff")) for n in ("early", "late"))
    met = stream.withColumn("__day", F.to_date(at)).join(early, "__day", "left").join(late, "__day", "left")
    is_open = lambda n: (F.col(at) >= F.col(f"__{n}_opens")) & (F.col(at) < F.col(f"__{n}_kickoff"))
    begun = sum((F.coalesce((F.col(at) >= F.col(f"__{n}_kickoff")).cast("int"), F.lit(0)) for n in ("early", "late")), F.lit(0))
    return met.select(*stream.columns, F.when(is_open("early"), "early").when(is_open("late"), "late").alias("window"), begun.alias("begun"))


def seen(df: DataFrame, key: list[str], at: str) -> DataFrame:
    """(key, first_seen, last_seen, times_seen)."""
    return df.groupBy(*key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("times_seen"))


class _Alerts(StatefulProcessor):
    """What alerts keeps of a key: when its items and reasons were last new and when it last raised an alert, and an
    event-time timer for when the oldest of these is out of date.

    All of it is one value as long as the key has at most `together` entries, read and written once for a key's rows. More
    move to maps of their own, which are asked for single entries, so that a key's next rows cost what they are."""

    def __init__(self, cooldown: int, keep: int, together: int = 256):
        self.cooldown, self.keep, self.together = cooldown, keep, together

    def init(self, handle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "last long, moved boolean, items array<long>, items_at array<long>, reasons array<string>, reasons_at array<long>")
        self.items = handle.getMapState("items", "item long", "at long")
        self.reasons = handle.getMapState("reasons", "reason string", "at long")

    def _read(self) -> tuple:
        """(last, whether there are entries in the maps, items, reasons) of the key; None as last if it has no state."""
        got = self.recent.get()
        return (None, False, {}, {}) if got is None else (got[0], got[1], dict(zip(got[2], got[3])), dict(zip(got[4], got[5])))

    def _write(self, last: int, moved: bool, items: dict, reasons: dict) -> None:
        if len(items) + len(reasons) > self.together:
            for state, own in ((self.items, items), (self.reasons, reasons)):
                for k, at in own.items():
                    state.updateValue((k,), (at,))
            moved, items, reasons = True, {}, {}
        self.recent.update((last, moved, list(items), list(items.values()), list(reasons), list(reasons.values())))

    def _settle(self, before: int) -> None:
        """Forgets what is not after `before` and sets the timer for what is next to go; a key of which nothing is left
        has no state. It alone reads all of a key's state."""
        last, moved, items, reasons = self._read()
        items, reasons = ({k: at for k, at in own.items() if at > before} for own in (items, reasons))
        left, there = [*items.values(), *reasons.values()], False
        for state, own in ((self.items, items), (self.reasons, reasons)):
            for k, (at,) in list(state.iterator()) if moved else ():
                if at <= before:
                    state.removeKey(k)
                else:
                    there = True
                    left += [] if k[0] in own else [at]
        if left:
            self._write(last, there, items, reasons)
            self.handle.registerTimer((min(left) + self.keep) // 1000 + 1)
        else:
            for state in (self.recent, self.items, self.reasons):
                state.clear()

    def _known(self, own: dict, state, moved: bool, k, now: int) -> bool:
        at = own.get(k)
        if at is None and moved and state.containsKey((k,)):
            at = state.getValue((k,))[0]
        return at is not None and at > now - self.keep

    def handleInputRows(self, key, rows, timerValues):
        (last, moved, items, reasons), first = self._read(), None
        oldest = timerValues.getCurrentWatermarkInMs() * 1000
        for row in sorted(rows, key=lambda r: (r.at, r.item)):
            now = row.at
            if now < oldest or self._known(items, self.items, moved, row.item, now):
                continue
            if last is not None and now - last < self.cooldown and self._known(reasons, self.reasons, moved, row.reason, now):
                continue
            items[row.item] = reasons[row.reason] = now
            last, first = now, now if first is None else first
            yield Row(key=key[0], at=now, item=row.item, reason=row.reason)
        if first is not None:
            self._write(last, moved, items, reasons)
            if not any(True for _ in self.handle.listTimers()):  # else it goes off before the new rows are out of date
                self.handle.registerTimer((first + self.keep) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._settle(expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.keep)
        yield from ()


def alerts(df: DataFrame, key: str, at: str, item: str, reason: str, cooldown_hours: float = 12.0, keep_hours: float = 504.0, most_hours: float | None = 36.0) -> DataFrame:
    """(key, at, item, reason) of the rows of a stream that raise an alert; at a timestamp in the session's zone.

    An item raises one once. After an alert of a key, another within the cooldown needs a reason that has not
    raised one of the key within keep_hours. Rows more than most_hours older than the newest of earlier batches are no
    news and are dropped (None: as old as keep_hours). Rows of one batch are taken in order of time, then item.
    What is keep_hours old goes by a timer once the watermark has passed, so that keys that fall silent leave no state. Null keys are one key; rows without a time, an item or a reason are left out.
    drain takes this with store=TIMERS.
    """
    processor = _Alerts(int(cooldown_hours * 3.6e9), int(keep_hours * 3.6e9))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(at).cast("timestamp").alias("when"), F.col(item).cast("long").alias("item"), F.col(reason).cast("string").alias("reason"))
    rows = rows.where(F.col("when").isNotNull() & F.col("item").isNotNull() & F.col("reason").isNotNull()).withColumn("at", F.unix_micros("when"))
    rows = rows.withWatermark("when", f"{int((keep_hours if most_hours is None else most_hours) * 3600)} seconds")
    found = rows.groupBy("key").transformWithState(processor, "key long, at long, item long, reason string", "append", "eventtime")
    return found.select(F.col("key").alias(key), F.timestamp_micros("at").alias(at), F.col("item").alias(item), F.col("reason").alias(reason))


class _Counts(StreamingQueryListener):
    """The observed counts of each batch of one query."""

    def __init__(self, name: str):
        self.name, self.run, self.batches, self.ended = name, None, {}, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if self.name in progress.observedMetrics:
            self.batches[progress.batchId] = progress.observedMetrics[self.name].asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def refusals(stream: DataFrame, as_of: Column, today: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of a stream that may be written, drained, and (batch, reason, n): how many of each batch were taken and
    refused for each reason, as the stream's own metrics. The counts are observed while the rows pass, so no row is read
    again for them, and a listener takes them up batch by batch; a batch that is run again counts once."""
    spark, name = stream.sparkSession, f"refusals-{uuid.uuid4().hex}"
    seen_rows = with_refusal(stream, as_of, today).observe(name, *(F.count_if(F.col("refused") == why).alias(why) for why in ("undated", "late")), F.count_if(F.col("refused").isNull()).alias("taken"))
    listener = _Counts(name)
    spark.streams.addListener(listener)
    try:
        rows = drain(seen_rows.where("refused is null").drop("refused"))
        listener.ended.wait(60)
    finally:
        spark.streams.removeListener(listener)
    counts = [(batch, why, n) for batch, row in sorted(listener.batches.items()) for why, n in sorted(row.items())]
    return rows, spark.createDataFrame(counts, "batch long, reason string, n long")


def freshness(df: DataFrame, feed: str, at: str, now: Column, stale_hours: float) -> DataFrame:
    """(feed, age_hours, verdict) of each feed: unknown without a time, stale over so many hours, else fresh."""
    newest = df.groupBy(feed).agg(F.max(at).alias("newest"))
    age = F.timestamp_diff("SECOND", F.col("newest"), now) / 3600
    verdict = F.when(F.col("newest").isNull(), "unknown").when(age > stale_hours, "stale").otherwise("fresh")
    return newest.select(feed, age.alias("age_hours"), verdict.alias("verdict"))


def tumbling(df: DataFrame, at: str, width: str, late: str, key: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates by key and window of event time; rows later than `late` are dropped from a stream."""
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width), *key).agg(*aggregates)


def sessions(df: DataFrame, at: str, gap: str, late: str, key: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates by key and session: rows less than a gap apart."""
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.session_window(at, gap), *key).agg(*aggregates)
