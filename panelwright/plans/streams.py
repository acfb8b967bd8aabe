"""Queries of feeds: events as a stream, drained, and the table that it leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.readers import table
from ..streaming import feeds as op
from .registry import registry

QUERIES, ORACLES, query = registry()


def stream(spark, d):
    return op.stream_table(spark, f"{d}/events.parquet")


@query("sm01_late_refusal", "select event_type, case when ts < timestamp '2024-01-10' then 'late' end as refused, count(*)::bigint as n from events group by 1, 2")
def sm01(spark, d):
    rows = op.drain(op.with_refusal(stream(spark, d), F.col("ts"), F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00"))).select("event_type", "refused"))
    return rows.groupBy("event_type", "refused").agg(F.count("*").alias("n"))


@query("sm01_refusal_counts", "select case when ts is null then 'undated' when ts < timestamp '2024-01-10' then 'late' else 'taken' end as reason, count(*)::bigint as n from events group by 1")
def sm01_counts(spark, d):
    """The stream's own counts of what it took and refused."""
    _, counts = op.refusals(stream(spark, d), F.col("ts"), F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00")))
    return counts.groupBy("reason").agg(F.sum("n").alias("n")).where("n > 0")


@query("sm02_write_once", "select user_id, min(event_id) as event_id, arg_min(event_type, event_id) as event_type from events group by 1")
def sm02(spark, d):
    return op.write_once(stream(spark, d).select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("sm03_alerts")
def sm03(spark, d):
    got = op.drain(op.alerts(stream(spark, d), "user_id", "ts", "event_id", "event_type"), store=op.TIMERS)
    return got.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "event_type")


@query("sm04_seen", "select user_id, event_type, min(ts) as first_seen, max(ts) as last_seen, count(*)::bigint as times_seen from events group by 1, 2")
def sm04(spark, d):
    return op.drain(op.seen(stream(spark, d), ["user_id", "event_type"], "ts"), "complete")


@query(
    "sm05_freshness",
    """with n as (select user_id, max(ts) as newest from events group by 1),
    a as (select user_id, date_sub('second', newest, timestamp '2024-02-01') / 3600.0 as age_hours from n)
    select user_id, age_hours, case when age_hours is null then 'unknown' when age_hours > 48 then 'stale' else 'fresh' end as verdict from a""",
)
def sm05(spark, d):
    return op.freshness(table(spark, d, "events"), "user_id", "ts", F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")), 48.0)


@query(
    "sm08_append_once",
    "select cast(ts as date) as day, event_type, count(distinct user_id)::bigint as users from events group by 1, 2",
)
def sm08(spark, d):
    days = stream(spark, d).select(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"), "event_type", "user_id")
    once = op.append_once(days, "day", ["event_type", "user_id"])
    return once.groupBy(F.to_date("day").alias("day"), "event_type").agg(F.count("*").alias("users"))


WINDOWS = """w as (select cast(ts as date) as day, case when strftime(ts, '%H:%M') >= '15:00' then 'late' else 'early' end as name, ts from events where event_type = 'purchase'),
  k as (select day, name, min(ts) as kickoff from w group by 1, 2)"""


def schedule(spark, d):
    """Purchases as the games of their day."""
    return table(spark, d, "events").where("event_type = 'purchase'").select("ts")


@query(
    "sm07_windows",
    f"with {WINDOWS} select k.day, k.name, kickoff, kickoff - interval 60 minute as opens, count(*)::bigint as games from k join w on w.day = k.day and w.name = k.name and w.ts = kickoff group by 1, 2, 3",
)
def sm07(spark, d):
    return op.windows_of(schedule(spark, d), "ts")


@query(
    "sm07_locked",
    f"""with {WINDOWS}, e as (select event_id, ts, cast(ts as date) as day from events)
      select event_id, case when e.ts >= a.kickoff - interval 60 minute and e.ts < a.kickoff then 'early' when e.ts >= b.kickoff - interval 60 minute and e.ts < b.kickoff then 'late' end as "window",
        (coalesce(e.ts >= a.kickoff, false)::int + coalesce(e.ts >= b.kickoff, false)::int)::int as begun
      from e left join k a on a.day = e.day and a.name = 'early' left join k b on b.day = e.day and b.name = 'late'""",
)
def sm07_locked(spark, d):
    """Events as a stream against the windows of their day, a static table."""
    return op.drain(op.locked(stream(spark, d).select("event_id", "ts"), "ts", op.windows_of(schedule(spark, d), "ts"))).select("event_id", "window", "begun")


@query("sm_tumbling", "select date_trunc('day', ts) as day, event_type, count(*)::bigint as n, sum(value) as total from events group by 1, 2")
def tumbling(spark, d):
    out = op.tumbling(stream(spark, d), "ts", "1 day", "2 days", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")])
    return op.drain(out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total"), "complete")


@query(
    "sm_sessions",
    """with g as (select *, case when ts < lag(ts) over w + interval 6 hour then 0 else 1 end as opens from events window w as (partition by user_id order by ts)),
    s as (select *, sum(opens) over (partition by user_id order by ts rows unbounded preceding) as s from g)
    select user_id, min(ts) as started, count(*)::bigint as n from s group by user_id, s""",
)
def sessions(spark, d):
    out = op.sessions(stream(spark, d), "ts", "6 hours", "2 days", ["user_id"], [F.count("*").alias("n")])
    return op.drain(out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "n"), "complete")
