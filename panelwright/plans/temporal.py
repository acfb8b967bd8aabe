"""Queries of the temporal operators over events, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal as op
from ..sources.readers import table
from .registry import registry

QUERIES, ORACLES, query = registry()

#: Values are counted in whole hundredths, so that sums do not depend on their order.
CENTS = "CAST(round(value * 100) AS bigint)"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))


SQL_EVENTS = "e as (select *, round(value * 100)::bigint as cents from events)"


@query(
    "flagship",
    f"""with {SQL_EVENTS}, w as (
      select event_id, user_id,
        sum(cents) over p as prior_cents, count(*) over p as prior_n,
        last_value(case when event_type = 'purchase' then cents end ignore nulls) over p as last_purchase,
        max(ts) over p as last_ts, ts
      from e window p as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding))
    select event_id, user_id, prior_n::bigint as prior_n, prior_cents / prior_n as prior_mean, last_purchase,
      floor((epoch(date_trunc('second', ts)) - epoch(date_trunc('second', last_ts))) / 3600)::bigint as idle_hours from w""",
)
def flagship(spark, sf_dir):
    """What is known of a user before each event: their mean value, last purchase and hours since the last event."""
    df = events(spark, sf_dir).withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("cents")))
    keys, order = ["user_id"], ["ts", "event_id"]
    w = op._prior(keys, order)
    df = op.prior_last(df, keys, order, "bought", "last_purchase").withColumn("prior_n", F.count("*").over(w)).withColumn("prior_sum", F.sum("cents").over(w))
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    idle = F.floor((seconds - F.max(seconds).over(w)) / 3600).cast("bigint")
    mean = F.try_divide("prior_sum", "prior_n")
    return df.withColumn("idle_hours", idle).select("event_id", "user_id", "prior_n", mean.alias("prior_mean"), "last_purchase", "idle_hours")


@query(
    "wn03_prior_mean",
    f"""with {SQL_EVENTS} select event_id, sum(case when event_type <> 'error' then cents end) over p / nullif(sum((event_type <> 'error')::int) over p, 0) as prior_mean
    from e window p as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding)""",
)
def wn03(spark, sf_dir):
    df = op.prior_mean(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "cents", "prior_mean", F.col("event_type") != "error")
    return df.select("event_id", "prior_mean")


@query(
    "wn04_trailing4",
    f"""with {SQL_EVENTS}, h as (select event_id, list(cents) filter (event_type = 'purchase') over p as h
      from e window p as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding)),
    l as (select event_id, h[greatest(len(h) - 3, 1):len(h)] as l from h)
    select event_id, case when len(l) >= 1 then list_sum(l) / len(l) end as trail_mean,
      case when len(l) >= 2 then round(sqrt(list_sum(list_transform(l, lambda x: pow(x - list_sum(l) / len(l), 2))) / len(l)), 4) end as trail_sd from l""",
)
def wn04(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("cents")))
    df = op.prior_trailing(df, ["user_id"], ["ts", "event_id"], "bought")
    return df.select("event_id", "trail_mean", F.round("trail_sd", 4).alias("trail_sd"))


MONTHS = """m as (select o_custkey % 40 as k, year(o_orderdate)::int as season, month(o_orderdate)::int as period,
  sum(round(o_totalprice * 100)::bigint)::double as v, count(*)::bigint as n from orders group by all)"""


def months(spark, sf_dir):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return (
        table(spark, sf_dir, "orders")
        .groupBy((F.col("o_custkey") % 40).alias("k"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("period"))
        .agg(F.sum(cents).cast("double").alias("v"), F.count("*").alias("n"))
    )


SHRINK_PARTS = f"""with {MONTHS}, g as (select season, period, sum(v) as v, sum(n) as n from m group by all),
  l as (select season, period, sum(v) over w as lv, sum(n) over w as ln from g window w as (partition by season order by period range between unbounded preceding and 1 preceding)),
  o as (select *, sum(v) over w as ov, sum(n) over w as own_n from m window w as (partition by k, season order by period range between unbounded preceding and 1 preceding)),
  s as (select season, sum(v) as sv, sum(n) as sn from m group by all),
  y as (select k, m.season + 1 as season, sum(v) / sum(n) as last_rate, max(sv) / max(sn) as last_all from m join s using (season) group by k, m.season),
  j as (select o.k, o.season, o.period, o.ov, o.own_n, l.lv / l.ln as league, last_rate, last_all, b.sv / b.sn as before
    from o join l using (season, period) left join y on y.k = o.k and y.season = o.season left join s b on b.season + 1 = o.season)"""


@query(
    "wn05_shrunk_ratio",
    SHRINK_PARTS
    + """select k, season, period, round((4 + coalesce(case when own_n > 0 and league > 0 then own_n * (ov / own_n / league) end, 0) + coalesce(6 * (last_rate / last_all), 0))
      / (4 + case when own_n > 0 and league > 0 then own_n else 0 end + case when last_rate / last_all is not null then 6 else 0 end), 8) as ratio from j""",
)
def wn05(spark, sf_dir):
    df = op.shrink_prior_rates(months(spark, sf_dir), "k", "season", "period", "v", out="ratio")
    return df.withColumn("ratio", F.round("ratio", 8))


@query(
    "wn06_shrunk_rate",
    SHRINK_PARTS
    + """select k, season, period, round((4 * coalesce(league, before) + coalesce(ov, 0) + coalesce(6 * last_rate, 0))
      / (4 + coalesce(own_n, 0) + case when last_rate is not null then 6 else 0 end), 2) as rate from j""",
)
def wn06(spark, sf_dir):
    """A key's own mean, or (WN-07) that of what others score against it: the key column is what differs."""
    df = op.shrink_prior_rates(months(spark, sf_dir), "k", "season", "period", "v", ratio=False)
    return df.withColumn("rate", F.round("rate", 2))


@query(
    "wn07_allowed_rate",
    """with m as (select l_suppkey % 20 as k, year(l_shipdate)::int as season, month(l_shipdate)::int as period,
      sum(round(l_extendedprice * 100)::bigint)::double as v, count(distinct l_orderkey)::bigint as n from lineitem group by all), """
    + SHRINK_PARTS.split(MONTHS + ",")[1]
    + """select k, season, period, round((4 * coalesce(league, before) + coalesce(ov, 0) + coalesce(6 * last_rate, 0))
      / (4 + coalesce(own_n, 0) + case when last_rate is not null then 6 else 0 end), 2) as rate from j""",
)
def wn07(spark, sf_dir):
    """The divisor counts the distinct orders met, not rows."""
    line = table(spark, sf_dir, "lineitem")
    df = line.groupBy((F.col("l_suppkey") % 20).alias("k"), F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("period")).agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("double").alias("v"), F.countDistinct("l_orderkey").alias("n")
    )
    return op.shrink_prior_rates(df, "k", "season", "period", "v", ratio=False).withColumn("rate", F.round("rate", 2))


@query(
    "wn08_prior_share",
    f"""with {MONTHS} select k, season, period, case when t > 0 then coalesce(o, 0) / t end as share from (
      select k, season, period, sum(v) over (partition by k, season order by period range between unbounded preceding and 1 preceding) as o,
        sum(v) over (partition by season order by period range between unbounded preceding and 1 preceding) as t from m)""",
)
def wn08(spark, sf_dir):
    return op.prior_share(months(spark, sf_dir), "k", ["season"], "period", "v", "share").select("k", "season", "period", "share")


@query(
    "wn09_locf",
    f"""with {SQL_EVENTS} select event_id, last_value(case when event_type = 'purchase' then cents end ignore nulls)
      over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as carried from e""",
)
def wn09(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("cents")))
    return op.prior_last(df, ["user_id"], ["ts", "event_id"], "bought", "carried").select("event_id", "carried")


@query("wn10_gap", "select event_id, floor((epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) over (partition by user_id order by ts)))) / 3600)::bigint as gap_hours from events")
def wn10(spark, sf_dir):
    return op.gap_since_previous(table(spark, sf_dir, "events"), ["user_id"], "ts", "gap_hours", 3600).select("event_id", "gap_hours")


@query(
    "wn13_islands",
    """with b as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 6 hours then 0 else 1 end as b from events),
      i as (select *, sum(b) over (partition by user_id order by ts, event_id) as island from b)
      select user_id, island::bigint as island, count(*)::bigint as n, min(ts) as began, max(ts) as ended from i group by all""",
)
def wn13(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    from pyspark.sql import Window

    last = F.lag("ts").over(Window.partitionBy("user_id").orderBy("at"))
    found = op.islands(df, ["user_id"], "at", F.col("ts") - last > F.expr("interval 6 hours"))
    return found.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


@query(
    "wn13_islands_over_byes",
    """with d as (select distinct user_id, ts::date as day from events),
      span as (select user_id, min(day) as a, max(day) as b from d group by 1),
      c as (select user_id, unnest(generate_series(a, b, interval 1 day))::date as day from span),
      k as (select *, row_number() over (partition by user_id order by day) as n from c where dayofweek(day) not in (0, 6)),
      p as (select d.user_id, d.day, k.n from d left join k using (user_id, day)),
      q as (select *, case when n - lag(n) over (partition by user_id order by day) = 1 then 0 else 1 end as b from p),
      i as (select *, sum(b) over (partition by user_id order by day) as island from q)
      select user_id, island::bigint as island, min(day) as began, max(day) as ended, count(*)::bigint as n from i group by all""",
)
def wn13_byes(spark, sf_dir):
    """Runs of active days in which weekends are skipped without breaking them."""
    days = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    span = days.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    calendar = span.select("user_id", F.explode(F.sequence("a", "b")).alias("day")).withColumn("skipped", F.dayofweek("day").isin(1, 7))
    found = op.islands_over_gaps(days, calendar, ["user_id"], "day", "skipped")
    return found.groupBy("user_id", "island").agg(F.min("day").alias("began"), F.max("day").alias("ended"), F.count("*").alias("n"))


@query(
    "wn14_censored_lead",
    """select event_id, case when count(*) over w = 4 then case when max((event_type = 'error')::int) over w = 0 then 1 else 0 end end as clean4
      from events window w as (partition by user_id order by ts, event_id rows between current row and 3 following)""",
)
def wn14(spark, sf_dir):
    return op.censored_lead(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 4, "clean4").select("event_id", "clean4")


@query(
    "wn15_first_after",
    "select event_id, min(case when event_type = 'error' then ts end) over (partition by user_id order by ts rows between current row and unbounded following) as next_error from events",
)
def wn15(spark, sf_dir):
    return op.first_after(table(spark, sf_dir, "events"), ["user_id"], "ts", F.col("event_type") == "error", "next_error").select("event_id", "next_error")


@query(
    "wn16_rolling_count",
    """select o_orderkey, (count(*) over (partition by o_custkey order by o_orderdate::date range between interval 730 days preceding and current row) - 1)::bigint as n from orders""",
)
def wn16(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("day", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")))
    return op.rolling_count(df, ["o_custkey"], "day", 730, "n").select("o_orderkey", "n")


@query(
    "wn20_balance",
    """select o_orderkey, 50000000 - coalesce(sum(round(o_totalprice * 100)::bigint) over (partition by o_custkey, year(o_orderdate)
      order by epoch_us(o_orderdate) range between unbounded preceding and 1 preceding), 0)::bigint as left_over from orders""",
)
def wn20(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint")).withColumn("season", F.year("o_orderdate"))
    return op.balance_before(df, ["o_custkey", "season"], "o_orderdate", "cents", "left_over", F.lit(50000000).cast("bigint")).select("o_orderkey", "left_over")


@query(
    "wn21_rest_of_period",
    """select o_orderkey, (sum(round(o_totalprice * 100)::bigint) over w)::bigint as rest_sum, (count(o_totalprice) over w)::bigint as rest_n from orders
      window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between current row and unbounded following)""",
)
def wn21(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return op.rest_of_period(df, ["o_custkey"], ["o_orderdate", "o_orderkey"], "cents").select("o_orderkey", "rest_sum", "rest_n")


@query(
    "wn22_promotion",
    """with d as (select distinct user_id, event_type, date_trunc('week', ts)::date as week from events),
      n as (select user_id, date_trunc('week', ts)::date as week, count(*) as n from events group by all),
      r as (select *, row_number() over (partition by week order by n desc, user_id) as rank from n),
      p as (select a.user_id, a.week, b.user_id as displaced from r a join r b on a.week = b.week + 7 and b.rank = 1 and a.rank = 1 and a.user_id <> b.user_id
        join r c on c.week + 7 = a.week and c.user_id = a.user_id and c.rank between 2 and 40)
      select user_id, week, displaced from p where exists (select 1 from d where d.user_id = displaced and d.week = p.week and d.event_type = 'error')""",
)
def wn22(spark, sf_dir):
    """Users who go from a place behind the first to the first of a week while the one displaced has an error that week."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("week", F.date_trunc("week", "ts").cast("date"))
    rank = F.row_number().over(Window.partitionBy("week").orderBy(F.desc("n"), "user_id"))
    ranked = e.groupBy("user_id", "week").agg(F.count("*").alias("n")).withColumn("rank", rank)
    now = ranked.where("rank = 1").select("user_id", "week")
    last = ranked.select(F.date_add("week", 7).alias("week"), "user_id", "rank")
    first = last.where("rank = 1").select("week", F.col("user_id").alias("displaced"))
    second = last.where("rank between 2 and 40").select("week", "user_id")
    errors = e.where("event_type = 'error'").select(F.col("user_id").alias("displaced"), "week")
    return now.join(second, ["week", "user_id"]).join(first, "week").where("user_id <> displaced").join(errors, ["displaced", "week"], "left_semi").select("user_id", "week", "displaced")


@query("wn23_first_in_group", "select user_id, arg_min(event_type, (ts, event_id)) as first_type from events group by 1")
def wn23(spark, sf_dir):
    return op.first_wins(table(spark, sf_dir, "events"), ["user_id"], F.struct("ts", "event_id"), "event_type", "first_type")


@query(
    "wn24_edge_periods",
    """with w as (select date_trunc('week', ts)::date as week, max(ts) as as_of from events group by 1)
      select min(week) filter (as_of >= timestamp '2024-01-15') as imminent, max(week) filter (as_of < timestamp '2024-01-15') as settled from w""",
)
def wn24(spark, sf_dir):
    weeks = table(spark, sf_dir, "events").groupBy(F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.max("ts").alias("as_of"))
    today = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    return weeks.agg(F.min(F.when(F.col("as_of") >= today, F.col("week"))).alias("imminent"), F.max(F.when(F.col("as_of") < today, F.col("week"))).alias("settled"))


@query(
    "wn26_lagged_mean",
    """with y as (select o_custkey as k, year(o_orderdate)::int as season, sum(round(o_totalprice * 100)::bigint)::bigint as p, count(*)::bigint as g from orders group by all),
      l as (select k, season + 1 as season, p * 5 as p, g * 5 as g from y union all select k, season + 2, p * 3, g * 3 from y union all select k, season + 3, p * 2, g * 2 from y),
      s as (select k, season, sum(p) / sum(g) as hist from l group by all)
      select y.k, y.season, hist from y left join s using (k, season)""",
)
def wn26(spark, sf_dir):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    y = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("season")).agg(F.sum(cents).alias("p"), F.count("*").alias("g"))
    return op.lagged_mean(y, "k", "season", "p", "g", [5, 3, 2], "hist").select("k", "season", "hist")


PURCHASES = "p as (select user_id, ts, max(round(value * 100)::bigint) as cents from events where event_type = 'purchase' group by all)"


def purchases(spark, sf_dir):
    return events(spark, sf_dir).where("event_type = 'purchase'").select("user_id", "ts", "cents")


@query("jn10_asof", f"with {PURCHASES} select e.event_id, p.ts as asof_ts, p.cents as asof_cents from events e asof left join p on e.user_id = p.user_id and e.ts >= p.ts")
def jn10(spark, sf_dir):
    df = op.asof_join(table(spark, sf_dir, "events"), purchases(spark, sf_dir), ["user_id"], "ts", "ts", ["cents"])
    return df.select("event_id", "asof_ts", "asof_cents")


@query(
    "jn11_asof_tolerance",
    f"""with {PURCHASES}, a as (select e.event_id, e.ts, p.ts as asof_ts, p.cents from events e asof left join p on e.user_id = p.user_id and e.ts >= p.ts)
      select event_id, case when ts - asof_ts <= interval 8 hours then cents end as asof_cents from a""",
)
def jn11(spark, sf_dir):
    near = F.col("__at") - F.col("asof_ts") <= F.expr("interval 8 hours")
    df = op.asof_join(table(spark, sf_dir, "events"), purchases(spark, sf_dir), ["user_id"], "ts", "ts", ["cents"], near)
    return df.select("event_id", "asof_cents")


@query(
    "jn11_snapshot_probe",
    """with s as (select user_id, ts::date as day, max(round(value * 100)::bigint) as v from events where event_type = 'purchase' and dayofweek(ts) in (1, 4) group by all),
      days as (select distinct day from s), e as (select event_id, user_id, ts::date as day from events),
      c as (select distinct e.day, (select max(d.day) from days d where d.day <= e.day) as taken from e)
      select e.event_id, s.v as seen from e join c on c.day = e.day left join s on s.user_id = e.user_id and s.day = c.taken and e.day - c.taken <= 8""",
)
def jn11_snapshot(spark, sf_dir):
    """The snapshots of Mondays and Thursdays; a user whom the latest lacks has none."""
    taken = purchases(spark, sf_dir).where(F.dayofweek("ts").isin(2, 5))
    return op.snapshot_probe(table(spark, sf_dir, "events"), taken, ["user_id"], "ts", "ts", "cents", 8, "seen").select("event_id", "seen")


@query(
    "jn12_asof_each_period",
    f"""with {PURCHASES}, w as (select distinct date_trunc('week', ts) as cutoff from events), u as (select distinct user_id from p),
      g as (select user_id, cutoff from u, w)
      select g.user_id, g.cutoff, p.cents as asof_cents from g asof join p on g.user_id = p.user_id and g.cutoff >= p.ts""",
)
def jn12(spark, sf_dir):
    """Each user's latest purchase at the start of each week; the weeks are exploded from a span, not joined."""
    p = purchases(spark, sf_dir)
    weeks = table(spark, sf_dir, "events").agg(F.array_distinct(F.collect_set(F.date_trunc("week", "ts").cast("timestamp_ntz"))).alias("weeks"))
    grid = p.select("user_id").distinct().join(F.broadcast(weeks)).select("user_id", F.explode("weeks").alias("cutoff"))
    return op.asof_join(grid, p, ["user_id"], "cutoff", "ts", ["cents"]).where("asof_ts is not null").select("user_id", "cutoff", "asof_cents")


@query("jn13_last_wins", "select user_id, arg_max(event_type, (ts, event_id)) as last_type from events group by 1")
def jn13(spark, sf_dir):
    return op.last_wins(table(spark, sf_dir, "events"), ["user_id"], F.struct("ts", "event_id"), "event_type", "last_type")


@query("jn14_first_wins", "select user_id, event_type, arg_min(event_id, (ts, event_id)) as first_id from events group by 1, 2")
def jn14(spark, sf_dir):
    return op.first_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.struct("ts", "event_id"), "event_id", "first_id")


@query(
    "jn25_bounded_forward",
    """with r as (select o_orderkey, o_custkey, o_orderdate::date as day from orders),
      m as (select a.o_orderkey, min((b.day, b.o_orderkey)) as b from r a join r b on a.o_custkey = b.o_custkey and b.day > a.day and b.day <= a.day + 60 group by 1)
      select o_orderkey, b[2] as next_order from m""",
)
def jn25(spark, sf_dir):
    """The customer's earliest later order within 60 days, by a window frame of days and no join."""
    from pyspark.sql import Window

    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    df = table(spark, sf_dir, "orders").withColumn("day", day)
    w = Window.partitionBy("o_custkey").orderBy("day").rangeBetween(1, 60)
    return df.withColumn("next", F.min(F.struct("day", "o_orderkey")).over(w)).where("next is not null").select("o_orderkey", F.col("next.o_orderkey").alias("next_order"))
