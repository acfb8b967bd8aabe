"""Operators over entity x period panels and event logs. Those with `prior` in their name see rows strictly
before the current one only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _prior(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def prior_mean(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, played: Column | None = None) -> DataFrame:
    """The mean of value over a key's earlier rows that count as played; null before the first. A played row
    without a value adds 0 to the sum and 1 to the divisor."""
    played = F.col(value).isNotNull() if played is None else played
    w = _prior(keys, order)
    total = F.sum(F.when(played, F.coalesce(F.col(value), F.lit(0.0)))).over(w)
    return df.withColumn(out, total / F.nullif(F.sum(played.cast("int")).over(w), F.lit(0)))


def prior_trailing(df: DataFrame, keys: list[str], order: list[str], value: str, n: int = 4, prefix: str = "trail") -> DataFrame:
    """Mean (of 1 or more) and population deviation (of 2 or more) of a key's last n non-null values before the row."""
    known = F.col(value).isNotNull()
    among = Window.partitionBy(*keys, "__known").orderBy(*order)  # a key's rows are together already
    back = [F.col(value), *(F.lag(value, k).over(among) for k in range(1, n))]
    held = df.withColumn("__known", known).withColumn("__own", F.when(known, F.array_compact(F.array(*back))))
    last = F.last("__own", ignorenulls=True).over(_prior(keys, order))  # n values a row, whatever its history
    size = F.size("__last")
    total = F.aggregate("__last", F.lit(0.0), lambda a, x: a + x)
    spread = F.aggregate("__last", F.lit(0.0), lambda a, x: a + F.pow(x - F.col(f"{prefix}_mean"), 2))
    out = held.withColumn("__last", last).withColumn(f"{prefix}_mean", F.when(size >= 1, total / size))
    return out.withColumn(f"{prefix}_sd", F.when(size >= 2, F.sqrt(spread / size))).drop("__last", "__own", "__known")


def prior_last(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """A key's last non-null value before the row."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(_prior(keys, order)))


def gap_since_previous(df: DataFrame, keys: list[str], order: str, out: str, seconds: int = 86400) -> DataFrame:
    """Whole units of `seconds` since the key's previous row, of those that exist."""
    w = Window.partitionBy(*keys).orderBy(order)
    gap = F.unix_timestamp(F.col(order).cast("timestamp")) - F.unix_timestamp(F.lag(order).over(w).cast("timestamp"))
    return df.withColumn(out, F.floor(gap / seconds).cast("long"))


def shrink_prior_rates(
    df: DataFrame, key: str, season: str, period: str, value: str, base_weight: float = 4.0, season_weight: float = 6.0, ratio: bool = True, out: str = "rate"
) -> DataFrame:
    """(key, season, period, out) of sums and counts by key and period.

    df has a row for each key, season and period, with value (a sum) and n (how many stand behind it). As a
    ratio to all keys: (base * 1 + n * own / all + season_weight * last season's ratio) over the sum of the
    weights that are there; else around the mean of all keys before the period, or of last season before the
    first. Only periods before the row count.
    """
    w = Window.partitionBy(key, season).orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    per = df.groupBy(season, period).agg(F.sum(value).alias("__v"), F.sum("n").alias("__n"))
    wp = Window.partitionBy(season).orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__lv", F.sum("__v").over(wp)).withColumn("__ln", F.sum("__n").over(wp)).drop("__v", "__n")
    own = df.withColumn("__ov", F.sum(value).over(w)).withColumn("__on", F.sum("n").over(w))
    whole = df.groupBy(season).agg(F.sum(value).alias("__sv"), F.sum("n").alias("__sn"))
    last = df.groupBy(key, season).agg(F.sum(value).alias("__kv"), F.sum("n").alias("__kn")).join(whole, season)
    last = last.select(key, (F.col(season) + 1).alias(season), F.try_divide("__kv", "__kn").alias("__last"), F.try_divide("__sv", "__sn").alias("__last_all"))
    before = whole.select((F.col(season) + 1).alias(season), F.try_divide("__sv", "__sn").alias("__before"))
    joined = own.join(per, [season, period]).join(last, [key, season], "left").join(before, season, "left")
    league = F.try_divide("__lv", "__ln")
    if ratio:
        n = F.when((F.col("__on") > 0) & (league > 0), F.col("__on")).otherwise(0)
        mine = F.coalesce(n * F.try_divide(F.try_divide("__ov", "__on"), league), F.lit(0.0))
        past = F.try_divide("__last", "__last_all")
        middle = F.lit(1.0)
    else:
        n = F.coalesce("__on", F.lit(0))
        mine = F.coalesce(F.col("__ov").cast("double"), F.lit(0.0))
        past = F.col("__last")
        middle = F.coalesce(league, "__before")
    weight = base_weight + n + F.when(past.isNotNull(), season_weight).otherwise(0.0)
    value_ = (base_weight * middle + mine + F.coalesce(season_weight * past, F.lit(0.0))) / weight
    return joined.select(key, season, period, value_.alias(out))


def prior_share(df: DataFrame, entity: str, team: list[str], period: str, value: str, out: str) -> DataFrame:
    """An entity's share of its team's sum over the periods before; null where that is not above zero."""
    own = Window.partitionBy(entity, *team).orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*team).orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    total = F.sum(value).over(all_)
    return df.withColumn(out, F.when(total > 0, F.coalesce(F.sum(value).over(own), F.lit(0)) / total))


def islands(df: DataFrame, keys: list[str], order: str, breaks: Column, out: str = "island") -> DataFrame:
    """Numbers each key's runs of rows from 1; a row where `breaks` is true, or a key's first, begins one."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = F.row_number().over(w) == 1
    begins = df.withColumn("__begins", (first | F.coalesce(breaks, F.lit(False))).cast("int"))
    return begins.withColumn(out, F.sum("__begins").over(w)).drop("__begins")


def islands_over_gaps(rows: DataFrame, calendar: DataFrame, keys: list[str], period: str, skipped: str, out: str = "island") -> DataFrame:
    """Islands of rows whose periods follow each other where a period is skipped only if the calendar has it,
    for the key, as one that does not count. calendar has keys, period and the flag."""
    w = Window.partitionBy(*keys).orderBy(period)
    counted = calendar.where(~F.col(skipped)).withColumn("__n", F.row_number().over(w))
    place = rows.join(counted.select(*keys, period, "__n"), [*keys, period], "left")
    return islands(place, keys, period, F.coalesce(F.col("__n") - F.lag("__n").over(w) != 1, F.lit(True)), out).drop("__n")


def censored_lead(df: DataFrame, keys: list[str], order: list[str], event: Column, k: int, out: str) -> DataFrame:
    """1 if the event holds on none of the next k rows from the current one, 0 if on any, null if fewer remain."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, k - 1)
    flag = event.cast("int")
    return df.withColumn(out, F.when(F.count(F.lit(1)).over(w) == k, F.when(F.max(flag).over(w) == 0, 1).otherwise(0)))


def first_after(df: DataFrame, keys: list[str], order: str, event: Column, out: str) -> DataFrame:
    """The first order value from the current row on where the event holds; null if it is not seen (censored)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(out, F.min(F.when(event, F.col(order))).over(w))


def rolling_count(df: DataFrame, keys: list[str], order: str, back: int, out: str) -> DataFrame:
    """How many of a key's rows lie from back before to the current order value, without the current row."""
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(-back, 0)
    return df.withColumn(out, F.count(F.lit(1)).over(w) - 1)


def balance_before(df: DataFrame, keys: list[str], at: str, amount: str, out: str, budget: Column | None = None) -> DataFrame:
    """What is left of a budget (else what was spent) before an instant; rows of one instant see the same."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(micros).rangeBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(amount).over(w), F.lit(0))
    return df.withColumn(out, spent if budget is None else budget - spent)


def rest_of_period(df: DataFrame, keys: list[str], order: list[str], value: str, prefix: str = "rest") -> DataFrame:
    """Sum and count of value from the row on."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(f"{prefix}_sum", F.sum(value).over(w)).withColumn(f"{prefix}_n", F.count(value).over(w))


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], tolerance: Column | None = None, prefix: str = "asof_"
) -> DataFrame:
    """left with the values and the time of the key's latest right row at or before it; nulls where there is none,
    or where `tolerance`, an expression of __at (left's time) and prefix + right_at, is false.

    One shuffle of both sides by key and one sort: rows are put together and the last right row is carried on,
    so a key's rows meet no product. Among right rows of one time the one with the largest values stays.
    """
    carried = F.struct(F.col(right_at).alias("__t"), *values)
    newest = right.groupBy(*keys, right_at).agg(F.max(F.struct(*values)).alias("__v")).select(*keys, right_at, "__v.*")
    rows = left.select(*keys, F.col(left_at).alias("__at"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(newest.select(carried).schema[0].dataType).alias("__right"))
    others = newest.select(*keys, F.col(right_at).alias("__at"), F.lit(None).cast(rows.schema["__left"].dataType).alias("__left"), carried.alias("__right"))
    w = Window.partitionBy(*keys).orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(others).withColumn("__last", F.last("__right", ignorenulls=True).over(w)).where("__left is not null")
    named = [F.col("__last.__t").alias(prefix + right_at), *(F.col(f"__last.{v}").alias(prefix + v) for v in values)]
    out = both.select("__left.*", "__at", *named)
    if tolerance is not None:
        ok = F.coalesce(tolerance, F.lit(False))
        out = out.withColumns({c: F.when(ok, F.col(c)) for c in (prefix + right_at, *(prefix + v for v in values))})
    return out.drop("__at")


def snapshot_probe(left: DataFrame, snapshots: DataFrame, keys: list[str], left_at: str, taken: str, value: str, most_days: int, out: str) -> DataFrame:
    """The value in the latest snapshot at or before the day and at most most_days old; null where that snapshot
    lacks the key, whatever older ones say. A snapshot's day stands for it and the most_days after it; of those that
    stand for a day the last is taken."""
    taken_on = snapshots.select(F.col(taken).cast("date").alias("__taken")).where("__taken is not null").distinct()
    stands = taken_on.select("__taken", F.explode(F.sequence("__taken", F.date_add("__taken", most_days))).alias("__day"))
    chosen = stands.groupBy("__day").agg(F.max("__taken").alias("__taken"))
    probe = snapshots.select(*keys, F.col(taken).cast("date").alias("__taken"), F.col(value).alias(out)).groupBy(*keys, "__taken").agg(F.max(out).alias(out))
    return left.withColumn("__day", F.col(left_at).cast("date")).join(chosen, "__day", "left").join(probe, [*keys, "__taken"], "left").drop("__day", "__taken")


def last_wins(df: DataFrame, keys: list[str], order: Column, value: str, out: str) -> DataFrame:
    """The value of the row with the largest order, for each key."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(out))


def first_wins(df: DataFrame, keys: list[str], order: Column, value: str, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(out))


def lagged_mean(df: DataFrame, key: str, season: str, points: str, games: str, weights: list[float], out: str) -> DataFrame:
    """Sum of weight x points over sum of weight x games, over the seasons 1, 2 ... before, of those with games."""
    parts = []
    for lag, weight in enumerate(weights, 1):
        parts.append(df.where(F.col(games) > 0).select(key, (F.col(season) + lag).alias(season), (F.col(points) * weight).alias("__p"), (F.col(games) * weight).alias("__g")))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return df.join(all_.groupBy(key, season).agg((F.sum("__p") / F.sum("__g")).alias(out)), [key, season], "left")
