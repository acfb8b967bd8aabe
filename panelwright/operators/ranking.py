"""Ranks, top k, curves by rank, seeding and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import settled


def ordinal(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return ordinal(df, keys, order, "__rank").where(F.col("__rank") <= k).drop("__rank")


def average_tie_percentile(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The mean 0-based rank of equal values over n - 1; null in groups of one."""
    w = Window.partitionBy(*keys)
    rank = F.rank().over(w.orderBy(value)) - 1
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    n = F.count(F.lit(1)).over(w)
    return df.withColumn(out, F.when(n >= 2, (rank + (ties - 1) / 2) / (n - 1)))


def lower_percent_rank(df: DataFrame, keys: list[str], value: str, out: str, lower_is_better: bool = False) -> DataFrame:
    """The index of the first equal value over n - 1, 0.5 in groups of one; 1 less it when lower is better."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    x = F.when(n == 1, 0.5).otherwise((F.rank().over(w.orderBy(value)) - 1) / (n - 1))
    return df.withColumn(out, 1 - x if lower_is_better else x)


def smoothed_curve(df: DataFrame, keys: list[str], rank: str, value: str, least: int = 20, narrow_to: int = 3, out: str = "curve") -> DataFrame:
    """(keys, rank, curve, n): the mean of all values with a rank within 1 (up to narrow_to) or 2 of each rank; a
    curve ends before its first rank with fewer than `least` of them."""
    per = df.groupBy(*keys, rank).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    w = Window.partitionBy(*keys).orderBy(rank)
    near = F.col(rank) <= narrow_to
    total = F.when(near, F.sum("__s").over(w.rangeBetween(-1, 1))).otherwise(F.sum("__s").over(w.rangeBetween(-2, 2)))
    n = F.when(near, F.sum("__n").over(w.rangeBetween(-1, 1))).otherwise(F.sum("__n").over(w.rangeBetween(-2, 2)))
    curve = per.withColumn(out, total / n).withColumn("n", n)
    thin = F.max((F.col("n") < least).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return curve.withColumn("__thin", thin).where("__thin = 0").select(*keys, rank, out, "n")


def non_increasing(df: DataFrame, keys: list[str], rank: str, value: str, out: str) -> DataFrame:
    """The running minimum by rank."""
    return df.withColumn(out, F.min(value).over(Window.partitionBy(*keys).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)))


def order_statistic_curve(df: DataFrame, keys: list[str], season: str, value: str, tie: str, most: int, out: str = "curve") -> DataFrame:
    """The k-th best of each season, averaged over seasons."""
    ranked = top_per_group(df, [*keys, season], [F.desc(value), F.col(tie)], most)
    ranked = ordinal(ranked, [*keys, season], [F.desc(value), F.col(tie)], "k")
    return ranked.groupBy(*keys, "k").agg(F.sum(value).alias("__s"), F.count("*").alias("n")).select(*keys, "k", (F.col("__s") / F.col("n")).alias(out), "n")


def level_rescale(shape: DataFrame, consensus: DataFrame, keys: list[str], rank: str, value: str, out: str) -> DataFrame:
    """shape times mean(consensus) / mean(shape) over the first min(24, both) ranks, if there are 12 and the factor
    is within 0.5 and 2; else as it is."""
    both = shape.join(consensus.select(*keys, rank, F.col(value).alias("__c")), [*keys, rank]).where(F.col(rank) <= 24)
    f = both.groupBy(*keys).agg(F.avg("__c").alias("c"), F.avg(value).alias("s"), F.count("*").alias("n"))
    f = f.select(*keys, F.when((F.col("n") >= 12) & (F.col("c") / F.col("s")).between(0.5, 2.0), F.col("c") / F.col("s")).alias("__f"))
    return shape.join(f, keys, "left").withColumn(out, F.col(value) * F.coalesce("__f", F.lit(1.0))).drop("__f")


def nearest_peers_median(df: DataFrame, keys: list[str], at: str, value: str, tie: str, k: int, out: str) -> DataFrame:
    """The median of value over the k rows of the keys closest in `at`, without the row itself.

    In order of `at` the k nearest lie among the k rows before and the k rows after, so a frame of 2k rows is
    enough and no row meets its whole group.
    """
    w = Window.partitionBy(*keys).orderBy(at, tie)
    peer = F.struct(F.col(at).alias("a"), F.col(value).alias("v"), F.col(tie).alias("t"))
    around = F.concat(F.collect_list(peer).over(w.rowsBetween(-k, -1)), F.collect_list(peer).over(w.rowsBetween(1, k)))
    own = df.withColumn("__near", around)
    nearest = F.slice(F.array_sort(F.transform("__near", lambda p: F.struct(F.abs(p["a"] - F.col(at)).alias("d"), p["t"].alias("t"), p["v"].alias("v")))), 1, k)
    values = F.array_sort(F.transform(nearest, lambda p: p["v"]))
    n = F.size("__v")
    low, high = F.element_at("__v", F.floor((n + 1) / 2).cast("int")), F.element_at("__v", F.floor(n / 2 + 1).cast("int"))
    return own.withColumn("__v", values).withColumn(out, F.when(n > 0, (low + high) / 2)).drop("__near", "__v")


def serpentine(teams: int, rounds: int) -> Column:
    """An array of (pick, round, team): odd rounds in order, even ones back."""
    picks = F.sequence(F.lit(0), F.lit(teams * rounds - 1))

    def one(i):
        round_, place = F.floor(i / teams), i % teams
        team = F.when(round_ % 2 == 0, place + 1).otherwise(teams - place)
        return F.struct((i + 1).alias("pick"), (round_ + 1).cast("int").alias("round"), team.cast("int").alias("team"))

    return F.transform(picks, one)


def playoff_seeds(df: DataFrame, league: list[str], division: str, order: list[Column], places: int, winners_first: bool = True) -> DataFrame:
    """df with seed from 1 to places, or null: the best of each division before all others, then by order."""
    best = F.row_number().over(Window.partitionBy(*league, division).orderBy(*order)) == 1
    first = F.when(best, 0).otherwise(1) if winners_first else F.lit(0)
    seeded = df.withColumn("__first", first)
    seed = F.row_number().over(Window.partitionBy(*league).orderBy("__first", *order))
    return seeded.withColumn("seed", F.when(seed <= places, seed)).drop("__first")


def tiers(df: DataFrame, keys: list[str], value: str, tie: str, drop: float = 3.0, share: float = 0.15, most: int = 5, out: str = "tier") -> DataFrame:
    """Tiers of descending values: a new one when the drop is over max(drop, share of the previous value), or when
    the tier holds `most`. Gaps cut a group into runs, and a run is cut into tiers of `most` by its row numbers."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), tie)
    before = F.lag(value).over(w)
    cut = before.isNull() | (before - F.col(value) > F.greatest(F.lit(drop), share * before))
    runs = df.withColumn("__cut", cut.cast("int")).withColumn("__run", F.sum("__cut").over(w))
    place = F.row_number().over(Window.partitionBy(*keys, "__run").orderBy(F.desc(value), tie))
    runs = runs.withColumn("__begin", ((place - 1) % most == 0).cast("int"))
    return runs.withColumn(out, F.sum("__begin").over(w)).drop("__cut", "__run", "__begin")


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str, tie: str, out: str = "q") -> DataFrame:
    """Adjusted p-values: the running minimum, from the largest, of p * n / rank, at most 1."""
    w = Window.partitionBy(*keys).orderBy(p, tie)  # a family of hypotheses, one task
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    raw = df.withColumn("__raw", F.col(p) * n / F.row_number().over(w))
    back = w.rowsBetween(0, Window.unboundedFollowing)
    return raw.withColumn(out, F.least(F.lit(1.0), F.min("__raw").over(back))).drop("__raw")


def rank_over_all(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """Competition ranks over a whole table, the largest value first, with no window over all of it: the distinct values
    are dealt out by range, summed within each range, and a row a range is summed over all."""
    per = df.groupBy(value).agg(F.count("*").alias("__n")).repartitionByRange(F.desc(value)).withColumn("__part", F.spark_partition_id())
    per = settled(per, "ranges")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = per.groupBy("__part").agg(F.sum("__n").alias("__m"))  # a row a partition
    parts = parts.select("__part", F.coalesce(F.sum("__m").over(before.orderBy("__part")), F.lit(0)).alias("__above"))
    within = F.coalesce(F.sum("__n").over(before.partitionBy("__part").orderBy(F.desc(value))), F.lit(0))
    ranked = per.join(F.broadcast(parts), "__part").withColumn(out, (F.col("__above") + within + 1).cast("long"))
    return df.join(ranked.select(value, out), value)
