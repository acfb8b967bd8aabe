"""Slot assignment, valuation, ratings, brackets and decisions scored in hindsight. What is sequential inside a group
(a roster) runs on the group's rows in a task; everything between groups is joins, windows and sums."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import settled

#: The positions that a flexible slot admits.
SLOTS = {
    "FLEX": ("RB", "WR", "TE"), "SUPERFLEX": ("QB", "RB", "WR", "TE"), "OP": ("QB", "RB", "WR", "TE"), "WRTE": ("WR", "TE"), "RBWR": ("RB", "WR"), "RBTE": ("RB", "TE"),
}


def admitted(slot: str) -> tuple[str, ...]:
    return SLOTS.get(slot.upper(), (slot.upper(),))


@functools.lru_cache(4096)
def _open_to(slots: tuple[str, ...], positions: tuple[str, ...]) -> tuple[int, ...]:
    """The slots that admit one of the positions, in order."""
    return tuple(s for s, slot in enumerate(slots) if not set(admitted(slot)).isdisjoint(positions))


def assign(values: Sequence[float], eligible: Sequence[Sequence[str]], slots: Sequence[str], locked: Sequence[int | None] | None = None) -> list[int | None]:
    """The slot of each row, or None, such that the sum of values is the largest there is.

    Rows are taken by value and kept if some chain of moves frees a slot for them; sets of rows that can be
    seated together form a matroid, so this greedy choice is the best. Locked rows hold their slot. Rows that
    are worth less than nothing stay out.
    """
    seat: dict[int, int] = {}
    fixed = {s: i for i, s in enumerate(locked or []) if s is not None}
    own = tuple(slots)
    fits = [_open_to(own, tuple(e)) for e in eligible]

    def place(i: int, seen: set[int]) -> bool:
        for s in fits[i]:
            if s in seen or s in fixed:
                continue
            seen.add(s)
            if s not in seat or place(seat[s], seen):
                seat[s] = i
                return True
        return False

    held = set(fixed.values())
    for i in sorted(range(len(values)), key=lambda i: (-values[i], i)):
        if len(seat) + len(fixed) == len(own):
            break  # all slots are taken, and who has a seat keeps one
        if fits[i] and i not in held and values[i] >= 0:
            place(i, set())
    out: list[int | None] = [None] * len(values)
    for s, i in {**seat, **fixed}.items():
        out[i] = s
    return out


def best_lineups(df: DataFrame, keys: list[str], row: str, value: str, eligible: str, slots: Sequence[str], locked: str | None = None) -> DataFrame:
    """(keys, row, slot) of the rows of each group (a team's week) that start. eligible is an array of positions."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*keys, row))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(row)
        fixed = None if locked is None else [None if pd.isna(x) else int(x) for x in frame[locked]]
        got = assign(frame[value].astype(float).tolist(), [list(e) for e in frame[eligible]], slots, fixed)
        out = frame[[*keys, row]].assign(slot=[None if s is None else f"{slots[s]}{s}" for s in got])
        return out[out["slot"].notna()]

    columns = [*keys, row, value, eligible, *([locked] if locked else [])]
    return df.select(*columns).groupBy(*keys).applyInPandas(one, kinds + ", slot string")


def regret(df: DataFrame, keys: list[str], row: str, forecast: str, actual: str, eligible: str, slots: Sequence[str]) -> DataFrame:
    """(keys, best, got, regret): points of the lineup chosen in hindsight, of the one by forecast, and the gap."""
    points = lambda by: best_lineups(df, keys, row, by, eligible, slots).join(df.select(*keys, row, actual), [*keys, row]).groupBy(*keys).agg(F.sum(actual).alias(f"__{by}"))
    both = points(actual).join(points(forecast), keys)
    return both.select(*keys, F.col(f"__{actual}").alias("best"), F.col(f"__{forecast}").alias("got"), (F.col(f"__{actual}") - F.col(f"__{forecast}")).alias("regret"))


# Valuation


def dedicated_baselines(df: DataFrame, group: str, value: str, tie: str, starters: dict[str, int]) -> DataFrame:
    """(group, baseline): the value of the first row of each group behind its starters."""
    need = F.create_map(*(x for k, n in starters.items() for x in (F.lit(k), F.lit(n))))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), tie))
    return df.withColumn("__rank", rank).where(F.col("__rank") == F.coalesce(need[F.col(group)], F.lit(0)) + 1).select(group, F.col(value).alias("baseline"))


def flex_baselines(df: DataFrame, group: str, value: str, tie: str, starters: dict[str, int], flex: Sequence[tuple[Sequence[str], int]]) -> DataFrame:
    """As dedicated_baselines, after flexible slots (groups, number), the most restrictive first, have taken the
    best rows left of their groups. One window for each kind of flexible slot."""
    need = F.create_map(*(x for k, n in starters.items() for x in (F.lit(k), F.lit(n))))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), tie))
    left = df.select(group, F.col(value).alias("__v"), F.col(tie).alias("__t")).withColumnRenamed("__v", value).withColumnRenamed("__t", tie)
    left = left.withColumn("__rank", rank).where(F.col("__rank") > F.coalesce(need[F.col(group)], F.lit(0))).drop("__rank")
    for groups, n in sorted(flex, key=lambda g: len(g[0])):
        best = left.where(F.col(group).isin(*groups)).orderBy(F.desc(value), tie).limit(n).select(tie)
        left = left.join(F.broadcast(best), tie, "left_anti")  # n rows
    return left.groupBy(group).agg(F.max(value).alias("baseline"))


def dollars(df: DataFrame, group: str, value: str, baselines: DataFrame, teams: int, budget: int, spots: int, reserved: dict[str, float] | None = None) -> DataFrame:
    """df with vor (value over the group's baseline, at least 0) and dollars: 1 and a share of what the teams can
    spend beyond 1 a spot. Groups with a reserved pool share that pool only."""
    reserved = reserved or {}
    own = df.join(baselines, group, "left").withColumn("vor", F.greatest(F.lit(0.0), F.col(value) - F.coalesce("baseline", F.col(value)))).drop("baseline")
    kept = F.col(group).isin(*reserved) if reserved else F.lit(False)
    total = own.agg(F.sum(F.when(~kept, F.col("vor"))).alias("__all"), F.sum(F.when(kept, F.col("vor"))).alias("__kept"))  # one row
    pool = float(sum(reserved.values()))
    rate = F.when(kept, F.try_divide(F.lit(pool), "__kept")).otherwise(F.try_divide(F.lit(float(teams * budget - teams * spots) - pool), "__all"))
    priced = F.when(F.col("vor") > 0, F.floor(1 + F.col("vor") * F.coalesce(rate, F.lit(0.0)) + 0.5)).otherwise(1)
    return own.join(F.broadcast(total)).withColumn("dollars", priced.cast("long")).drop("__all", "__kept")


def inflation(book: DataFrame, value: str, tie: str, money_left: float, open_slots: int) -> DataFrame:
    """One row: remaining money over the book value of the best open slots (1 each at least), kept within 0.8 and 1.4."""
    best = book.orderBy(F.desc(value), tie).limit(open_slots)
    return best.agg(F.least(F.lit(1.4), F.greatest(F.lit(0.8), F.try_divide(F.lit(float(money_left)), F.sum(F.greatest(F.lit(1.0), F.col(value)))))).alias("inflation"))


def power_ratings(games: DataFrame, rounds: int = 30, home_edge: float = 1.0, chained: int = 10) -> DataFrame:
    """(team, rating) from games(home, away, spread), the spread being the home side's (below 0: favoured).

    A team's rating is the mean over its games of what the spread says beyond the opponent's rating, found by
    rounds of that rule, the mean of all ratings being 0. The games are summed to a row a pair of teams first; a
    round is a join of pairs and ratings and a sum, and every few rounds the ratings are written.
    """
    sides = games.select(F.explode(F.array(
        F.struct(F.col("home").alias("team"), F.col("away").alias("other"), (-F.col("spread") - home_edge).alias("edge")),
        F.struct(F.col("away").alias("team"), F.col("home").alias("other"), (F.col("spread") + home_edge).alias("edge")),
    )).alias("s")).select("s.*")
    met = sides.groupBy("team", "other").agg(F.sum("edge").alias("edge"), F.count("*").alias("n"))
    # a team meets itself as often as all others: a round is half a step, as two leagues that only meet across would
    # swing for ever
    self_ = met.groupBy("team").agg(F.sum("n").alias("n")).select("team", F.col("team").alias("other"), F.lit(0.0).alias("edge"), "n")
    pairs = settled(met.unionByName(self_), "pairs")
    now = pairs.select("team").distinct().withColumn("rating", F.lit(0.0))
    for k in range(1, rounds + 1):
        others = pairs.join(now.select(F.col("team").alias("other"), "rating"), "other")
        now = others.groupBy("team").agg((F.sum(F.col("edge") + F.col("n") * F.col("rating")) / F.sum("n")).alias("rating"))
        now = settled(now, "ratings") if k % chained == 0 or k == rounds else now
    mean = now.agg(F.avg("rating").alias("mean"))  # one row
    return now.join(F.broadcast(mean)).select("team", (F.col("rating") - F.col("mean")).alias("rating"))


# Schedules and brackets


def round_robin(n: int, weeks: int) -> list[tuple[int, int, int]]:
    """(week, home, away) of teams 1 to n (n even) by the circle method, starting over when all have met."""
    ring, out = list(range(2, n + 1)), []
    for week in range(1, weeks + 1):
        turn = (week - 1) % (n - 1)
        order = [1, *ring[turn:], *ring[:turn]]
        for k in range(n // 2):
            a, b = order[k], order[n - 1 - k]
            out.append((week, a, b) if (week + k) % 2 else (week, b, a))
    return out


def bracket(teams: DataFrame, scores: DataFrame, league: list[str], places: int, reseed: bool = True) -> DataFrame:
    """(league, team, seed, round, opponent, points, won) of every game of the leagues' brackets.

    teams has the league's keys, team and seed (from 1), scores those, team, round and points. The best seeds
    have a bye while the field is no power of two; then the best left plays the worst left, by seed anew in
    each round if reseed is on, else by their place in the bracket. More points win, the better seed of two as
    good. A round is one window over the league's teams that are left.
    """
    size, round_, out = 1, 0, None
    while size < places:
        size *= 2
    alive = teams.where(F.col("seed") <= places).select(*league, "team", "seed", F.col("seed").alias("slot"))
    while size > 1:
        round_ += 1
        place = F.row_number().over(Window.partitionBy(*league).orderBy("seed")) if reseed and round_ > 1 else F.col("slot")
        own = alive.withColumn("slot", place).withColumn("pair", F.least(F.col("slot"), F.lit(size + 1) - F.col("slot")))
        own = own.join(scores.where(F.col("round") == round_).select(*league, "team", "points"), [*league, "team"], "left").withColumn("points", F.coalesce("points", F.lit(0.0)))
        w = Window.partitionBy(*league, "pair")
        best = F.row_number().over(w.orderBy(F.desc("points"), "seed"))
        played = own.withColumn("won", best == 1).withColumn("both", F.sum("team").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
        games = played.where("n = 2").select(*league, "team", "seed", F.lit(round_).alias("round"), (F.col("both") - F.col("team")).alias("opponent"), "points", "won")
        out = games if out is None else out.unionByName(games)
        alive = played.where("won").select(*league, "team", "seed", F.col("pair").alias("slot"))
        size //= 2
    return out


# Decisions in hindsight


def pick_backtest(df: DataFrame, keys: list[str], row: str, forecast: str, actual: str) -> DataFrame:
    """(keys, picked, best, got, most, regret): of each group the row that the forecast takes, the one that was best,
    what they made and the gap; equals go to the smaller row."""
    first = lambda by: F.min_by(F.col(row), F.struct(-F.col(by), F.col(row)))
    value = lambda by: F.min_by(F.col(actual), F.struct(-F.col(by), F.col(row)))
    got = df.groupBy(*keys).agg(first(forecast).alias("picked"), first(actual).alias("best"), value(forecast).alias("got"), value(actual).alias("most"))
    return got.withColumn("regret", F.col("most") - F.col("got"))


def lineup_backtest(df: DataFrame, season: str, keys: list[str], row: str, forecast: str, actual: str, eligible: str, slots: Sequence[str]) -> DataFrame:
    """(season, n, got, best, share, right): over the lineups of each season what those chosen by forecast made, what
    the best could have made, their ratio and the share of lineups that were the best."""
    per = regret(df, [season, *keys], row, forecast, actual, eligible, slots)
    right = F.avg((F.abs("regret") < 1e-9).cast("double"))
    total = per.groupBy(season).agg(F.count("*").alias("n"), F.sum("got").alias("got"), F.sum("best").alias("best"), right.alias("right"))
    return total.select(season, "n", "got", "best", F.try_divide("got", "best").alias("share"), "right")


def capture_backtest(df: DataFrame, keys: list[str], row: str, forecast: str, actual: str, k: int) -> DataFrame:
    """(keys, got, most, share): what the k rows of a group that the forecast puts first made, what the best k made, and
    their ratio; equals go to the smaller row."""
    place = lambda by: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by), row))
    ranked = df.withColumn("__f", place(forecast)).withColumn("__a", place(actual)).where((F.col("__f") <= k) | (F.col("__a") <= k))
    total = lambda rank: F.sum(F.when(F.col(rank) <= k, F.col(actual)))
    return ranked.groupBy(*keys).agg(total("__f").alias("got"), total("__a").alias("most")).withColumn("share", F.try_divide("got", "most"))


def stream_backtest(df: DataFrame, week: list[str], group: str, team: str, row: str, forecast: str, actual: str) -> DataFrame:
    """(week, group, team, hold, stream, ceiling) of each team's rows; those without a team are free for all.

    hold: what the team's own best by forecast made; stream: what the best by forecast of its own and the free ones
    made, its own of equals; ceiling: the most that any of them made. The free ones come down to a row a week
    and group first, so that no team meets them all.
    """
    first = lambda c: F.min_by(F.col(c), F.struct(-F.col(forecast), F.col(row)))
    best = [F.max(forecast).alias("__f"), first(actual).alias("__a"), F.max(actual).alias("__m")]
    free = df.where(F.col(team).isNull()).groupBy(*week, group).agg(*best).select(*week, group, *(F.col(c).alias(f"__free{c}") for c in ("__f", "__a", "__m")))
    own = df.where(F.col(team).isNotNull()).groupBy(*week, group, team).agg(*best).join(free, [*week, group], "left")
    stream = F.when(F.col("__free__f") > F.col("__f"), F.col("__free__a")).otherwise(F.col("__a"))
    return own.select(*week, group, team, F.col("__a").alias("hold"), stream.alias("stream"), F.greatest("__m", "__free__m").alias("ceiling"))


def odds_invariants(odds: DataFrame, league: list[str], field: int, games: Column) -> DataFrame:
    """(league, name, got, want, ok): what must hold of any table of odds(wins, playoff, title): a win a game, a
    place in the field for each of `field`, one champion."""
    sums = odds.groupBy(*league).agg(F.sum("wins").alias("w"), F.sum("playoff").alias("p"), F.sum("title").alias("t"), F.max(games).alias("g"))
    laws = (("wins", "w", F.col("g"), 0.5), ("field", "p", F.lit(float(field)), 0.05), ("champion", "t", F.lit(1.0), 0.02))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).alias("got"), want.cast("double").alias("want"), F.lit(tol).alias("tol")) for n, c, want, tol in laws)))
    return sums.select(*league, rows.alias("r")).select(*league, "r.name", "r.got", "r.want", (F.abs(F.col("r.got") - F.col("r.want")) <= F.col("r.tol")).alias("ok"))


def noise_floor(se: Column, trials: Column, seeds: Column, least_seeds: int = 3, times: float = 2.9) -> Column:
    """The smallest difference in percentage points that paired runs can tell from none: `times` standard errors,
    the error being no less than a trial's step over the root of the seeds; null with too few seeds."""
    step = F.lit(100.0) / F.greatest(F.lit(1), trials) / F.sqrt(F.greatest(F.lit(1), seeds))
    return F.when(se.isNotNull() & (seeds >= least_seeds), times * F.greatest(se, step))


# Values of positions and backups


def group_multipliers(df: DataFrame, season: str, group: str, against: str, value: str) -> DataFrame:
    """(season, group, against, n, mult): the mean value of a group's rows against one opponent over that of all the
    group's rows of the season, shrunk to 1 by how well the seasons before tell the next: the correlation of a
    pair's multipliers in consecutive seasons, by group, 0 where there is none or it is below."""
    own = df.groupBy(season, group, against).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    all_ = df.groupBy(season, group).agg(F.sum(value).alias("all_s"), F.count(value).alias("all_n"))
    raw = own.join(all_, [season, group]).select(season, group, against, "n", F.try_divide(F.col("s") / F.col("n"), F.col("all_s") / F.col("all_n")).alias("raw"))
    last = raw.select((F.col(season) + 1).alias(season), group, against, F.col("raw").alias("last"))
    r = raw.join(last, [season, group, against]).groupBy(group).agg(F.corr("last", "raw").alias("r"))
    kept = F.greatest(F.lit(0.0), F.coalesce(F.when(~F.isnan("r"), F.col("r")), F.lit(0.0)))
    return raw.join(r, group, "left").select(season, group, against, "n", (1 + kept * (F.col("raw") - 1)).alias("mult"))


def expected_best(df: DataFrame, keys: list[str], value: str, available: str, tie: str, slots: int, out: str = "expected") -> DataFrame:
    """(keys, out): the expected sum of the best `slots` of a group's values when each row is there with its own
    chance, apart from the others. Exact: a row counts with the chance that it is there and fewer than `slots`
    better ones are, which a fold over the group's rows in order carries along. A group is a roster."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(tie).alias("t"), F.col(available).alias("a"))))
    zero = F.struct(F.array(*(F.lit(1.0 if k == 0 else 0.0) for k in range(slots))).alias("p"), F.lit(0.0).alias("s"))

    def step(acc, row):
        chance = F.aggregate(acc["p"], F.lit(0.0), lambda a, x: a + x)
        held = F.transform(acc["p"], lambda x, k: x * (1 - row["a"]) + F.when(k > 0, F.get(acc["p"], k - 1)).otherwise(F.lit(0.0)) * row["a"])
        return F.struct(held.alias("p"), (acc["s"] - row["v"] * row["a"] * chance).alias("s"))

    return df.groupBy(*keys).agg(F.aggregate(rows, zero, step, lambda acc: acc["s"]).alias(out))


def marginal_values(values: Sequence[float], chances: Sequence[float], positions: Sequence[str], slots: Sequence[str]) -> tuple[float, list[float]]:
    """The expected sum of the best lineup out of who is there, each row with its own chance and apart from the others, and
    what that sum would lose without each row.

    Rows are taken by value, and one that is there starts if those that do can still be seated with it: a matroid, so that
    this is the best lineup. All that matters of the rows before is how many of each position started, up to what the
    slots can seat, dedicated and flexible ones alike. One fold down the rows gives the chance of each such state before a
    row, one up the rows what is to be expected from it on; without a row the two meet around its gap.
    """
    order = sorted((i for i in range(len(values)) if values[i] > 0), key=lambda i: (-values[i], i))
    kinds = sorted({positions[i] for i in order})
    seatable = functools.cache(lambda counts: sum(s is not None for s in assign([1.0] * sum(counts), [[k] for k, n in zip(kinds, counts) for _ in range(n)], slots)) == sum(counts))

    def after(state: tuple[int, ...], i: int) -> tuple[int, ...] | None:
        k = kinds.index(positions[i])
        more = (*state[:k], state[k] + 1, *state[k + 1 :])
        return more if seatable(more) else None

    before: list[dict[tuple[int, ...], float]] = [{(0,) * len(kinds): 1.0}]
    for i in order:
        now: dict[tuple[int, ...], float] = {}
        for state, p in before[-1].items():
            more = after(state, i)
            now[state] = now.get(state, 0.0) + (p if more is None else p * (1 - chances[i]))
            if more is not None:
                now[more] = now.get(more, 0.0) + p * chances[i]
        before.append(now)
    lost = [0.0] * len(values)
    ahead = dict.fromkeys(before[-1], 0.0)
    for at in range(len(order) - 1, -1, -1):
        i, now = order[at], {}
        for state in before[at]:
            more = after(state, i)
            now[state] = ahead[state] if more is None else chances[i] * (values[i] + ahead[more]) + (1 - chances[i]) * ahead[state]
        lost[i] = sum(p * (now[state] - ahead[state]) for state, p in before[at].items())
        ahead = now
    return ahead[(0,) * len(kinds)], lost


def lineup_marginals(df: DataFrame, keys: list[str], row: str, value: str, chance: str, position: str, slots: Sequence[str], most_rows: int = 10_000) -> DataFrame:
    """(keys, row, expected, marginal): marginal_values of each group, which is a roster: more than most_rows rows are an
    error. Null values count as 0, null chances as 0, chances are held between 0 and 1; rows of no worth add nothing."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*keys, row))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > most_rows:
            raise ValueError(f"a roster has more than {most_rows} rows")
        frame = frame.sort_values(row)
        total, lost = marginal_values(frame["__value"].tolist(), frame["__chance"].tolist(), frame["__position"].tolist(), slots)
        return frame[[*keys, row]].assign(expected=total, marginal=lost)

    chance_ = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(F.col(chance).cast("double"), F.lit(0.0)), F.lit(0.0))))
    own = df.select(*keys, row, F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("__value"), chance_.alias("__chance"), F.coalesce(position, F.lit("")).alias("__position"))
    return own.groupBy(*keys).applyInPandas(one, f"{kinds}, expected double, marginal double")


def backup_board(df: DataFrame, keys: list[str], row: str, value: str, miss: str, weeks: int) -> DataFrame:
    """(keys, row, lead, gain): for every row behind the best of its group, what it is worth over the weeks left: the
    lead's rate less its own, times the weeks that the lead is expected to miss. Leads worth nothing have no backups."""
    place = Window.partitionBy(*keys).orderBy(F.desc(value), row)
    ranked = df.select(*keys, row, value, miss).withColumn("place", F.row_number().over(place))
    lead = ranked.where((F.col("place") == 1) & (F.col(value) > 0)).select(*keys, F.col(row).alias("lead"), F.col(value).alias("lead_value"), F.col(miss).alias("lead_miss"))
    gain = (F.col("lead_value") - F.col(value)) / weeks * F.col("lead_miss") * weeks
    return ranked.where("place > 1").join(lead, keys).select(*keys, row, "lead", gain.alias("gain"))


# Lineage


def lineage_edges(producers: DataFrame) -> DataFrame:
    """(source, target) table edges of producers(name, reads array, writes array)."""
    return producers.select(F.explode("reads").alias("source"), "writes").select("source", F.explode("writes").alias("target")).distinct()


def depths(edges: DataFrame, most: int = 64) -> DataFrame:
    """(node, depth): the longest way to each node from one without sources. ValueError if there is a cycle.

    Kahn's layers as joins: each round takes the nodes all of whose sources are placed. What is placed, a row a
    table of the lineage, is persisted from round to round.
    """
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    placed = nodes.join(edges.select(F.col("target").alias("node")), "node", "left_anti").withColumn("depth", F.lit(0))
    for depth in range(1, most):
        left = nodes.join(placed, "node", "left_anti")
        if left.isEmpty():
            return placed
        waiting = edges.join(left.select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node"))
        ready = left.join(waiting, "node", "left_anti")
        if ready.isEmpty():
            raise ValueError("the lineage has a cycle")
        placed = placed.unionByName(ready.withColumn("depth", F.lit(depth))).persist()
    raise ValueError("the lineage is too deep")
