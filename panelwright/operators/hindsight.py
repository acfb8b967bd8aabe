"""Decision rules replayed over what really happened: rosters week by week under a policy, claims against the pool they
were made from, and bids against those that won."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import dealt, parts_for
from .decisions import assign


class Member(NamedTuple):
    """A player in a week as it was known before it (but for points, which no policy may look at)."""

    player: int
    pos: str
    proj: float
    form: float
    extra: float
    available: bool
    points: float


class State(NamedTuple):
    week: int
    roster: list[Member]
    free: list[Member]
    slots: Sequence[str]


#: A decision rule: the players that it holds after a state, out of roster and free and no more than the roster has.
Policy = Callable[[State], list[int]]


def stand_pat(state: State) -> list[int]:
    return [m.player for m in state.roster]


class _Rooms:
    """Which positions can still start when those of some players do: steps[taken, position] is what is taken then, or None
    if no slot can be freed for it. There are few of these, so they are found once."""

    def __init__(self, slots: tuple[str, ...]):
        self.slots, self.steps = slots, {}

    def step(self, taken: tuple[str, ...], pos: str) -> tuple[str, ...] | None:
        key = taken, pos
        if key not in self.steps:
            more = tuple(sorted((*taken, pos)))
            self.steps[key] = more if None not in assign([1.0] * len(more), [[p] for p in more], self.slots) else None
        return self.steps[key]


@functools.lru_cache(64)
def _rooms(slots: tuple[str, ...]) -> _Rooms:
    return _Rooms(slots)


def starters(members: Sequence[Member], values: Sequence[float], slots: Sequence[str], taken: tuple[str, ...] = ()) -> list[int]:
    """The indices, in order, of those whom assign gives a seat; positions that are taken already count as seated."""
    rooms, full, out = _rooms(tuple(slots)), len(slots), []
    steps = rooms.steps
    for i in sorted(range(len(values)), key=[-v for v in values].__getitem__):
        if len(taken) == full:
            break
        if values[i] >= 0:
            key = taken, members[i].pos
            more = steps[key] if key in steps else rooms.step(*key)
            if more is not None:
                taken = more
                out.append(i)
    out.sort()
    return out


def filled(members: Sequence[Member], slots: Sequence[str], value: Callable[[Member], float] = lambda m: 1.0) -> tuple[int, float]:
    """How many slots the members can fill, and the sum of values of the best of them that do."""
    values = [value(m) for m in members]
    seated = starters(members, values, slots)
    return len(seated), sum(values[i] for i in seated)


def projected(members: Sequence[Member], slots: Sequence[str], taken: tuple[str, ...] = ()) -> float:
    """The sum of projections of the best projected lineup."""
    values = [m.proj for m in members]
    return sum([values[i] for i in starters(members, values, slots, taken)])


@functools.lru_cache(1 << 16)
def _seated(positions: tuple[str, ...], slots: tuple[str, ...]) -> int:
    return sum(s is not None for s in assign([1.0] * len(positions), [[p] for p in positions], slots))


def fills(members: Sequence[Member], slots: Sequence[str]) -> int:
    """How many slots the members can fill, which their positions alone decide."""
    return _seated(tuple(sorted([m.pos for m in members])), tuple(slots))


def entry_price(members: Sequence[Member], base: float, pos: str, slots: Sequence[str]) -> float:
    """What the best projected lineup of the members, which makes base, loses if one more player of that position
    starts: one of projection x adds x less this, or nothing. Sets of players that can start are a matroid, so who
    makes room depends on the position alone."""
    taken = _rooms(tuple(slots)).step((), pos)
    return base - projected(members, slots, taken) if taken else float("inf")


#: What counts as more, and how far sums by prices and by whole lineups can differ by rounding, as a share of the values.
LEAST_GAIN = 1e-9
ROUNDING = 3e-14


def _slack(*members: Sequence[Member]) -> float:
    return ROUNDING * (1.0 + sum(abs(m.proj) for own in members for m in own))


def _gain(x: float, price: float) -> float:
    return x - price if x > price else 0.0


def to_drop(state: State, value: Callable[[Member], float] = lambda m: m.proj) -> Member | None:
    """The member of least value (of equal ones the smallest player) without whom all slots can still be filled; None
    if there is none."""
    need = len(state.slots)
    for m in sorted(state.roster, key=lambda m: (value(m), m.player)):
        if fills([x for x in state.roster if x.player != m.player], state.slots) >= need:
            return m
    return None


def claim(by: Callable[[Member], float], keep: Callable[[Member], float] = lambda m: m.proj) -> Policy:
    """Takes the free player who is best by `by` (of equal ones the better projected, then the smallest) for the member that
    to_drop gives by `keep`, if `by` is higher than that one's; else stands pat."""

    def policy(state: State) -> list[int]:
        out = to_drop(state, keep) if state.free else None
        if out is None:
            return stand_pat(state)
        best = min(state.free, key=lambda m: (-by(m), -m.proj, m.player))
        if by(best) <= by(out):
            return stand_pat(state)
        return [m.player for m in state.roster if m.player != out.player] + [best.player]

    return policy


#: Claims by projection, by points of late, and by projection with what a backup is worth kept from being dropped.
no_worse_claim = claim(lambda m: m.proj)
trailing_form = claim(lambda m: m.form)
backup_aware = claim(lambda m: m.proj + m.extra, keep=lambda m: m.proj + m.extra)


def lineup_upgrade(state: State) -> list[int]:
    """Takes the free player who adds most to the projected lineup, if any adds to it, for the one that to_drop gives."""
    out = to_drop(state)
    if out is None:
        return stand_pat(state)
    left = [m for m in state.roster if m.player != out.player]
    best, gain, base = None, 0.0, projected(left, state.slots)
    price: dict[str, float] = {}
    slack = _slack(left)
    for m in sorted(state.free, key=lambda m: (-m.proj, m.player)):
        if m.proj <= gain:
            break
        if m.pos not in price:
            price[m.pos] = entry_price(left, base, m.pos, state.slots)
        if _gain(m.proj, price[m.pos]) + slack <= gain + LEAST_GAIN:
            continue
        more = projected([*left, m], state.slots) - base
        if more > gain + LEAST_GAIN:
            best, gain = m, more
    return [m.player for m in left] + [best.player] if best else stand_pat(state)


def season_fold(rows: Sequence[tuple], policy: Policy, slots: Sequence[str]) -> list[tuple[int, int, int, float, float]]:
    """(week, team, moves, points, best) of one league's season. rows are (week, team, player, pos, proj, form, extra,
    available, points); a team's roster is what it has in the first week, and from then on what the policy makes of it.

    In each week the teams decide in turn, those with the fewest points so far first, so that no two hold one player;
    then the lineup that is best by projection plays. best is what the roster's best lineup would have made. A player
    without a row in a week is not available in it.
    """
    weeks: dict[int, dict[int, Member]] = {}
    teams: dict[int, list[int]] = {}
    known: dict[int, str] = {}
    first = min((r[0] for r in rows), default=0)
    for week, team, player, pos, proj, form, extra, available, points in sorted(rows, key=lambda r: (r[0], r[2])):
        weeks.setdefault(week, {})[player] = Member(player, pos, proj, form, extra, available, points)
        known[player] = pos
        if week == first and team is not None:
            teams.setdefault(team, []).append(player)
    total, out = dict.fromkeys(teams, 0.0), []
    for week, players in sorted(weeks.items()):
        held, moves = {p for own in teams.values() for p in own}, {}
        for team in sorted(teams, key=lambda t: (total[t], t)):
            roster = [players.get(p) or Member(p, known[p], 0.0, 0.0, 0.0, False, 0.0) for p in teams[team]]
            free = [m for p, m in players.items() if p not in held]
            new = policy(State(week, roster, free, slots))
            if len(set(new)) != len(new) or len(new) > max(len(roster), 1) or not set(new) <= {m.player for m in (*roster, *free)}:
                raise ValueError("a policy holds players that it can't have")
            moves[team] = len(set(new) - set(teams[team]))
            held = held - set(teams[team]) | set(new)
            teams[team] = new
        for team in sorted(teams):
            ready = [m for p in teams[team] if (m := players.get(p)) and m.available]
            points = sum(ready[i].points for i in starters(ready, [m.proj for m in ready], slots))
            total[team] += points
            out.append((week, team, moves[team], points, filled(ready, slots, lambda m: m.points)[1]))
    return out


class _Side:
    """A roster's projected lineup, and what it is without each member: worked out once for all trades of a week."""

    def __init__(self, members: Sequence[Member], slots: Sequence[str]):
        self.members, self.slots, self.need, self.base = members, slots, fills(members, slots), projected(members, slots)
        rest = [(m, [x for x in members if x.player != m.player]) for m in sorted(members, key=lambda m: m.player)]
        self.without = [(m, left, projected(left, slots), {}) for m, left in rest]

    def likely(self, left: Sequence[Member], base: float, price: dict[str, float], m: Member) -> float:
        """What m adds to the projected lineup if it comes to those left, whose lineup makes base, by prices."""
        if m.pos not in price:
            price[m.pos] = entry_price(left, base, m.pos, self.slots)
        return base + _gain(m.proj, price[m.pos]) - self.base


def best_trade(us: Sequence[Member], others: dict[int, Sequence[Member]], slots: Sequence[str], gap: float) -> tuple[int, Member, Member, float, float] | None:
    """(their team, whom we give, whom we get, our gain, theirs) of the one-for-one trade that adds most to our projected
    lineup, of those between players whose projections are no more than gap apart, after which both sides can still fill
    what slots they could, and which doesn't lower their projected lineup. Of equal ones the first by team, given and got
    player; None if no trade adds anything."""
    return _best_trade(_Side(us, slots), {team: _Side(them, slots) for team, them in others.items()}, slots, gap)


def _best_trade(us: _Side, others: dict[int, _Side], slots: Sequence[str], gap: float) -> tuple[int, Member, Member, float, float] | None:
    best, least = None, LEAST_GAIN
    for team, them in sorted(others.items()):
        slack = _slack(us.members, them.members)
        for give, left, left_base, price in us.without:
            for get, rest, rest_base, their_price in them.without:
                if abs(give.proj - get.proj) > gap:
                    continue
                # most trades are out by their prices; what these leave is settled by the lineups themselves
                if us.likely(left, left_base, price, get) + slack <= least or them.likely(rest, rest_base, their_price, give) + slack < -LEAST_GAIN:
                    continue
                ours = [*left, get]
                gain = projected(ours, slots) - us.base
                if gain <= least or fills(ours, slots) < us.need:
                    continue
                theirs = [*rest, give]
                their_gain = projected(theirs, slots) - them.base
                if their_gain >= -LEAST_GAIN and fills(theirs, slots) >= them.need:
                    best, least = (team, give, get, gain, their_gain), gain + LEAST_GAIN
    return best


def season_trades(rows: Sequence[tuple], slots: Sequence[str], gap: float) -> list[tuple]:
    """(week, team, partner, given, got, gain, ours, theirs) for each week but the last and each team that has a best_trade
    among the rosters of that week: what its lineup was projected to gain, and what the trade would have added to either
    side's best lineups from that week to the end of the season. rows are those of season_fold."""
    weeks: dict[int, dict[int, Member]] = {}
    rosters: dict[int, dict[int, list[int]]] = {}
    for week, team, player, pos, proj, form, extra, available, points in sorted(rows, key=lambda r: (r[0], r[2])):
        weeks.setdefault(week, {})[player] = Member(player, pos, proj, form, extra, available, points)
        if team is not None:
            rosters.setdefault(week, {}).setdefault(team, []).append(player)

    def realised(players: Sequence[int], since: int) -> float:
        return sum(filled([m for p in players if (m := now.get(p)) and m.available], slots, lambda m: m.points)[1] for w, now in weeks.items() if w >= since)

    out = []
    for week in sorted(weeks)[:-1]:
        teams = {t: [weeks[week][p] for p in own] for t, own in rosters.get(week, {}).items()}
        sides = {t: _Side(m, slots) for t, m in teams.items()}
        for team, us in sorted(teams.items()):
            found = _best_trade(sides[team], {t: side for t, side in sides.items() if t != team}, slots, gap)
            if found:
                partner, give, get, gain, _ = found
                swap = lambda members, out_, in_: [m.player for m in members if m.player != out_.player] + [in_.player]
                ours = realised(swap(us, give, get), week) - realised([m.player for m in us], week)
                theirs = realised(swap(teams[partner], get, give), week) - realised([m.player for m in teams[partner]], week)
                out.append((week, team, partner, give.player, get.player, gain, ours, theirs))
    return out


PANEL = ("week", "team", "player", "pos", "proj", "form", "extra", "available", "points")


def replay(panel: DataFrame, keys: list[str], policies: dict[str, Policy], slots: Sequence[str], most_rows: int = 200_000) -> DataFrame:
    """(keys, policy, week, team, moves, points, best) of panel(keys, PANEL), by season_fold of each policy over each league's
    season (keys). A league's season is what one task folds: more than most_rows rows of one are an error. Null
    projections, form, extras and points are 0, null availability is true; rows without a week or player are left out."""

    def run(rows: list[tuple]) -> list[tuple]:
        return [(name, *r) for name, policy in policies.items() for r in season_fold(rows, policy, slots)]

    return _by_season(panel, keys, run, "policy string, week int, team long, moves int, points double, best double", most_rows)


def trade_backtest(panel: DataFrame, keys: list[str], slots: Sequence[str], gap: float, most_rows: int = 200_000) -> DataFrame:
    """(keys, week, team, partner, given, got, gain, ours, theirs) of panel(keys, PANEL), by season_trades of each league's
    season; odd rows count as in replay."""
    schema = "week int, team long, partner long, given long, got long, gain double, ours double, theirs double"
    return _by_season(panel, keys, lambda rows: season_trades(rows, slots, gap), schema, most_rows)


def _by_season(panel: DataFrame, keys: list[str], fold: Callable[[list[tuple]], list[tuple]], schema: str, most_rows: int) -> DataFrame:
    """(keys, schema): fold of the PANEL rows of each league's season, in a task."""
    kinds = dict(panel.dtypes)
    names = [*keys, *(c.split()[0] for c in schema.split(", "))]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > most_rows:
            raise ValueError(f"the season {key} has more than {most_rows} rows")
        rows = [(int(w), None if pd.isna(t) else int(t), int(p), pos, pr, fo, ex, av, po) for w, t, p, pos, pr, fo, ex, av, po in frame[list(PANEL)].itertuples(index=False)]
        return pd.DataFrame([(*key, *r) for r in fold(rows)], columns=names)

    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    own = panel.where("week is not null and player is not null").select(
        *keys, F.col("week").cast("int").alias("week"), F.col("team").cast("long").alias("team"), F.col("player").cast("long").alias("player"), F.coalesce("pos", F.lit("")).alias("pos"),
        number("proj"), number("form"), number("extra"), F.coalesce("available", F.lit(True)).alias("available"), number("points"),
    )
    return own.groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + schema)


def waiver_backtest(panel: DataFrame, adds: DataFrame, pool: DataFrame, season: list[str], week: str, player: str, group: str, forecast: str, points: str) -> DataFrame:
    """(season, week, k, room, ours, ceiling, room_ceiling, ours_ceiling): of each week in which the room added k players, the
    mean points a game from that week to the end of the season of those it added, of the k of the pool that the forecast ranks
    best, and of the k that were best; and the ceilings of each side's own mix of groups.

    panel(season, week, player, points) is what happened, adds(season, week, player, group) the claims, pool(season, week,
    player, group, forecast) who could be claimed. A player without games from that week on has no points and counts in no
    mean; one without a forecast isn't ranked. Ties go to the smaller player.

    Games, claims and pool meet once by season and player, where a window from the season's end gives each its rate, and once
    by week, where the pool is ranked by forecast. Which of equal rates is taken changes no mean, so the rest is
    worked out over how many of a week and group have each rate.
    """
    keys = [*season, week]
    games = panel.dropna(subset=[*keys, player, points]).select(*keys, player, F.col(points).alias("__points"), F.lit(0).alias("__kind"))
    claims = adds.select(*keys, player, group, F.lit(1).alias("__kind"))
    could = pool.select(*keys, player, group, F.col(forecast).alias("__forecast"), F.lit(2).alias("__kind"))
    every = could.unionByName(claims, allowMissingColumns=True).unionByName(games, allowMissingColumns=True)
    ahead = Window.partitionBy(*season, player).orderBy(F.desc(week)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    every = every.withColumn("__rate", F.when(F.col(week).isNotNull(), F.avg("__points").over(ahead))).where("__kind = 1 or __kind = 2 and (__rate is not null or __forecast is not null)")
    is_claim, is_could = (F.col("__kind") == 1).cast("long"), (F.col("__kind") == 2).cast("long")
    own = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("__forecast"), is_claim, player)  # claims stand behind the ranked
    ranked = every.withColumn("__place", F.row_number().over(own)).withColumn("k", F.sum(is_claim).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("k > 0")
    chosen = (is_could == 1) & F.col("__forecast").isNotNull() & (F.col("__place") <= F.col("k"))
    rates = ranked.groupBy(*keys, "k", group, "__rate").agg(F.sum(is_could).alias("__n"), F.sum(is_claim).alias("__room"), F.sum(chosen.cast("long")).alias("__ours"))
    best = lambda *by: Window.partitionBy(*by).orderBy(F.desc_nulls_last("__rate")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    side = Window.partitionBy(*keys, group)
    rates = rates.withColumns({
        "__room_n": F.when(F.col(group).isNotNull(), F.sum("__room").over(side)).otherwise(0), "__ours_n": F.sum("__ours").over(side),
        "__up": F.sum("__n").over(best(*keys)), "__up_in": F.sum("__n").over(best(*keys, group)),
    })
    # how many of a rate are among the first so many, if so many stand up to and with it
    among = lambda first, up: F.greatest(F.lit(0), F.least(F.col("__n"), F.col(first) - F.col(up) + F.col("__n")))
    n_of = {"room": F.col("__room"), "ours": F.col("__ours"), "ceiling": among("k", "__up"), "room_ceiling": among("__room_n", "__up_in"), "ours_ceiling": among("__ours_n", "__up_in")}
    mean = lambda n: F.sum(F.when(n > 0, F.col("__rate") * n)) / F.sum(F.when((n > 0) & F.col("__rate").isNotNull(), n))
    found = rates.groupBy(*keys, "k").agg(*(mean(n).alias(name) for name, n in n_of.items()))
    return found.select(*(F.col(c).cast(adds.schema[c].dataType).alias(c) for c in keys), "k", *n_of)


def bid_replay(wanted: DataFrame, claims: DataFrame, season: list[str], week: str, team: str, player: str, bid: str, budget: Column) -> DataFrame:
    """wanted(season, week, team, player, bid) with remaining, offered, room, contested, won and tie: what each bid would have
    met. room is the highest bid of the other teams for the player in that week in claims(season, week, team, player, bid,
    won); offered is the bid, but no more than remaining: the budget less what the team's own claims won for in earlier weeks,
    0 at least. A bid wins above the room's, or where nobody else bid; an equal one is a tie. Both tables are counted first
    and dealt out by their rows, so that a task's share stays the same."""
    keys, own = [*season, week, player], [*season, team, week]
    parts = parts_for(claims.sparkSession, max(claims.count(), wanted.count()))
    before = Window.partitionBy(*season, team).orderBy(week).rangeBetween(Window.unboundedPreceding, -1)
    paid = claims.select(*own, F.when(F.col("won"), F.col(bid)).alias("__paid")).unionByName(wanted.select(*own, F.lit(None).alias("__paid")))
    weeks = dealt(paid, parts, *season, team).groupBy(*own).agg(F.sum("__paid").alias("__paid"))
    weeks = weeks.withColumn("__before", F.coalesce(F.sum("__paid").over(before), F.lit(0))).select(*own, "__before")
    # the best bid of a player, and the best of another team than the one that made it
    by_team = dealt(claims, parts, *keys).groupBy(*keys, team).agg(F.max(bid).alias("__bid"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__bid"), team))
    two = by_team.withColumn("__place", place).where("__place <= 2").groupBy(*keys).agg(F.max(F.when(F.col("__place") == 1, F.col(team))).alias("__team"), F.max("__bid").alias("__one"), F.max(F.when(F.col("__place") == 2, F.col("__bid"))).alias("__two"))
    met = dealt(dealt(wanted, parts, *own).join(dealt(weeks, parts, *own), own, "left"), parts, *keys).join(two, keys, "left")
    room = F.when(F.col("__team") == F.col(team), F.col("__two")).otherwise(F.col("__one"))
    met = met.withColumn("remaining", F.greatest(F.lit(0), budget - F.col("__before"))).withColumn("offered", F.least(bid, "remaining")).withColumn("room", room)
    contested = F.col("room").isNotNull()
    return met.select(*wanted.columns, "remaining", "offered", "room", contested.alias("contested"), (~contested | F.coalesce(F.col("offered") > F.col("room"), F.lit(False))).alias("won"), (contested & F.coalesce(F.col("offered") == F.col("room"), F.lit(False))).alias("tie"))


def promotion_backtest(ranks: DataFrame, panel: DataFrame, season: list[str], week: str, group: list[str], player: str, rank: str, points: str, form: str, out: str, ahead: int = 4) -> DataFrame:
    """(season, group, week, lead, lead_form, backup, backup_form, points, ahead_mean, ahead_games): each promotion that a
    published ranking shows, and what came of it. A second of the week before is a first now, and a first of the week
    before is none any more and out this week; of several, the lead is the one of the highest form and the backup the
    smallest player (so are ties). Points are those of the week, ahead_mean of this and the ahead - 1 weeks after.

    ranks(season, week, group, player, rank) may name a player more than once: the best place counts. panel(season, week,
    player, points, form, out) has what is known and what came, a row a player and week; null points are 0, a null form
    counts as 0, a null out as no. Rows without week, player or rank tell nothing; a backup without a row is none.
    Weeks meet by a join on the next week; no window holds more than a player's season.
    """
    at = [*season, *group, week]
    best = ranks.dropna(subset=[week, player, rank]).groupBy(*at, player).agg(F.min(rank).alias("__now"))
    before = best.select(*season, *group, (F.col(week) + 1).cast(best.schema[week].dataType).alias(week), player, F.col("__now").alias("__before")).where("__before <= 2")
    moved = before.join(best, [*at, player], "left")
    rose = moved.where("__before = 2 and __now = 1").groupBy(*at).agg(F.min(player).alias("backup"))
    following = Window.partitionBy(*season, player).orderBy(week).rangeBetween(0, ahead - 1)
    known = panel.dropna(subset=[week, player]).select(*season, week, player, F.coalesce(F.col(points).cast("double"), F.lit(0.0)).alias("points"), F.col(form).alias("__form"), F.coalesce(F.col(out).cast("boolean"), F.lit(False)).alias("__out"))
    gone = moved.where("__before = 1 and (__now is null or __now > 1)").join(known.where("__out").select(*season, week, player, "__form"), [*season, week, player])
    lead = gone.groupBy(*at).agg(F.min(F.struct((-F.coalesce("__form", F.lit(0.0))).alias("__key"), F.col(player).alias("lead"), F.col("__form").alias("lead_form"))).alias("__lead"))
    came = known.withColumn("ahead_mean", F.avg("points").over(following)).withColumn("ahead_games", F.count("*").over(following)).withColumnRenamed(player, "backup").withColumnRenamed("__form", "backup_form")
    met = rose.join(lead, at).join(came, [*season, week, "backup"])
    return met.select(*at, "__lead.lead", "__lead.lead_form", "backup", "backup_form", "points", "ahead_mean", "ahead_games")


def backup_lift(panel: DataFrame, season: str, week: str, team: str, pos: str, player: str, points: str, weeks: int, leads: int = 36, backups: int = 2) -> DataFrame:
    """(season, team, pos, depth_order, lead, backup, base, lead_base, lead_missed, played_weeks, active_weeks,
    observed_base, observed_active, realised): of each team and position the lead by the season before, if it was among
    the `leads` best of its position, and its `backups` next; and what a backup made in weeks with and without the lead.

    panel(season, week, team, pos, player, points) has a row for each week played, 1 to `weeks`. base and lead_base are the
    season before by `weeks`; the one week in which nobody of a team played is nobody's miss. observed_base is base
    where the lead was in every week of the backup; observed_active is null if in none he was out; realised is what the
    backup made beyond observed_base in weeks without the lead. Players without points the season before are neither;
    ties go to the smaller player; rows with a null key tell nothing and null points are 0. The best of a position and of a
    team are found by limits a group that apply before rows are shuffled.
    """
    own = panel.dropna(subset=[season, week, team, pos, player]).select(F.col(season).alias("season"), F.col(week).alias("week"), F.col(team).alias("team"), F.col(pos).alias("pos"), F.col(player).alias("player"), F.coalesce(F.col(points).cast("double"), F.lit(0.0)).alias("points"))
    kind = own.schema["season"].dataType
    prior = own.groupBy("season", "pos", "player").agg(F.sum("points").alias("prior")).withColumn("season", (F.col("season") + 1).cast(kind)).where("prior > 0")
    by = [F.desc("prior"), F.col("player")]
    top = prior.withColumn("__rank", F.row_number().over(Window.partitionBy("season", "pos").orderBy(*by))).where(F.col("__rank") <= leads).select("season", "pos", F.col("player").alias("lead"))
    men = own.select("season", "team", "pos", "player").distinct().join(prior, ["season", "pos", "player"])
    order = men.withColumn("depth_order", F.row_number().over(Window.partitionBy("season", "team", "pos").orderBy(*by))).where(F.col("depth_order") <= backups + 1)
    lead = order.where("depth_order = 1").select("season", "team", "pos", F.col("player").alias("lead"), (F.col("prior") / weeks).alias("lead_base")).join(top, ["season", "pos", "lead"])
    pairs = order.where("depth_order > 1").select("season", "team", "pos", "depth_order", F.col("player").alias("backup"), (F.col("prior") / weeks).alias("base")).join(lead, ["season", "team", "pos"])
    there = own.select("season", "team", "week").distinct().groupBy("season", "team").agg(F.when(F.count("*") == weeks - 1, F.lit(weeks * (weeks + 1) // 2) - F.sum("week")).alias("bye"))
    pairs = pairs.join(there, ["season", "team"])
    mine = own.groupBy("season", "team", "pos", "player", "week").agg(F.sum("points").alias("points"))
    in_play = F.col("bye").isNull() | (F.col("week") != F.col("bye"))
    lead_weeks = mine.select("season", "team", "pos", F.col("player").alias("lead"), "week", F.lit(True).alias("__with"))
    met = pairs.join(mine.withColumnRenamed("player", "backup"), ["season", "team", "pos", "backup"], "left").where(in_play).join(lead_weeks, ["season", "team", "pos", "lead", "week"], "left")
    inside, alone = F.col("__with").isNotNull(), F.col("__with").isNull()
    keys = ["season", "team", "pos", "depth_order", "lead", "backup", "base", "lead_base", "bye"]
    seen = met.groupBy(*keys).agg(F.count(F.when(inside, 1)).alias("played_weeks"), F.count(F.when(alone, 1)).alias("active_weeks"), F.avg(F.when(inside, F.col("points"))).alias("__base"), F.avg(F.when(alone, F.col("points"))).alias("observed_active"), F.coalesce(F.sum(F.when(alone, F.col("points"))), F.lit(0.0)).alias("__sum"))
    held = lead.join(there, ["season", "team"]).join(lead_weeks, ["season", "team", "pos", "lead"]).where(in_play).groupBy("season", "team", "pos", "lead").agg(F.count("*").alias("__lead_weeks"))
    seen = seen.join(held, ["season", "team", "pos", "lead"], "left").withColumn("observed_base", F.coalesce("__base", "base"))
    playable = F.lit(weeks) - F.col("bye").isNotNull().cast("int")
    return seen.select(*keys[:-1], (playable - F.coalesce("__lead_weeks", F.lit(0))).cast("long").alias("lead_missed"), "played_weeks", "active_weeks", "observed_base", "observed_active", (F.col("__sum") - F.col("active_weeks") * F.col("observed_base")).alias("realised"))
