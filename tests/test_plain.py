"""Queries that SQL can't express, each against a plain computation of the whole result."""

import itertools
import math
from collections import Counter, defaultdict
from statistics import NormalDist

import numpy as np
import pytest
import xxhash

from panelwright.functions import numbers
from panelwright.operators import decisions, models
from panelwright.plans import catalog

QUERIES = catalog.queries()
SLOTS = ["QB", "RB", "RB", "WR", "FLEX"]
TESTED = {"jn17_resolve_or_mint", "tk05_assignment", "mx10_regret", "mx11_lineup_backtest", "mt02_curves", "ml15_quantile_fit", "ml16_boosted_mean", "ml16_boosted_chance", "ml17_logistic", "mx07_bootstrap", "vl04_power_ratings", "mc01_keyed_draws", "sm03_alerts", "vl08_marginals"}


def rows(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def hashed(*keys):
    """XXH64 of one key after the other, each seeded by the hash of those before."""
    seed = 42
    for k in keys:
        seed = xxhash.xxh64_intdigest(k.encode() if isinstance(k, str) else k, seed)
    return seed


def four(x):
    return int(x).to_bytes(4, "little", signed=True)


def eight(x):
    return int(x).to_bytes(8, "little", signed=True)


#: By the tests of their own modules.
ELSEWHERE = {"mx09_cpcv_fits", "mx08_shuffle_null", "ml16_boosted_quantiles", "mx11_policy_replay", "mx11_policy_effect", "mx11_trade_backtest"}


def test_every_query_without_sql_is_tested_here_or_elsewhere():
    assert TESTED | ELSEWHERE == set(QUERIES) - set(catalog.oracles())


def roster(spark, sf):
    out = defaultdict(list)
    for r in rows(spark, sf, "customer"):
        own = {"BUILDING": "RB", "AUTOMOBILE": "RB", "MACHINERY": "QB"}.get(r.c_mktsegment, "WR")
        out[r.c_nationkey].append((r.c_custkey, r.c_acctbal, abs(r.c_acctbal - r.c_custkey), {own} | ({"QB"} if r.c_custkey % 3 == 0 else set())))
    return out


def best_total(players):
    """The largest sum of values over all ways to fill the slots, empty ones allowed: every set of slots by recursion."""
    admits = [set(decisions.admitted(s)) for s in SLOTS]
    totals = {0: 0.0}  # filled slots -> best sum
    for value, positions in players:
        for filled, total in list(totals.items()):
            for s, fit in enumerate(admits):
                if not filled >> s & 1 and positions & fit and value >= 0:
                    key = filled | 1 << s
                    totals[key] = max(totals.get(key, -1.0), total + value)
    return max(totals.values())


def test_assignment_is_the_best_of_all(spark, sf):
    teams, chosen = roster(spark, sf), defaultdict(list)
    for r in QUERIES["tk05_assignment"](spark, sf).collect():
        chosen[r.c_nationkey].append((r.c_custkey, r.slot))
    for nation, players in teams.items():
        by_id = {p[0]: p for p in players}
        assert len({s for _, s in chosen[nation]}) == len(chosen[nation]) == len({c for c, _ in chosen[nation]})
        for c, slot in chosen[nation]:
            assert by_id[c][3] & set(decisions.admitted(slot[:-1])) and SLOTS[int(slot[-1])] == slot[:-1]
        assert sum(by_id[c][1] for c, _ in chosen[nation]) == pytest.approx(best_total([(p[1], p[3]) for p in players]))


def regrets(spark, sf):
    out = {}
    for nation, players in roster(spark, sf).items():
        slot = decisions.assign([p[2] for p in sorted(players)], [sorted(p[3]) for p in sorted(players)], SLOTS)
        out[nation] = (best_total([(p[1], p[3]) for p in players]), sum(p[1] for p, s in zip(sorted(players), slot) if s is not None))
    return out


def test_regret(spark, sf):
    want = regrets(spark, sf)
    got = {r.c_nationkey: (r.best, r.got, r.regret) for r in QUERIES["mx10_regret"](spark, sf).collect()}
    assert got and all(got[n] == pytest.approx((b, g, b - g), abs=1e-6) and b - g >= -1e-9 for n, (b, g) in want.items() if n in got)
    assert {n for n, (b, g) in want.items() if b and g} <= set(got)


def test_lineup_backtest(spark, sf):
    want, region = regrets(spark, sf), {r.n_nationkey: r.n_regionkey for r in rows(spark, sf, "nation")}
    by = defaultdict(list)
    for n, pair in want.items():
        by[region[n]].append(pair)
    got = {r.season: r for r in QUERIES["mx11_lineup_backtest"](spark, sf).collect()}
    assert set(got) == set(by)
    for season, pairs in by.items():
        best, made = (sum(p[k] for p in pairs) for k in (0, 1))
        r = got[season]
        assert (r.n, r.best, r.got, r.share) == (len(pairs), pytest.approx(best), pytest.approx(made), pytest.approx(made / best))
        assert r.right == pytest.approx(np.mean([abs(b - g) < 1e-9 for b, g in pairs]))


def test_curves(spark, sf):
    normal = NormalDist()
    want = {(round(r.l_discount * 100 - r.l_tax * 100, 6), round((r.l_discount * 100 + 0.5) / 11, 9), r.l_linenumber) for r in rows(spark, sf, "lineitem")}
    got = QUERIES["mt02_curves"](spark, sf).collect()
    assert {(round(r.x, 6), round(r.p, 9), r.n) for r in got} == want
    for r in got:
        assert r.logistic == pytest.approx(1 / (1 + math.exp(-r.x)), rel=1e-12)
        assert abs(r.cdf - normal.cdf(r.x)) < 2e-7 and abs(r.probit - normal.inv_cdf(r.p)) < 1e-8
        assert r.most == pytest.approx(normal.inv_cdf((r.n - 0.375) / (r.n + 0.25)), abs=1e-8)


def test_resolve_or_mint(spark, sf):
    got = QUERIES["jn17_resolve_or_mint"](spark, sf)
    from pyspark.sql import functions as F
    from panelwright.operators import relational

    known = spark.createDataFrame([(1, "a", "x", 1), (2, "b", None, 2), (3, "c", "x", 3), (4, "d", "y", 4)], "n long, id string, mail string, sk long")
    asked = spark.createDataFrame([(1, "a", "y"), (2, None, "y"), (3, None, "x"), (4, "new", None), (5, "new", "z"), (6, None, "z"), (7, None, None)], "n long, id string, mail string")
    found = {r.n: r.sk for r in relational.resolve_or_mint(asked, known, ["id", "mail"], "sk").collect()}
    minted = lambda text: -(hashed(text) >> 1)
    assert found == {1: 1, 2: 4, 3: minted("mail=x"), 4: minted("id=new"), 5: minted("id=new"), 6: minted("mail=z"), 7: None}
    assert got.count() == got.distinct().count() > 0 and got.where(F.col(got.columns[-1]).isNull()).count() == 0


def pinball_irls(x, t, q, rounds):
    x = np.column_stack([np.ones(len(t)), x])
    w = np.linalg.lstsq(x, t, rcond=None)[0]
    for _ in range(rounds):
        r = t - x @ w
        weight = np.where(r >= 0, q, 1 - q) / np.maximum(np.abs(r), 1e-6)
        w = np.linalg.lstsq((x * weight[:, None]).T @ x, (x * weight[:, None]).T @ t, rcond=None)[0]
    return w


def test_quantile_fit(spark, sf):
    groups = defaultdict(list)
    for r in rows(spark, sf, "lineitem"):
        groups[r.l_returnflag, r.l_linenumber].append((r.l_discount, r.l_quantity))
    got = {(r.l_returnflag, r.l_linenumber): r.b for r in QUERIES["ml15_quantile_fit"](spark, sf).collect()}
    assert set(got) == set(groups)
    for key, pairs in groups.items():
        x, t = np.array(pairs).T
        loss = lambda b: np.mean(np.maximum(0.9 * (t - b[0] - b[1] * x), -0.1 * (t - b[0] - b[1] * x)))  # noqa: B023, E731
        assert loss(got[key]) == pytest.approx(loss(pinball_irls(x, t, 0.9, 25)), rel=1e-4)
        exact = min(loss((np.quantile(t, 0.9) + d, s)) for d in np.linspace(-2, 2, 21) for s in np.linspace(-40, 40, 21))
        assert loss(got[key]) <= exact * 1.002
        assert abs(np.mean(t <= got[key][0] + got[key][1] * x) - 0.9) < 0.03


def test_logistic(spark, sf):
    line = rows(spark, sf, "lineitem")
    x = np.array([(1, r.l_quantity / 50, r.l_discount) for r in line], float)
    y = np.array([r.l_returnflag == "R" for r in line], float)
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        penalty = np.diag([0.0, 1.0, 1.0])
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
    got = {r.term: r.weight for r in QUERIES["ml17_logistic"](spark, sf).collect()}
    assert [got[k] for k in ("intercept", "q", "l_discount")] == pytest.approx(w.tolist(), abs=1e-6)


def test_boosted_trees_beat_the_mean(spark, sf):
    line = rows(spark, sf, "lineitem")
    got = QUERIES["ml16_boosted_mean"](spark, sf).collect()
    late = [r for r in line if r.l_shipdate.year >= 1997]
    assert sorted((r.l_orderkey, r.l_linenumber, r.l_extendedprice) for r in got) == sorted((r.l_orderkey, r.l_linenumber, r.l_extendedprice) for r in late)
    mean = np.mean([r.l_extendedprice for r in line if r.l_shipdate.year < 1997])  # the features tell next to nothing of the price here
    error = np.mean([(r.p - r.l_extendedprice) ** 2 for r in got])
    assert error < 1.1 * np.mean([(mean - r.l_extendedprice) ** 2 for r in got])
    chance = QUERIES["ml16_boosted_chance"](spark, sf).collect()
    assert len(chance) == len(late) and all(0 <= r.p <= 1 for r in chance) and Counter(r.large for r in chance)[1.0] == sum(r.l_extendedprice > 30000 for r in late)


def test_boosted_trees_learn_a_step(spark):
    x = np.random.default_rng(1).uniform(0, 1, 600)
    df = spark.createDataFrame([(float(a), float(a > 0.6) * 3 + 1, float(a > 0.6)) for a in x] + [(None, 1.0, 0.0)], "a double, y double, c double")
    assert max(abs(r.p - r.y) for r in models.boosted(df, df, ["a"], "y", "p", trees=30).collect() if abs(r.a - 0.6) > 0.05) < 0.2
    assert all((r.p > 0.5) == (r.c == 1) for r in models.boosted(df, df, ["a"], "c", "p", classes=True).collect() if abs(r.a - 0.6) > 0.05)


def test_ratings_solve_the_least_squares(spark, sf):
    nation = {r.c_custkey: r.c_nationkey for r in rows(spark, sf, "customer")}
    of_order = {r.o_orderkey: nation.get(r.o_custkey) for r in rows(spark, sf, "orders")}
    seller = {r.s_suppkey: r.s_nationkey for r in rows(spark, sf, "supplier")}
    games = [(seller.get(r.l_suppkey), of_order.get(r.l_orderkey), r.l_discount * 100 - 5) for r in rows(spark, sf, "lineitem")]
    games = [g for g in games if None not in g[:2] and g[0] != g[1]]
    teams = sorted({t for g in games for t in g[:2]})
    at = {t: i for i, t in enumerate(teams)}
    a, b = np.zeros((len(games), len(teams))), np.zeros(len(games))
    for k, (home, away, spread) in enumerate(games):
        a[k, at[home]], a[k, at[away]], b[k] = 1, -1, -spread - 1.0
    want = np.linalg.lstsq(a, b, rcond=None)[0]
    got = {r.team: r.rating for r in QUERIES["vl04_power_ratings"](spark, sf).collect()}
    assert set(got) == set(teams) and [got[t] for t in teams] == pytest.approx((want - want.mean()).tolist(), abs=1e-5)


def test_bootstrap_redraws_the_clusters(spark, sf):
    by = defaultdict(list)
    for r in rows(spark, sf, "orders"):
        by[r.o_orderdate.year].append(r.o_totalprice)
    means = [float(np.mean(by[y])) for y in sorted(by)]
    n = len(means)
    draw = lambda d, s: means[math.floor((hashed("bootstrap", four(11), eight(d), eight(s)) >> 11) / (1 << 53) * n)]
    resampled = [np.mean([draw(d, s) for s in range(n)]) for d in range(2000)]
    r = QUERIES["mx07_bootstrap"](spark, sf).first()
    assert (r["mean"], r.low, r.high) == pytest.approx((np.mean(means), np.quantile(resampled, 0.025), np.quantile(resampled, 0.975)))


def test_draws_depend_on_their_keys_alone(spark, sf):
    got = {r.o_orderkey: (r.u, r.z) for r in QUERIES["mc01_keyed_draws"](spark, sf).collect()}
    uniform = lambda *keys: (hashed(*keys) >> 11) / (1 << 53)
    for k, (u, z) in got.items():
        own = ("points", four(42), eight(k))
        assert u == uniform(*own)
        assert z == pytest.approx(math.sqrt(-2 * math.log1p(-uniform("far", *own))) * math.cos(2 * math.pi * uniform("turn", *own)), abs=1e-9)
    u, z = np.array(list(got.values())).T
    counts = np.histogram(u, 20, (0, 1))[0]
    assert ((counts - len(u) / 20) ** 2 / (len(u) / 20)).sum() < 45  # chi-square, 19 degrees
    assert abs(z.mean()) < 0.12 and abs(z.std() - 1) < 0.1 and abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.1


def test_normal_draws_have_no_infinity(spark):
    from pyspark.sql import functions as F

    got = spark.range(50_000).agg(F.max(F.abs(numbers.keyed_normal(F.lit("x"), F.col("id")))).alias("m"), F.avg(numbers.keyed_normal(F.lit("x"), F.col("id"))).alias("a")).first()
    assert 3.5 < got.m < 7 and abs(got.a) < 0.02


def test_brackets_of_every_size(spark):
    """Against a plain bracket, for fields of 2 to 9 and both ways of seeding."""
    for places, reseed in itertools.product(range(2, 10), (True, False)):
        teams = spark.createDataFrame([(1, t, (t * 7) % 11) for t in range(1, 11)], "league int, team long, seed int")
        scores = spark.createDataFrame([(1, t, r, float((t * (3 * r + 2)) % 13)) for t in range(1, 11) for r in range(1, 5)], "league int, team long, round int, points double")
        got = {(r["round"], r.team): (r.opponent, r.won) for r in decisions.bracket(teams, scores, ["league"], places, reseed).collect()}
        alive, size, round_, want = sorted(((t * 7) % 11, t) for t in range(1, 11) if (t * 7) % 11 <= places), 1, 0, {}
        while size < places:
            size *= 2
        slots = [next(iter([x for x in alive if x[0] == s]), None) for s in range(1, size + 1)]
        while size > 1:
            round_ += 1
            if reseed and round_ > 1:
                slots = sorted(x for x in slots if x)
            winners = []
            for i in range(size // 2):
                a, b = slots[i], slots[size - 1 - i]
                if a and b:
                    points = lambda x: (x[1] * (3 * round_ + 2)) % 13  # noqa: B023, E731
                    first = min((a, b), key=lambda x: (-points(x), x[0]))  # noqa: B023
                    for x, y in ((a, b), (b, a)):
                        want[round_, x[1]] = (y[1], x == first)
                    winners.append(first)
                else:
                    winners.append(a or b)
            slots, size = winners, size // 2
        assert got == want, (places, reseed)


def test_expected_best_equals_all_outcomes(spark):
    values = [(9.0, 0.5), (7.0, 0.9), (4.0, 0.3), (4.0, 0.6), (-1.0, 0.5)]
    df = spark.createDataFrame([(1, i, v, a) for i, (v, a) in enumerate(values)], "k int, i int, v double, a double")
    for slots in (1, 2, 3):
        want = 0.0
        for there in itertools.product((0, 1), repeat=len(values)):
            chance = math.prod(a if t else 1 - a for t, (_, a) in zip(there, values))
            want += chance * sum([v for t, (v, _) in zip(there, values) if t][:slots])
        assert decisions.expected_best(df, ["k"], "v", "a", "i", slots).first().expected == pytest.approx(want)


def expected_by_outcomes(rows, slots):
    """The mean best lineup over every outcome of who is there."""
    total = 0.0
    for there in itertools.product((False, True), repeat=len(rows)):
        chance = math.prod(c if t else 1 - c for (_, c, _), t in zip(rows, there))
        own = [(v, p) for (v, _, p), t in zip(rows, there) if t]
        seats = decisions.assign([v for v, _ in own], [[p] for _, p in own], slots)
        total += chance * sum(max(v, 0.0) for (v, _), s in zip(own, seats) if s is not None)
    return total


def test_lineup_marginals_equal_all_outcomes():
    draw = np.random.default_rng(4)
    for slots in (["QB", "RB", "FLEX"], ["RB", "RB", "WR"], ["QB", "WR", "FLEX", "SUPERFLEX"], ["K"], []):
        rows = [(float(v), float(c), p) for v, c, p in zip(draw.normal(5, 4, 9).round(1), draw.choice([0, 0.3, 0.7, 1], 9), draw.choice(["QB", "RB", "WR", "TE", "K"], 9))]
        total, lost = decisions.marginal_values(*zip(*rows), slots)
        assert total == pytest.approx(expected_by_outcomes(rows, slots))
        assert lost == pytest.approx([total - expected_by_outcomes(rows[:i] + rows[i + 1 :], slots) for i in range(9)])
    assert decisions.marginal_values([], [], [], ["QB"]) == (0.0, [])


def test_lineup_marginals_of_the_tables(spark, sf):
    orders = defaultdict(list)
    for r in rows(spark, sf, "orders"):
        orders[r.o_custkey].append(r.o_orderstatus == "F")
    teams = defaultdict(list)
    for r in rows(spark, sf, "customer"):
        own = {"BUILDING": "RB", "AUTOMOBILE": "RB", "MACHINERY": "QB"}.get(r.c_mktsegment, "WR")
        teams[r.c_custkey // 20].append((r.c_custkey, r.c_acctbal, np.mean(orders[r.c_custkey]) if orders[r.c_custkey] else 0.0, own))
    slots = ["QB", "RB", "RB", "WR", "FLEX", "SUPERFLEX"]
    got = {r.c_custkey: (r.expected, r.marginal) for r in QUERIES["vl08_marginals"](spark, sf).collect()}
    assert len(got) == sum(map(len, teams.values()))
    for own in teams.values():
        own.sort()
        total = decisions.marginal_values([r[1] for r in own], [r[2] for r in own], [r[3] for r in own], slots)[0]
        for i, r in enumerate(own):  # the whole fold again, without the row
            left = own[:i] + own[i + 1 :]
            rest = decisions.marginal_values([r[1] for r in left], [r[2] for r in left], [r[3] for r in left], slots)[0]
            assert got[r[0]] == pytest.approx((total, total - rest), abs=1e-6)
