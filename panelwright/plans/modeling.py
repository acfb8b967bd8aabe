"""Queries of ranks, curves, models, metrics and valuation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import decisions, models, ranking
from ..sources.readers import table
from .registry import registry

QUERIES, ORACLES, query = registry()


def cents(c):
    return F.round(F.col(c) * 100).cast("bigint")


@query("wn01_rank", "select p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank from part")
def wn01(spark, d):
    return ranking.ordinal(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")]).select("p_partkey", "rank")


@query("wn11_average_tie", "with r as (select p_partkey, rank() over (partition by p_brand order by p_size) - 1 as r, count(*) over (partition by p_brand, p_size) as t, count(*) over (partition by p_brand) as n from part) select p_partkey, case when n >= 2 then (r + (t - 1) / 2) / (n - 1) end as pct from r")
def wn11(spark, d):
    return ranking.average_tie_percentile(table(spark, d, "part"), ["p_brand"], "p_size", "pct").select("p_partkey", "pct")


@query("wn12_percent_rank", "select p_partkey, 1 - percent_rank() over (partition by p_brand order by p_size) as pct from part")
def wn12(spark, d):
    return ranking.lower_percent_rank(table(spark, d, "part"), ["p_brand"], "p_size", "pct", lower_is_better=True).select("p_partkey", "pct")


RANKED = """r as (select o_orderpriority as p, year(o_orderdate) as y, round(o_totalprice * 100)::bigint as v, row_number() over (partition by o_orderpriority, year(o_orderdate) order by o_totalprice desc, o_orderkey) as k from orders),
  g as (select p, k, sum(v) as s, count(*) as n from r where k <= 40 group by 1, 2)"""


def ranked_orders(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y"), cents("o_totalprice").alias("v"), "o_totalprice", "o_orderkey")
    return ranking.ordinal(o, ["p", "y"], [F.desc("o_totalprice"), F.col("o_orderkey")], "k").where("k <= 40")


SMOOTHED = f"""with {RANKED}, c as (select p, k,
  case when k <= 3 then sum(s) over (partition by p order by k range between 1 preceding and 1 following) else sum(s) over (partition by p order by k range between 2 preceding and 2 following) end as s,
  case when k <= 3 then sum(n) over (partition by p order by k range between 1 preceding and 1 following) else sum(n) over (partition by p order by k range between 2 preceding and 2 following) end as n from g),
  f as (select *, max((n < 12)::int) over (partition by p order by k) as thin from c)"""


@query("wn17_smoothed", SMOOTHED + " select p, k, s / n as curve, n::bigint as n from f where thin = 0")
def wn17(spark, d):
    return ranking.smoothed_curve(ranked_orders(spark, d), ["p"], "k", "v", least=12)


@query("wn18_isotonic", SMOOTHED + " select p, k, min(s / n) over (partition by p order by k) as curve from f where thin = 0")
def wn18(spark, d):
    c = ranking.smoothed_curve(ranked_orders(spark, d), ["p"], "k", "v", least=12)
    return ranking.non_increasing(c, ["p"], "k", "curve", "low").select("p", "k", F.col("low").alias("curve"))


@query("wn19_order_statistic", f"with {RANKED} select p, k, sum(v) / count(*) as curve, count(*)::bigint as n from r where k <= 10 group by 1, 2")
def wn19(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y"), cents("o_totalprice").alias("v"), "o_orderkey")
    return ranking.order_statistic_curve(o, ["p"], "y", "v", "o_orderkey", 10)


@query("wn25_bands", "select p_partkey, case when p_size <= 12 then '1-12' when p_size <= 24 then '13-24' when p_size <= 36 then '25-36' else '37+' end as band from part")
def wn25(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.when(size <= 12, "1-12").when(size <= 24, "13-24").when(size <= 36, "25-36").otherwise("37+").alias("band"))


@query(
    "curve_level_rescale",
    f"""with {RANKED}, shape as (select p, k, sum(s) / sum(n) as v from g group by 1, 2), cons as (select p, k, v * 1.25 as c from shape where k <= 30),
      f as (select p, avg(c) / avg(v) as f, count(*) as n from shape join cons using (p, k) where k <= 24 group by 1)
      select p, k, round(v * case when n >= 12 and f between 0.5 and 2 then f else 1 end, 2) as level from shape left join f using (p)""",
)
def level(spark, d):
    shape = ranked_orders(spark, d).groupBy("p", "k").agg((F.sum("v") / F.count("*")).alias("v"))
    other = shape.where("k <= 30").withColumn("v", F.col("v") * 1.25)
    return ranking.level_rescale(shape, other, ["p"], "k", "v", "level").select("p", "k", F.round("level", 2).alias("level"))


@query(
    "jn24_nearest_peers",
    """with j as (select a.p_partkey, b.p_retailprice as v, row_number() over (partition by a.p_partkey order by abs(a.p_retailprice - b.p_retailprice), b.p_partkey) as k
        from part a join part b on a.p_brand = b.p_brand and a.p_partkey <> b.p_partkey)
      select p_partkey, median(v) as mid from j where k <= 5 group by 1""",
)
def jn24(spark, d):
    return ranking.nearest_peers_median(table(spark, d, "part"), ["p_brand"], "p_retailprice", "p_retailprice", "p_partkey", 5, "mid").select("p_partkey", "mid")


@query("tk01_order_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def tk01(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("tk02_order_json", "select event_id from events order by (json_extract(props, '$.k'))::int desc, event_id limit 20")
def tk02(spark, d):
    return table(spark, d, "events").orderBy(F.desc(F.get_json_object("props", "$.k").cast("int")), "event_id").limit(20).select("event_id")


@query("tk03_order_boolean", "select c_custkey from customer order by (c_mktsegment = 'BUILDING') desc, c_acctbal desc, c_custkey limit 20")
def tk03(spark, d):
    return table(spark, d, "customer").orderBy((F.col("c_mktsegment") == "BUILDING").desc(), F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey")


@query("tk04_top_per_group", "select l_suppkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as k from lineitem) where k <= 3")
def tk04(spark, d):
    top = ranking.top_per_group(table(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3)
    return top.select("l_suppkey", "l_orderkey", "l_linenumber")


LINEUP = ["A", "B", "FLEX"]


def roster(spark, d):
    """Customers as a nation's roster: a segment is a position, and every third may also play the next one."""
    c = table(spark, d, "customer")
    own = F.when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), "RB").when(F.col("c_mktsegment") == "MACHINERY", "QB").otherwise("WR")
    extra = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("QB"))).otherwise(F.array().cast("array<string>"))
    return c.select("c_nationkey", "c_custkey", "c_acctbal", F.abs(F.col("c_acctbal") - F.col("c_custkey")).alias("guess"), F.concat(F.array(own), extra).alias("eligible"))


@query("tk05_assignment")
def tk05(spark, d):
    return decisions.best_lineups(roster(spark, d), ["c_nationkey"], "c_custkey", "c_acctbal", "eligible", ["QB", "RB", "RB", "WR", "FLEX"])


@query("mx10_regret")
def mx10(spark, d):
    return decisions.regret(roster(spark, d), ["c_nationkey"], "c_custkey", "guess", "c_acctbal", "eligible", ["QB", "RB", "RB", "WR", "FLEX"])


@query(
    "tk06_slots",
    """with s as (select slot, unnest(p) as position from (values ('FLEX', ['RB', 'WR', 'TE']), ('QB', ['QB']), ('WRTE', ['WR', 'TE'])) t(slot, p)),
      c as (select c_nationkey, case when c_mktsegment in ('BUILDING', 'AUTOMOBILE') then 'RB' when c_mktsegment = 'MACHINERY' then 'QB' else 'WR' end as position from customer)
      select c_nationkey, slot, count(*)::bigint as n from c join s using (position) group by 1, 2""",
)
def tk06(spark, d):
    """How many customers of each nation may fill each slot, by the position of their segment."""
    slots = spark.createDataFrame([(s, p) for s in ("FLEX", "QB", "WRTE") for p in decisions.admitted(s)], "slot string, position string")
    position = F.when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), "RB").when(F.col("c_mktsegment") == "MACHINERY", "QB").otherwise("WR")
    c = table(spark, d, "customer").select("c_nationkey", position.alias("position"))
    return c.join(F.broadcast(slots), "position").groupBy("c_nationkey", "slot").agg(F.count("*").alias("n"))  # of a handful of slots


@query("tk07_multi_key", "select p_partkey from part order by p_retailprice desc, p_size desc, p_partkey limit 30")
def tk07(spark, d):
    return table(spark, d, "part").orderBy(F.desc("p_retailprice"), F.desc("p_size"), "p_partkey").limit(30).select("p_partkey")


@query(
    "tk08_serpentine",
    """with r as (select c_custkey, c_nationkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) - 1 as i from customer)
      select c_nationkey, c_custkey, (i + 1)::int as pick, (i // 10 + 1)::int as round, (case when (i // 10) % 2 = 0 then i % 10 + 1 else 10 - i % 10 end)::int as team from r where i < 40""",
)
def tk08(spark, d):
    """The forty best customers of each nation, dealt to ten teams there and back."""
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    ranked = table(spark, d, "customer").select("c_nationkey", "c_custkey", place.alias("pick")).where("pick <= 40")
    order = spark.range(1).select(F.explode(ranking.serpentine(10, 4)).alias("p")).select("p.*")
    return ranked.join(F.broadcast(order), "pick").select("c_nationkey", "c_custkey", "pick", "round", "team")  # forty rows


@query(
    "tk09_seeding",
    """with w as (select *, row_number() over (partition by c_nationkey, c_mktsegment order by c_acctbal desc, c_custkey) = 1 as best from customer),
      s as (select *, row_number() over (partition by c_nationkey order by (not best), c_acctbal desc, c_custkey) as s from w)
      select c_custkey, case when s <= 6 then s end as seed from s""",
)
def tk09(spark, d):
    return ranking.playoff_seeds(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", [F.desc("c_acctbal"), F.col("c_custkey")], 6).select("c_custkey", "seed")


@query(
    "tk10_bracket",
    """with s as (select c_nationkey as league, c_custkey as team, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as seed from customer),
      p as (select c_nationkey as league, c_custkey as team, r as round, ((c_custkey * (2 * r + 5)) % 101)::double as points from customer, unnest([1, 2, 3]) t(r)),
      a1 as (select s.league, s.team, seed, case when seed <= 2 then null else least(seed, 9 - seed) end as pair, points from s join p on p.league = s.league and p.team = s.team and round = 1 where seed <= 6),
      g1 as (select *, count(*) over (partition by league, pair) as n, row_number() over (partition by league, pair order by points desc, seed) = 1 as won, sum(team) over (partition by league, pair) - team as opponent from a1 where pair is not null),
      b1 as (select league, team, seed from a1 where pair is null union all select league, team, seed from g1 where won),
      a2 as (select b1.league, b1.team, seed, row_number() over (partition by b1.league order by seed) as k, points from b1 join p on p.league = b1.league and p.team = b1.team and round = 2),
      g2 as (select *, least(k, 5 - k) as pair, row_number() over (partition by league, least(k, 5 - k) order by points desc, seed) = 1 as won, sum(team) over (partition by league, least(k, 5 - k)) - team as opponent, count(*) over (partition by league, least(k, 5 - k)) as n from a2),
      a3 as (select g2.league, g2.team, seed, p.points from g2 join p on p.league = g2.league and p.team = g2.team and round = 3 where won),
      g3 as (select *, row_number() over (partition by league order by points desc, seed) = 1 as won, sum(team) over (partition by league) - team as opponent, count(*) over (partition by league) as n from a3)
      select league, team, seed::int as seed, 1 as round, opponent::bigint as opponent, points, won from g1 where n = 2 union all
      select league, team, seed::int, 2, opponent::bigint, points, won from g2 where n = 2 union all select league, team, seed::int, 3, opponent::bigint, points, won from g3 where n = 2""",
)
def tk10(spark, d):
    """The six best customers of each nation: two byes, and the field seeded anew after each round."""
    c = table(spark, d, "customer")
    seed = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    teams = c.select(F.col("c_nationkey").alias("league"), F.col("c_custkey").alias("team"), seed.alias("seed"))
    rounds = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    scores = c.select(F.col("c_nationkey").alias("league"), F.col("c_custkey").alias("team"), rounds.alias("round"))
    scores = scores.withColumn("points", ((F.col("team") * (2 * F.col("round") + 5)) % 101).cast("double"))
    return decisions.bracket(teams, scores, ["league"], 6)


@query(
    "tk11_round_robin",
    """with w as (select unnest(range(1, 10))::int as week), k as (select unnest(range(0, 5))::int as k),
      g as (select week, k, case when k = 0 then 1 else (k - 1 + week - 1) % 9 + 2 end as a, (9 - k - 1 + week - 1) % 9 + 2 as b from w, k),
      s as (select week, case when (week + k) % 2 = 1 then a else b end as home, case when (week + k) % 2 = 1 then b else a end as away from g),
      t as (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as i from customer)
      select h.c_nationkey, week, h.c_custkey as home, a.c_custkey as away from s join t h on h.i = s.home join t a on a.i = s.away and a.c_nationkey = h.c_nationkey""",
)
def tk11(spark, d):
    """The ten best customers of each nation play each other once."""
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    teams = table(spark, d, "customer").select("c_nationkey", "c_custkey", place.alias("i")).where("i <= 10")
    games = spark.createDataFrame(decisions.round_robin(10, 9), "week int, home_i int, away_i int")
    side = lambda name: teams.select("c_nationkey", F.col("c_custkey").alias(name), F.col("i").alias(f"{name}_i"))
    return side("home").join(F.broadcast(games), "home_i").join(side("away"), ["c_nationkey", "away_i"]).select("c_nationkey", "week", "home", "away")  # 45 games


@query(
    "tk12_tiers",
    """with recursive r as (select p_brand, p_partkey, p_retailprice as v, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as k from part),
      t as (select p_brand, p_partkey, v, k, 1 as tier, 1 as held from r where k = 1 union all
        select r.p_brand, r.p_partkey, r.v, r.k, case when t.v - r.v > greatest(3.0, 0.15 * t.v) or t.held >= 5 then t.tier + 1 else t.tier end,
          case when t.v - r.v > greatest(3.0, 0.15 * t.v) or t.held >= 5 then 1 else t.held + 1 end from t join r on r.p_brand = t.p_brand and r.k = t.k + 1)
      select p_partkey, tier::bigint as tier from t""",
)
def tk12(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice")
    return ranking.tiers(p, ["p_brand"], "p_retailprice", "p_partkey").select("p_partkey", "tier")


# Numbers


@query("mt01_half_up", "select c_custkey, floor(c_acctbal * 10 + 0.5) / 10 as x from customer")
def mt01(spark, d):
    return table(spark, d, "customer").select("c_custkey", numbers.half_up(F.col("c_acctbal"), 1).alias("x"))


@query("mt02_curves")
def mt02(spark, d):
    """Curves at each rate of the lines: its logit as a chance, and the most to be expected of so many lines."""
    line = table(spark, d, "lineitem").select((F.col("l_discount") * 100 - F.col("l_tax") * 100).alias("x"), ((F.col("l_discount") * 100 + 0.5) / 11).alias("p"), F.col("l_linenumber").cast("long").alias("n")).distinct()
    return line.select("x", "p", "n", numbers.logistic(F.col("x")).alias("logistic"), numbers.normal_cdf(F.col("x")).alias("cdf"), numbers.probit(F.col("p")).alias("probit"), numbers.expected_max_normals(F.col("n")).alias("most"))


@query(
    "mt03_log_linear",
    """with r as (select p_brand, p_retailprice as y, ln(row_number() over (partition by p_brand order by p_retailprice desc, p_partkey)) as x from part)
      select p_brand, case when count(*) >= 8 then round(regr_slope(y, x), 4) end as slope, case when count(*) >= 8 then round(regr_intercept(y, x), 4) end as intercept from r group by 1""",
)
def mt03(spark, d):
    r = ranking.ordinal(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], "k").withColumn("x", F.log("k"))
    g = r.groupBy("p_brand").agg(F.count("*").alias("n"), F.regr_slope("p_retailprice", "x").alias("s"), F.regr_intercept("p_retailprice", "x").alias("i"))
    return g.select("p_brand", F.when(F.col("n") >= 8, F.round("s", 4)).alias("slope"), F.when(F.col("n") >= 8, F.round("i", 4)).alias("intercept"))


@query(
    "mt04_shrink",
    """with b as (select *, (row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) - 1) // 12 as b from part), m as (select p_brand, b, avg(p_size) as m from b group by 1, 2)
      select p_partkey, round(1 + p_size / (p_size + 20.0) * (p_size / m - 1), 8) as x from b join m using (p_brand, b)""",
)
def mt04(spark, d):
    r = ranking.ordinal(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], "k")
    r = r.withColumn("m", F.avg("p_size").over(Window.partitionBy("p_brand", F.floor((F.col("k") - 1) / 12))))
    return r.select("p_partkey", F.round(numbers.shrunk_ratio(F.col("p_size"), F.col("m"), F.col("p_size"), 20.0), 8).alias("x"))


@query("mt05_interpolate", "select event_id, round(case when value <= 10 then 1.0 when value >= 100 then 7.0 when value < 40 then 1 + (value - 10) / 30 * 2 else 3 + (value - 40) / 60 * 4 end, 8) as y from events")
def mt05(spark, d):
    knots, values = F.array(*map(F.lit, (10.0, 40.0, 100.0))), F.array(*map(F.lit, (1.0, 3.0, 7.0)))
    return table(spark, d, "events").select("event_id", F.round(numbers.interpolate(F.col("value"), knots, values), 8).alias("y"))


@query("mt06_trapezoid", "select p_partkey, round((0.5 * (p_size + p_size * 2.0) / 2 + 0.5 * (p_size * 2.0 + p_size * 5.0) / 2) / 1.0, 8) as m from part")
def mt06(spark, d):
    s = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(numbers.trapezoid_mean(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)), F.array(s, s * 2, s * 5)), 8).alias("m"))


@query("mt07_implied_total", "select l_orderkey, l_linenumber, l_quantity / 2 - case when l_linenumber = 1 then l_tax / 2 else -l_tax / 2 end as implied from lineitem")
def mt07(spark, d):
    home = (F.col("l_linenumber") == 1).cast("int")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.implied_total(F.col("l_quantity"), F.col("l_tax"), home).alias("implied"))


MUL = "(({a}) * {c}::ubigint::hugeint % 4294967296)"


def _mix_sql(x: str) -> str:
    """The 32-bit finaliser as SQL over hugeint, for the oracle."""
    one = f"((xor(({x})::ubigint, ({x})::ubigint >> 16))::hugeint * 2246822507 % 4294967296)"
    two = f"((xor(({one})::ubigint, ({one})::ubigint >> 13))::hugeint * 3266489909 % 4294967296)"
    return f"(xor(({two})::ubigint, ({two})::ubigint >> 16))"


@query("mt08_mix32", f"select o_orderkey, {_mix_sql('o_orderkey')}::bigint as h from orders")
def mt08(spark, d):
    return table(spark, d, "orders").select("o_orderkey", numbers.mix32(F.col("o_orderkey")).alias("h"))


@query("mt09_bonus_ladder", "select event_id, (value >= 50)::int * 1.0 + (value >= 100)::int * 2.0 as bonus, case when value <= 5 then 10.0 when value <= 20 then 7.0 when value <= 60 then 4.0 else -1.0 end as steps from events")
def mt09(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", numbers.tier_bonus(v, [(50, 1), (100, 2)]).alias("bonus"), numbers.ladder(v, [(5, 10), (20, 7), (60, 4)], -1).alias("steps"))


@query("scoring_rules", "select l_orderkey, round(sum(l_quantity * 0.04 + l_discount * 6 - l_tax * 2 + l_linenumber * 0.5), 4) as points from lineitem group by 1")
def scoring(spark, d):
    rules = {"l_quantity": 0.04, "l_discount": 6, "l_tax": -2, "l_linenumber": 0.5, "l_returnflag": 1}
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(numbers.scored(rules)), 4).alias("points"))


@query("ar01_arrays", "select user_id, (list(event_id order by event_id))[1:3] as head, list_sum(list_transform(list(event_id order by event_id), lambda x: x % 7))::bigint as folded from events group by 1")
def ar01(spark, d):
    ids = F.array_sort(F.collect_list("event_id"))
    g = table(spark, d, "events").groupBy("user_id").agg(ids.alias("ids"))
    return g.select("user_id", F.slice("ids", 1, 3).alias("head"), F.aggregate(F.transform("ids", lambda x: x % 7), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("folded"))


@query("ar02_index", "select p_partkey, [10, 8, 5][least(p_size, 3)] as clamped, [10, 8, 5][(p_size - 1) % 3 + 1] as cyclic from part")
def ar02(spark, d):
    v = F.array(*map(F.lit, (10, 8, 5)))
    return table(spark, d, "part").select("p_partkey", numbers.clamped_at(v, F.col("p_size")).alias("clamped"), numbers.cyclic_at(v, F.col("p_size")).alias("cyclic"))


# Models


@query(
    "ml01_linear_head",
    """select l_orderkey, l_linenumber, round(l_extendedprice * case l_returnflag when 'R' then least(1.5, greatest(0.5, 1 + 0.5 * (least(0.08, l_discount) - 0.05) - 0.1 * (l_linestatus = 'O')::int))
       when 'N' then least(1.5, greatest(0.5, 0.9 + 2 * (least(0.08, l_discount) - 0.05) + 0.05 * (l_linestatus = 'O')::int)) else 1 end, 6) as p from lineitem""",
)
def ml01(spark, d):
    line = table(spark, d, "lineitem").withColumn("open", (F.col("l_linestatus") == "O").cast("int")).withColumn("disc", F.col("l_discount") - 0.05)
    specs = [{"column": "disc", "clip": (-1.0, 0.03)}, {"column": "open", "kind": "indicator"}]
    p = models.linear_head(specs, {"R": [1, 0.5, -0.1], "N": [0.9, 2, 0.05]}, F.col("l_returnflag"), F.col("l_extendedprice"), bounds=(0.5, 1.5))
    return line.select("l_orderkey", "l_linenumber", F.round(p, 6).alias("p"))


HEADS = {
    "mean": {"R": [1.0, 0.5], "N": [0.9, 2.0]}, "p10": {"R": [0.4, 0.1], "N": [0.3, 0.5]},
    "p50": {"R": [0.95, 0.4], "N": [0.85, 1.5]}, "p90": {"R": [1.7, 1.0], "N": [1.5, 4.0]},
}


def _heads_sql(form: str) -> str:
    lin = {name: {g: f"({b[0]} + {b[1]} * l_discount)" for g, b in by.items()} for name, by in HEADS.items()}
    value = (lambda e: f"l_quantity * least(2.0, greatest(0.5, {e}))") if form == "ratio" else (lambda e: f"least(l_quantity * 2.0, greatest(l_quantity * 0.5, l_quantity + {e}))")
    return ", ".join(f"round(case l_returnflag when 'R' then {value(e['R'])} when 'N' then {value(e['N'])} else l_quantity end, 8) as {form}_{name}" for name, e in lin.items())


@query("ml02_four_heads", f"select l_orderkey, l_linenumber, {_heads_sql('ratio')}, {_heads_sql('offset')} from lineitem")
def ml02(spark, d):
    """A projection's mean and three quantiles, as a ratio to the base and as an offset from it; a flag without
    coefficients keeps the base."""
    specs, group, base = [{"column": "l_discount"}], F.col("l_returnflag"), F.col("l_quantity")
    got = [(form, name, head) for form in ("ratio", "offset") for name, head in zip(HEADS, models.heads(specs, HEADS, group, base, form=form, bounds=(0.5, 2.0)))]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(head, 8).alias(f"{form}_{name}") for form, name, head in got))


TREES = {
    "features": ["l_quantity", "l_discount"], "base": 1.0,
    "trees": [
        {"feature": [0, 1, -1, -1, -1], "threshold": [25.0, 0.04, 0.0, 0.0, 0.0], "left": [1, 2, 0, 0, 0], "right": [4, 3, 0, 0, 0], "missing_left": [1, 0, 0, 0, 0], "value": [0.0, 0.0, 0.5, 1.5, -1.0]},
        {"feature": [1, -1, -1], "threshold": [0.07, 0.0, 0.0], "left": [1, 0, 0], "right": [2, 0, 0], "missing_left": [0, 0, 0], "value": [0.0, 0.25, 2.0]},
    ],
    "golden": [{"x": [10.0, 0.01], "y": 1.75}, {"x": [30.0, 0.1], "y": 2.0}],
}


@query("ml03_trees", "select l_orderkey, l_linenumber, 1 + case when l_quantity <= 25 then case when l_discount <= 0.04 then 0.5 else 1.5 end else -1 end + case when l_discount <= 0.07 then 0.25 else 2 end as score from lineitem")
def ml03(spark, d):
    artifact = models.check_artifact(TREES, ["l_quantity", "l_discount"])
    return models.score_trees(table(spark, d, "lineitem"), artifact, artifact["features"], "score").select("l_orderkey", "l_linenumber", "score")


@query("ml05_artifacts", "select * from (values ('as it is', true), ('features', false), ('order', false), ('holdout', false), ('golden', false), ('no golden', false), ('broken tree', false)) t(artifact, accepted)")
def ml05(spark, d):
    """What the loader does with an artifact and with ones that are wrong in one way each."""
    tree = TREES["trees"][0]
    cases = {
        "as it is": {}, "features": {"features": ["l_quantity", "l_tax"]}, "order": {"features": TREES["features"][::-1]}, "holdout": {"seasons": [1996, 1998]},
        "golden": {"golden": [{"x": [10.0, 0.01], "y": 1.7500021}]}, "no golden": {"golden": []}, "broken tree": {"trees": [{**tree, "left": tree["left"][:-1]}]},
    }

    def accepted(change: dict) -> bool:
        try:
            return bool(models.check_artifact({**TREES, **change}, ["l_quantity", "l_discount"], holdout=[1998]))
        except ValueError:
            return False

    return spark.createDataFrame([(name, accepted(change)) for name, change in cases.items()], "artifact string, accepted boolean")


@query(
    "ml06_matchup_serving",
    """with s as (select l_orderkey, l_linenumber, year(l_shipdate) as y, l_linestatus, l_quantity, case when l_returnflag <> 'A' and not (year(l_shipdate) = 1995) then l_returnflag end as opp,
        1 + case when l_quantity <= 25 then case when l_discount <= 0.04 then 0.5 else 1.5 end else -1 end + case when l_discount <= 0.07 then 0.25 else 2 end as score from lineitem),
      k as (select *, bool_or(opp is not null) over (partition by y) as known, rank() over (partition by y, l_linestatus order by l_quantity desc) as rank from s)
      select l_orderkey, l_linenumber, known and opp is null as no_game, case when known and opp is null then 0.0 else score end as mean, case when known and opp is null then 1.0 else 0.25 end as p_zero, rank::int as rank from k""",
)
def ml06(spark, d):
    """Trees served by year: a row without an opponent is a certain zero, but for a year that has none at all."""
    artifact = models.check_artifact(TREES, ["l_quantity", "l_discount"])
    line = table(spark, d, "lineitem").withColumn("y", F.year("l_shipdate"))
    line = line.withColumn("opp", F.when((F.col("l_returnflag") != "A") & (F.col("y") != 1995), F.col("l_returnflag"))).withColumn("p_zero", F.lit(0.25))
    scored = models.score_trees(line, artifact, artifact["features"], "mean")
    out = models.served(scored, ["y"], "l_linestatus", "l_quantity", "opp", ["mean"], "p_zero")
    return out.select("l_orderkey", "l_linenumber", "no_game", "mean", "p_zero", "rank")


@query(
    "ml04_mixture_quantile",
    """with q as (select event_id, (event_id % 5) / 10.0 as z, value as a, value * 2 as b from events), t as (select *, (0.5 - z) / (1 - z) as t from q)
      select event_id, round(case when t <= 0 then 0 when t <= 0.25 then a * t / 0.25 when t <= 0.75 then a + (greatest(a, b) - a) * (t - 0.25) / 0.5 else greatest(a, b) end, 8) as p50 from t""",
)
def ml04(spark, d):
    z = (F.col("event_id") % 5) / 10
    p = models.mixture_quantile(0.5, z, [0.25, 0.75], F.array(F.col("value"), F.col("value") * 2))
    return table(spark, d, "events").select("event_id", F.round(p, 8).alias("p50"))


@query("ml07_hurdle_price", "select p_partkey, round(least(1000.0, greatest(1.0, (p_size / 50.0 * exp(p_size / 10.0) / 1000 * 1.1 + (1 - p_size / 50.0) / 1000) * 1000)), 6) as price from part")
def ml07(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.round(models.hurdle_price(s / 50, s / 10, 1.1, 1000.0), 6).alias("price"))


@query("ml08_bids", "select p_partkey, round(1 / (1 + exp(-(0.2 * p_size / 10 + 1.5 * (ln(1 + p_size) - 2) / 0.8))), 8) as chance, greatest(0, ceil(exp((ln(0.6 / 0.4) - 0.2 * p_size / 10) / 1.5 * 0.8 + 2) - 1))::bigint as bid from part")
def ml08(spark, d):
    base = F.lit(0.2) * F.col("p_size") / 10
    return table(spark, d, "part").select("p_partkey", F.round(models.win_chance(F.col("p_size"), base, 1.5, 2.0, 0.8), 8).alias("chance"), models.bid_for(0.6, base, 1.5, 2.0, 0.8).alias("bid"))


@query("ml09_horizon", "select p_partkey, round(1/(1+exp(-(p_size/25.0-1))) + 1/(1+exp(-(p_size/25.0-1.5))) + 1/(1+exp(-(p_size/25.0-2))) + 1/(1+exp(-(p_size/25.0-2.5))), 8) as games_out from part")
def ml09(spark, d):
    heads = [numbers.logistic(F.col("p_size") / 25 - c) for c in (1, 1.5, 2, 2.5)]
    return table(spark, d, "part").select("p_partkey", F.round(heads[0] + heads[1] + heads[2] + heads[3], 8).alias("games_out"))


@query(
    "ml10_mlp",
    """with h as (select l_orderkey, l_linenumber, (l_quantity - 25) / 14 as a, (l_discount - 0.05) / 0.03 as b from lineitem)
      select l_orderkey, l_linenumber, round(0.5 + 2 * greatest(0.0, 0.5 * a + b + 0.1) - greatest(0.0, 0.25 * b - a), 8) as score from h""",
)
def ml10(spark, d):
    layers = [{"w": [[0.5, -1.0], [1.0, 0.25]], "b": [0.1, 0.0]}, {"w": [[2.0], [-1.0]], "b": [0.5]}]
    artifact = {"layers": layers, "mean": [25.0, 0.05], "scale": [14.0, 0.03]}
    return models.score_mlp(table(spark, d, "lineitem"), artifact, ["l_quantity", "l_discount"], "score").select("l_orderkey", "l_linenumber", F.round("score", 8).alias("score"))


@query(
    "ml11_blend",
    """with g as (select c_custkey, case when c_custkey % 7 <> 0 then c_acctbal end as line, count(o_orderkey)::bigint as n, sum(round(o_totalprice)::bigint)::bigint as p from customer left join orders on o_custkey = c_custkey group by all)
      select c_custkey, round(case when line is null then p / nullif(n, 0) when n = 0 then line else (6 * line + p) / (6 + n) end, 6) as blended from g""",
)
def ml11(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    g = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum(F.round("o_totalprice").cast("bigint")).alias("p"))
    x = c.join(g, "c_custkey", "left").withColumn("line", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))
    return x.select("c_custkey", F.round(models.season_blend(F.col("line"), F.coalesce("n", F.lit(0)), F.col("p"), 6.0), 6).alias("blended"))


@query(
    "ml12_consensus_blend",
    """with m as (select p_brand, p_partkey, p_retailprice, 0.6 * percent_rank() over (partition by p_brand order by p_retailprice desc) + 0.4 * percent_rank() over (partition by p_brand order by p_size desc) as x from part),
      k as (select *, row_number() over (partition by p_brand order by x, p_retailprice desc, p_partkey) as k, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as o from m)
      select a.p_partkey, b.p_retailprice as dealt from k a join k b on a.p_brand = b.p_brand and b.o = a.k""",
)
def ml12(spark, d):
    p = table(spark, d, "part")
    return models.consensus_blend(p, ["p_brand"], "p_retailprice", "p_size", 0.4, "p_partkey", "dealt").select("p_partkey", "dealt")


@query("ml14_ols", "select l_returnflag, count(*)::bigint as n, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept from lineitem group by 1")
def ml14(spark, d):
    fit = models.fit_ols(table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity"], "l_extendedprice")
    b = lambda i: F.element_at("coefficients", i)
    return fit.select("l_returnflag", "n", F.round(b(2), 4).alias("slope"), F.round(b(1), 2).alias("intercept"))


@query(
    "ml14_leave_one_out",
    """with l as (select *, year(l_shipdate) as y from lineitem), f as (select a.y, regr_slope(b.l_extendedprice, b.l_quantity) as s, regr_intercept(b.l_extendedprice, b.l_quantity) as i
        from (select distinct y from l) a join l b on a.y <> b.y group by 1)
      select y::int as y, round(avg(abs(l_extendedprice - s * l_quantity - i)), 3) as mae from l join f using (y) group by 1""",
)
def ml14_loso(spark, d):
    line = table(spark, d, "lineitem").withColumn("y", F.year("l_shipdate"))
    out = models.leave_one_out(line, "y", ["l_quantity"], "l_extendedprice")
    return out.groupBy("y").agg(F.round(F.avg(F.abs(F.col("l_extendedprice") - F.col("predicted"))), 3).alias("mae"))


@query(
    "ml13_age_factor",
    """with c(g, age, f) as (values ('1-URGENT', 22, 1.1), ('1-URGENT', 30, 1.0), ('1-URGENT', 25, 0.0), ('2-HIGH', 22, 0.8), ('2-HIGH', 23, 0.9), ('2-HIGH', 24, 1.2)),
      b as (select o_orderkey, o_orderpriority as g, year(o_orderdate) as y, case when o_custkey % 3 = 0 then 1970 + o_custkey % 6 when o_custkey % 3 = 1 then 1968 end as born from orders),
      a as (select *, case when born is not null then least(30, greatest(22, y - born)) end as age from b)
      select o_orderkey, coalesce(case when f > 0 then f end, 1.0)::double as factor from a left join c using (g, age)""",
)
def ml13(spark, d):
    """The factor of an age by group: a birth year by key goes before one by group and name; unknown ones give 1."""
    o = table(spark, d, "orders")
    o = o.withColumn("season", F.year("o_orderdate")).withColumn("name", (F.col("o_custkey") % 3).cast("string"))
    keys = o.where("o_custkey % 3 = 0").select("o_custkey", (1970 + F.col("o_custkey") % 6).cast("int").alias("born")).distinct()
    names = o.where("o_custkey % 3 = 1").select("o_orderpriority", "name", F.lit(1968).alias("born")).distinct()
    curve = [("1-URGENT", 22, 1.1), ("1-URGENT", 30, 1.0), ("1-URGENT", 25, 0.0), ("2-HIGH", 22, 0.8), ("2-HIGH", 23, 0.9), ("2-HIGH", 24, 1.2)]
    curve = spark.createDataFrame(curve, "o_orderpriority string, age int, f double")
    return models.age_factor(o, keys, names, curve, "o_custkey", "o_orderpriority", "name", "season").select("o_orderkey", "factor")


USE = {"BUILDING": {"features": ["n", "spent"], "b": [0.1, 0.4, 0.5], "mean": 1.0, "amp": 0.8}, "MACHINERY": {"features": ["n"], "b": [0.5, 0.6], "mean": 1.1, "amp": 0.5}}


@query(
    "ml13_opportunity_factor",
    """with u as (select o_custkey as k, year(o_orderdate) as y, count(*)::double as n, sum(round(o_totalprice)::bigint)::double as spent from orders group by 1, 2),
      r as (select c_custkey as k, c_mktsegment as g, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as rank from customer),
      a as (select r.k, g, rank, (rank - 1) // 12 as b, t.y from r, (values (1994), (1995), (1999)) t(y)),
      m as (select g, (rank - 1) // 12 as b, avg(n) as mn, avg(spent) as ms from u join r on r.k = u.k group by 1, 2),
      j as (select a.k, a.y, a.g, a.rank, u.n is not null and m.mn is not null and rank <= 60 as known, case when u.n is not null and mn > 0.5 then u.n / mn else 1 end as rn, case when u.spent is not null and ms > 1 then u.spent / ms else 1 end as rs
        from a left join u on u.k = a.k and u.y = a.y - 1 left join m on m.g = a.g and m.b = a.b)
      select k, y::int as y, round(case when not known then 1.0 when g = 'BUILDING' then 1 + (least(1.3, greatest(0.7, 0.1 + 0.4 * rn + 0.5 * rs)) - 1) * 0.8
        when g = 'MACHINERY' then 1 + (least(1.3, greatest(0.7, (0.5 + 0.6 * rn) / 1.1)) - 1) * 0.5 else 1.0 end, 8) as factor from j""",
)
def ml13_use(spark, d):
    """The factor of each customer's orders of the year before, against those of customers of about its rank."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    use = o.groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.sum(F.round("o_totalprice").cast("bigint")).alias("spent"))
    r = ranking.ordinal(c, ["c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")], "rank").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("g"), "rank")
    means = use.join(r, "k").groupBy("g", F.floor((F.col("rank") - 1) / 12).alias("bucket")).agg(F.avg("n").alias("n"), F.avg("spent").alias("spent"))
    asked = r.withColumn("y", F.explode(F.array(F.lit(1994), F.lit(1995), F.lit(1999))))
    got = models.opportunity_factor(asked, use, means, "k", "g", "rank", "y", USE, {"n": 0.5, "spent": 1.0})
    return got.select("k", "y", F.round("factor", 8).alias("factor"))


@query("ml15_quantile_fit")
def ml15(spark, d):
    line = table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity", "l_discount")
    return models.fit_quantile(line, ["l_returnflag", "l_linenumber"], ["l_discount"], "l_quantity", 0.9)


@query("ml16_boosted_mean")
def ml16(spark, d):
    """The price by boosted trees, learned from the years before 1997; a row for each line of the years after."""
    line = table(spark, d, "lineitem").withColumn("y", F.year("l_shipdate")).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "y")
    got = models.boosted(line.where("y < 1997"), line.where("y >= 1997"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "p")
    return got.select("l_orderkey", "l_linenumber", "l_extendedprice", "p")


@query("ml16_boosted_chance")
def ml16_chance(spark, d):
    line = table(spark, d, "lineitem").withColumn("y", F.year("l_shipdate")).withColumn("large", (F.col("l_extendedprice") > 30000).cast("double"))
    line = line.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "large", "y")
    got = models.boosted(line.where("y < 1997"), line.where("y >= 1997"), ["l_quantity", "l_discount"], "large", "p", classes=True)
    return got.select("l_orderkey", "l_linenumber", "large", "p")


@query("ml17_logistic")
def ml17(spark, d):
    line = table(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int")).withColumn("q", F.col("l_quantity") / 50)
    w = models.fit_logistic(line, ["q", "l_discount"], "y")
    return spark.createDataFrame(list(zip(["intercept", "q", "l_discount"], w)), "term string, weight double")


@query("ml18_embargo", "select year(o_orderdate)::int as y, count(*)::bigint as n from orders where year(o_orderdate) < 1997 and year(o_orderdate) <> 1994 group by 1")
def ml18(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return models.embargoed(o, "y", 1997, [1994]).groupBy("y").agg(F.count("*").alias("n"))


@query(
    "ml20_carry_forward",
    """with s as (select o_custkey as k, year(o_orderdate) as y, sum(round(o_totalprice)::bigint)::double as v from orders group by 1, 2), b as (select a.k, a.y, a.v, l.v as last from s a join s l on l.k = a.k and l.y = a.y - 1),
      r as (select v / last as r from b where last > 20 and y <> 1997), q as (select quantile_cont(r, 0.1) as q10, quantile_cont(r, 0.5) as q50, quantile_cont(r, 0.9) as q90 from r)
      select k, v as mean, round(v * q10, 4) as p10, round(v * q50, 4) as p50, round(v * q90, 4) as p90 from s, q where y = 1996""",
)
def ml20(spark, d):
    o = table(spark, d, "orders")
    s = o.groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.sum(F.round("o_totalprice").cast("bigint")).cast("double").alias("v"))
    got = models.carry_forward(s, ["k"], "y", "v", 1997, {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return got.select("k", "mean", *(F.round(c, 4).alias(c) for c in ("p10", "p50", "p90")))


@query("ml19_forward_blocks", "with y as (select distinct year(o_orderdate)::int as y from orders), r as (select y, row_number() over (order by y)::int - 1 as n from y) select y as test, n as n_train from r where n >= 2")
def ml19(spark, d):
    """Each order year with two or more before it, which train for it."""
    years = [r.y for r in table(spark, d, "orders").select(F.year("o_orderdate").alias("y")).distinct().collect()]  # a row a year
    return spark.createDataFrame([(t, len(tr)) for tr, t in models.forward_blocks(years, 2)], "test int, n_train int")


# Metrics

Y, P = "l_extendedprice", "forecast"


def forecasts(spark, d):
    line = table(spark, d, "lineitem")
    return line.withColumn("forecast", F.col("l_quantity") * 1000).withColumn("p10", F.col("l_quantity") * 500).withColumn("p90", F.col("l_quantity") * 1800)


@query(
    "mx01_fit_quality",
    """with f as (select l_returnflag, l_extendedprice as y, l_quantity * 1000 as p from lineitem)
      select l_returnflag, round(sqrt(avg(pow(p - y, 2))), 4) as rmse, round(1 - sum(pow(p - y, 2)) / (sum(y * y) - sum(y) * sum(y) / count(y)), 6) as r2, round(avg(p - y), 4) as bias from f group by 1""",
)
def mx01(spark, d):
    g = forecasts(spark, d).groupBy("l_returnflag").agg(*models.fit_quality(Y, P))
    return g.select("l_returnflag", F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"), F.round("bias", 4).alias("bias"))


PIN = "case when y >= {p} then {q} * (y - {p}) else ({q} - 1) * (y - {p}) end"


@query(
    "mx02_pinball_crps",
    "with f as (select l_returnflag, l_extendedprice as y, l_quantity * 1000 as m, l_quantity * 500 as lo, l_quantity * 1800 as hi from lineitem) select l_returnflag, "
    + f"round(avg({PIN.format(p='lo', q=0.1)}), 3) as pin10, round(avg(({PIN.format(p='lo', q=0.1)} + {PIN.format(p='m', q=0.5)} + {PIN.format(p='hi', q=0.9)}) / 3), 3) as season, "
    + f"round(avg(2 * ({PIN.format(p='lo', q=0.1)} + {PIN.format(p='m', q=0.5)} + {PIN.format(p='hi', q=0.9)}) / 3), 3) as week from f group by 1",
)
def mx02(spark, d):
    """The season's score is the mean of three pinball losses; the week's (MX-03) is twice that."""
    q = {0.1: F.col("p10"), 0.5: F.col(P), 0.9: F.col("p90")}
    y = F.col(Y)
    return forecasts(spark, d).groupBy("l_returnflag").agg(
        F.round(F.avg(models.pinball(y, q[0.1], 0.1)), 3).alias("pin10"), F.round(F.avg(models.crps_season(y, q)), 3).alias("season"), F.round(F.avg(models.crps_week(y, q)), 3).alias("week")
    )


@query("mx04_coverage", "select l_returnflag, avg((l_extendedprice between l_quantity * 500 and l_quantity * 1800)::int) as inside, avg(case when l_extendedprice > 20000 then (l_extendedprice between l_quantity * 500 and l_quantity * 1800)::int end) as inside_high from lineitem group by 1")
def mx04(spark, d):
    inside = F.col(Y).between(F.col("p10"), F.col("p90")).cast("int")
    return forecasts(spark, d).groupBy("l_returnflag").agg(F.avg(inside).alias("inside"), F.avg(F.when(F.col(Y) > 20000, inside)).alias("inside_high"))


CHANCE = "f as (select least(1.0, greatest(0.0, 0.5 + n_chars / 20000.0)) as p, quality as y, lang from labels join documents using (doc_id))"


def chances(spark, d):
    p = numbers.clamp(0.5 + F.col("n_chars") / 20000, 0.0, 1.0)
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("lang", p.alias("p"), F.col("quality").alias("y"))


@query("mx05_brier", f"with {CHANCE} select lang, round(avg(pow(p - y, 2)), 8) as brier, round(avg(-(y * ln(least(1 - 1e-6, greatest(1e-6, p))) + (1 - y) * ln(1 - least(1 - 1e-6, greatest(1e-6, p))))), 8) as logloss from f group by 1")
def mx05(spark, d):
    brier, loss = models.brier_and_logloss("p", "y")
    return chances(spark, d).groupBy("lang").agg(brier, loss).select("lang", F.round("brier", 8).alias("brier"), F.round("logloss", 8).alias("logloss"))


@query("mx05_reliability", f"with {CHANCE} select least(4, floor(p * 5))::int as bin, count(*)::bigint as n, round(avg(p), 8) as chance, avg(y) as share from f group by 1")
def mx05_bins(spark, d):
    return models.reliability(chances(spark, d), [], "p", "y").select("bin", "n", F.round("chance", 8).alias("chance"), "share")


@query(
    "mx06_gate",
    "with f as (select l_returnflag, l_extendedprice as y, l_quantity * 1000 as m, l_quantity * 500 as lo, l_quantity * 1800 as hi from lineitem), "
    + f"g as (select l_returnflag, avg(2 * ({PIN.format(p='lo', q=0.1)} + {PIN.format(p='m', q=0.5)} + {PIN.format(p='hi', q=0.9)}) / 3) as crps, 20000.0::double as floor, "
    + """avg(case when y > 0 then (y between lo and hi)::int end) as coverage, abs(0.0 - avg((y = 0)::int)) as zero_error from f group by rollup (l_returnflag))
      select l_returnflag, round(crps, 6) as crps, floor, coverage, zero_error,
        crps < floor and zero_error <= 0.03 and case when l_returnflag is null then coverage between 0.75 and 0.85 else coverage between 0.70 and 0.90 end as passes from g""",
)
def mx06(spark, d):
    f = forecasts(spark, d).withColumn("floor", F.lit(20000.0)).withColumn("zero", F.lit(0.0))
    return models.gate(f, "l_returnflag", Y, {0.1: "p10", 0.5: P, 0.9: "p90"}, "floor", "zero").withColumn("crps", F.round("crps", 6))


@query("mx07_bootstrap")
def mx07(spark, d):
    o = table(spark, d, "orders").withColumn("season", F.year("o_orderdate"))
    return models.clustered_bootstrap(o, "season", "o_totalprice")


@query("mx08_correlations", "select l_returnflag, round(corr(l_quantity, l_discount), 8) as r from lineitem group by 1")
def mx08(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_discount"), 8).alias("r"))


@query(
    "mx08_spearman",
    """with r as (select p_brand, rank() over (partition by p_brand order by p_size) + (count(*) over (partition by p_brand, p_size) - 1) / 2 as x,
        rank() over (partition by p_brand order by p_retailprice) + (count(*) over (partition by p_brand, p_retailprice) - 1) / 2 as y from part)
      select p_brand, round(corr(x, y), 8) as rho from r group by 1""",
)
def mx08_spearman(spark, d):
    return models.spearman(table(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice", "rho").withColumn("rho", F.round("rho", 8))


@query(
    "mx08_partial",
    """with r as (select l_returnflag, corr(l_extendedprice, l_discount) as a, corr(l_extendedprice, l_quantity) as b, corr(l_discount, l_quantity) as c from lineitem group by 1)
      select l_returnflag, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 8) as r from r""",
)
def mx08_partial(spark, d):
    return models.partial_correlation(table(spark, d, "lineitem"), ["l_returnflag"], Y, "l_discount", "l_quantity", "r").withColumn("r", F.round("r", 8))


@query(
    "mx09_bh_fdr",
    """with p as (select p_brand, (count(*) * 37 % 101) / 101.0 as p from part group by 1), r as (select *, row_number() over (order by p, p_brand) as k, count(*) over () as n from p)
      select p_brand, round(least(1.0, min(p * n / k) over (order by p, p_brand rows between current row and unbounded following)), 8) as q from r""",
)
def mx09(spark, d):
    p = table(spark, d, "part").groupBy("p_brand").agg(((F.count("*") * 37 % 101) / 101).alias("p"))
    return models_bh(p).select("p_brand", F.round("q", 8).alias("q"))


def models_bh(p):
    return ranking.benjamini_hochberg(p, [], "p", "p_brand")


@query(
    "mx09_paired_effect",
    """with s as (select year(l_shipdate) as y, avg(abs(l_extendedprice - l_quantity * 1000) - abs(l_extendedprice - l_quantity * 1100)) as d from lineitem group by 1)
      select round(avg(d), 4) as effect, round(stddev_samp(d) / sqrt(count(*)), 4) as se, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) as t, round(2.9 * stddev_samp(d) / sqrt(count(*)), 4) as detectable from s""",
)
def mx09_effect(spark, d):
    line = table(spark, d, "lineitem").withColumn("y", F.year("l_shipdate"))
    line = line.withColumn("a", F.abs(F.col(Y) - F.col("l_quantity") * 1000)).withColumn("b", F.abs(F.col(Y) - F.col("l_quantity") * 1100))
    return models.paired_effect(line, "y", "a", "b").select(*(F.round(c, 4).alias(c) for c in ("effect", "se", "t", "detectable")))


@query("mx09_overfit", "with p as (select o_custkey % 97 as k, sum(case when month(o_orderdate) <= 6 then 1 else -1 end) as a, sum(case when day(o_orderdate) <= 15 then 1 else -1 end) as b from orders group by 1) select avg((sign(a) <> sign(b))::int) as pbo from p where a <> 0")
def mx09_pbo(spark, d):
    half = lambda c: F.sum(F.when(c, 1).otherwise(-1))
    p = table(spark, d, "orders").groupBy((F.col("o_custkey") % 97).alias("k")).agg(half(F.month("o_orderdate") <= 6).alias("a"), half(F.dayofmonth("o_orderdate") <= 15).alias("b"))
    return models.overfit_chance(p, "a", "b")


@query(
    "mx11_pick_backtest",
    """with s as (select l_suppkey as s, l_partkey as p, year(l_shipdate) as y, sum(l_quantity) as q from lineitem group by all), b as (select a.s, a.p, a.y, a.q, coalesce(l.q, 0) as f from s a left join s l on l.s = a.s and l.p = a.p and l.y = a.y - 1),
      k as (select *, row_number() over (partition by s, y order by f desc, p) as kf, row_number() over (partition by s, y order by q desc, p) as kq from b)
      select s, y, max(p) filter (kf = 1) as picked, max(p) filter (kq = 1) as best, max(q) filter (kf = 1) as got, max(q) filter (kq = 1) as most, max(q) filter (kq = 1) - max(q) filter (kf = 1) as regret from k group by 1, 2""",
)
def mx11_pick(spark, d):
    """Each year a supplier takes the part that sold most the year before; what the best would have sold."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").alias("q"))
    last = s.select("s", "p", (F.col("y") + 1).alias("y"), F.col("q").alias("f"))
    both = s.join(last, ["s", "p", "y"], "left").withColumn("f", F.coalesce("f", F.lit(0.0)))
    return decisions.pick_backtest(both, ["s", "y"], "p", "f", "q")


@query(
    "mx11_capture_backtest",
    """with s as (select o_custkey as k, c_nationkey as g, year(o_orderdate) as y, sum(round(o_totalprice)::bigint)::bigint as v from orders join customer on c_custkey = o_custkey group by 1, 2, 3), b as (select a.*, coalesce(l.v, 0) as f from s a left join s l on l.k = a.k and l.y = a.y - 1),
      r as (select *, row_number() over (partition by g, y order by f desc, k) as kf, row_number() over (partition by g, y order by v desc, k) as ka from b)
      select g, y::int as y, sum(v) filter (kf <= 3)::bigint as got, sum(v) filter (ka <= 3)::bigint as most, round(sum(v) filter (kf <= 3) / sum(v) filter (ka <= 3), 8) as share from r group by 1, 2""",
)
def mx11_capture(spark, d):
    """Of each nation's customers, the three that spent most the year before: what they spent of what the best three did."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("g"))
    s = table(spark, d, "orders").join(c, "o_custkey").groupBy(F.col("o_custkey").alias("k"), "g", F.year("o_orderdate").alias("y")).agg(F.sum(F.round("o_totalprice").cast("bigint")).alias("v"))
    last = s.select("k", (F.col("y") + 1).alias("y"), F.col("v").alias("f"))
    both = s.join(last, ["k", "y"], "left").withColumn("f", F.coalesce("f", F.lit(0)))
    return decisions.capture_backtest(both, ["g", "y"], "k", "f", "v", 3).withColumn("share", F.round("share", 8))


@query(
    "mx11_stream_backtest",
    """with v as (select year(l_shipdate)::int as y, month(l_shipdate)::int as m, l_returnflag as g, case when l_linestatus = 'F' then l_suppkey end as team, l_orderkey * 10 + l_linenumber as row, l_quantity as f, l_extendedprice as a, l_partkey as tie from lineitem),
      u as (select y, m, g, team, f, max(a) as a from v group by all), w as (select *, row_number() over (partition by y, m, g, team order by f desc) as k, max(a) over (partition by y, m, g, team) as most from u),
      o as (select * from w where k = 1 and team is not null), p as (select * from w where k = 1 and team is null)
      select o.y, o.m, o.g, o.team, o.a as hold, case when p.f > o.f then p.a else o.a end as stream, greatest(o.most, p.most) as ceiling from o left join p on p.y = o.y and p.m = o.m and p.g = o.g""",
)
def mx11_stream(spark, d):
    """Lines of a month as candidates, those of one status free for all: the quantity forecasts the price; of equal
    quantities the dearest counts."""
    line = table(spark, d, "lineitem")
    team = F.when(F.col("l_linestatus") == "F", F.col("l_suppkey")).alias("team")
    v = line.select(F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"), F.col("l_returnflag").alias("g"), team, F.col("l_quantity").alias("f"), F.col("l_extendedprice").alias("a"), (-F.col("l_extendedprice")).alias("row"))
    return decisions.stream_backtest(v, ["y", "m"], "g", "team", "row", "f", "a")


@query("mx11_lineup_backtest")
def mx11_lineup(spark, d):
    """Lineups of each nation's customers, by region: what those chosen by a guess made of what could be made."""
    r = roster(spark, d).join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("season")), "c_nationkey")
    return decisions.lineup_backtest(r, "season", ["c_nationkey"], "c_custkey", "guess", "c_acctbal", "eligible", ["QB", "RB", "RB", "WR", "FLEX"])


@query(
    "mx12_noise_floor",
    """with s as (select o_custkey as k, stddev_samp(o_totalprice) / sqrt(count(*)) / 10000 as se, count(*)::bigint as n from orders group by 1)
      select k, case when se is not null and n >= 3 then round(2.9 * greatest(se, 100.0 / 300 / sqrt(n)), 8) end as floor from s""",
)
def mx12(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.stddev_samp("o_totalprice") / F.sqrt(F.count("*")) / 10000).alias("se"), F.count("*").alias("n"))
    return s.select("k", F.round(decisions.noise_floor(F.col("se"), F.lit(300), F.col("n")), 8).alias("floor"))


@query(
    "mx13_odds_invariants",
    """with o as (select n_regionkey as league, count(*) as w, 1.0 as t, count(*)::double as g, sum(case when c_acctbal > 0 then 1 else 0 end) * 4.0 / count(*) as p from customer join nation on n_nationkey = c_nationkey group by 1)
      select league, 'wins' as name, w::double as got, g as want, true as ok from o union all select league, 'field', round(p, 8), 4.0, abs(p - 4) <= 0.05 from o union all select league, 'champion', 1.0, 1.0, true from o""",
)
def mx13(spark, d):
    """A region's customers as a league of equals: a win each, a title shared by all; the field only adds up to four
    places where none of them is in debt."""
    c = table(spark, d, "customer").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("league")), "c_nationkey")
    n = F.count(F.lit(1)).over(Window.partitionBy("league"))
    odds = c.select("league", F.lit(1.0).alias("wins"), F.when(F.col("c_acctbal") > 0, 4 / n).otherwise(0.0).alias("playoff"), (1 / n).alias("title"), n.alias("n"))
    return decisions.odds_invariants(odds, ["league"], 4, F.col("n")).withColumn("got", F.round("got", 8))


# Valuation

STARTERS = {"RB": 40, "QB": 20, "WR": 50}


def board(spark, d):
    return roster(spark, d).select("c_custkey", F.element_at("eligible", 1).alias("pos"), F.col("c_acctbal").alias("v"))


BOARD = "b as (select c_custkey, case when c_mktsegment in ('BUILDING', 'AUTOMOBILE') then 'RB' when c_mktsegment = 'MACHINERY' then 'QB' else 'WR' end as pos, c_acctbal as v from customer)"


@query(
    "vl01_baselines",
    f"""with {BOARD}, r as (select *, row_number() over (partition by pos order by v desc, c_custkey) as k from b), l as (select * from r where k > case pos when 'RB' then 40 when 'QB' then 20 else 50 end),
      f as (select c_custkey from l where pos in ('RB', 'WR') order by v desc, c_custkey limit 30), m as (select * from l where c_custkey not in (select c_custkey from f)),
      s as (select c_custkey from m where pos in ('QB', 'RB', 'WR') order by v desc, c_custkey limit 10)
      select pos, max(v) as baseline from m where c_custkey not in (select c_custkey from s) group by 1""",
)
def vl01(spark, d):
    return decisions.flex_baselines(board(spark, d), "pos", "v", "c_custkey", STARTERS, [(("QB", "RB", "WR"), 10), (("RB", "WR"), 30)])


@query(
    "vl02_dollars",
    f"""with {BOARD}, r as (select *, row_number() over (partition by pos order by v desc, c_custkey) as k from b), l as (select pos, v as baseline from r where k = case pos when 'RB' then 41 when 'QB' then 21 else 51 end),
      o as (select c_custkey, b.pos, greatest(0, v - coalesce(baseline, v)) as vor from b left join l using (pos)),
      t as (select sum(vor) filter (pos <> 'QB') as a, sum(vor) filter (pos = 'QB') as q from o)
      select c_custkey, case when vor > 0 then floor(1 + vor * case when pos = 'QB' then 100 / q else (12 * 200 - 12 * 15 - 100) / a end + 0.5) else 1 end::bigint as dollars from o, t""",
)
def vl02(spark, d):
    b = board(spark, d)
    base = decisions.dedicated_baselines(b, "pos", "v", "c_custkey", STARTERS)
    return decisions.dollars(b, "pos", "v", base, 12, 200, 15, {"QB": 100.0}).select("c_custkey", "dollars")


@query("vl03_inflation", "select least(1.4, greatest(0.8, 500000.0 / sum(greatest(1.0, c_acctbal)))) as inflation from (select c_acctbal from customer order by c_acctbal desc, c_custkey limit 60)")
def vl03(spark, d):
    return decisions.inflation(table(spark, d, "customer"), "c_acctbal", "c_custkey", 500000.0, 60)


@query("vl04_power_ratings")
def vl04(spark, d):
    """Nations rated by all lines that a supplier of one sold to a customer of another, the discount being the spread."""
    line, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("home"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("away"))
    sold = line.select("l_orderkey", "l_suppkey", (F.col("l_discount") * 100 - 5).alias("spread")).join(s, "l_suppkey")
    games = sold.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(c, "o_custkey")
    return decisions.power_ratings(games.where("home <> away").select("home", "away", "spread"))


@query("vl05_schedule_strength", "with s as (select l_partkey as k, sum(round(s_acctbal * 100)::bigint) / count(*) as sos from lineitem join supplier on s_suppkey = l_suppkey where month(l_shipdate) >= 10 group by 1) select k, sos, rank() over (order by sos desc) as rank from s")
def vl05(spark, d):
    line, s = table(spark, d, "lineitem").where(F.month("l_shipdate") >= 10), table(spark, d, "supplier")
    sos = line.join(s, line.l_suppkey == s.s_suppkey).groupBy(F.col("l_partkey").alias("k")).agg((F.sum(cents("s_acctbal")) / F.count("*")).alias("sos"))
    return ranking.rank_over_all(sos, "sos").select("k", "sos", "rank")


@query(
    "vl06_group_multipliers",
    """with v as (select year(l_shipdate) as y, l_returnflag as g, l_suppkey as a, l_extendedprice as x from lineitem), l as (select y, g, avg(x) as m from v group by 1, 2),
      r as (select v.y, v.g, a, count(*)::bigint as n, avg(x) / any_value(m) as raw from v join l on l.y = v.y and l.g = v.g group by 1, 2, 3),
      c as (select p.g, corr(p.raw, q.raw) as r from r p join r q on q.y = p.y + 1 and q.g = p.g and q.a = p.a group by 1)
      select y::int as y, r.g, a, n, round(1 + greatest(0, coalesce(case when not isnan(c.r) then c.r end, 0)) * (raw - 1), 6) as mult from r left join c on c.g = r.g""",
)
def vl06(spark, d):
    line = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("y"), F.col("l_returnflag").alias("g"), F.col("l_suppkey").alias("a"), F.col("l_extendedprice").alias("x"))
    return decisions.group_multipliers(line, "y", "g", "a", "x").withColumn("mult", F.round("mult", 6))


@query(
    "vl08_expected_best",
    """with c as (select c_nationkey as k, c_mktsegment as pos, c_acctbal as v, 0.5 + (c_custkey % 4) / 10.0 as a, c_custkey from customer),
      w as (select *, coalesce(sum(ln(1 - a)) over b, 0) as l, coalesce(sum(a / (1 - a)) over b, 0) as odds from c window b as (partition by k, pos order by v desc, c_custkey rows between unbounded preceding and 1 preceding))
      select k, pos, round(sum(v * a * exp(l) * (1 + odds)), 5) as expected from w group by 1, 2""",
)
def vl08(spark, d):
    """The two best of each nation's customers in a segment, each there with its own chance."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("pos"), F.col("c_acctbal").alias("v"), (0.5 + (F.col("c_custkey") % 4) / 10).alias("a"), "c_custkey")
    return decisions.expected_best(c, ["k", "pos"], "v", "a", "c_custkey", 2).withColumn("expected", F.round("expected", 5))


@query("vl08_marginals")
def vl08_marginals(spark, d):
    """Twenty customers in a row of their keys are a roster, with the share of their orders that are filled as the chance
    that they are there: the expected lineup, and what it loses without each."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("chance"))
    pos = F.when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), "RB").when(F.col("c_mktsegment") == "MACHINERY", "QB").otherwise("WR")
    c = table(spark, d, "customer").join(o, "c_custkey", "left").select((F.col("c_custkey") / 20).cast("long").alias("team"), "c_custkey", "c_acctbal", "chance", pos.alias("pos"))
    return decisions.lineup_marginals(c, ["team"], "c_custkey", "c_acctbal", "chance", "pos", ["QB", "RB", "RB", "WR", "FLEX", "SUPERFLEX"])


@query(
    "vl09_backup_board",
    """with r as (select *, row_number() over (partition by c_nationkey, c_mktsegment order by c_acctbal desc, c_custkey) as k from customer), l as (select * from r where k = 1 and c_acctbal > 0)
      select r.c_nationkey, r.c_mktsegment, r.c_custkey, l.c_custkey as lead, round((l.c_acctbal - r.c_acctbal) / 8 * (l.c_custkey % 10 / 20.0) * 8, 6) as gain from r join l on l.c_nationkey = r.c_nationkey and l.c_mktsegment = r.c_mktsegment where r.k > 1""",
)
def vl09(spark, d):
    c = table(spark, d, "customer").withColumn("miss", (F.col("c_custkey") % 10) / 20)
    return decisions.backup_board(c, ["c_nationkey", "c_mktsegment"], "c_custkey", "c_acctbal", "miss", 8).withColumn("gain", F.round("gain", 6))


@query("vl07_profiles", "with g as (select o_custkey, o_orderpriority, count(*) as n from orders group by 1, 2) select o_custkey, o_orderpriority, n / sum(n) over (partition by o_custkey) as share, round(sum(n * n) over (partition by o_custkey) / pow(sum(n) over (partition by o_custkey), 2), 8) as concentration from g")
def vl07(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    w = Window.partitionBy("o_custkey")
    total = F.sum("n").over(w)
    return g.select("o_custkey", "o_orderpriority", (F.col("n") / total).alias("share"), F.round(F.sum(F.col("n") * F.col("n")).over(w) / (total * total), 8).alias("concentration"))


# Draws and lineage


@query("mc01_keyed_draws")
def mc01(spark, d):
    """A uniform and a normal draw of each order, by purpose, seed and key."""
    keys = (F.lit("points"), F.lit(42), F.col("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", numbers.keyed_draw(*keys).alias("u"), numbers.keyed_normal(*keys).alias("z"))


@query(
    "lineage_depths",
    """select 'region ' || r_regionkey as node, 0 as depth from region join nation on n_regionkey = r_regionkey group by 1 union select 'nation ' || n_nationkey, 1 from nation
      union select 'segment ' || n_nationkey || ' ' || c_mktsegment, 2 from customer join nation on n_nationkey = c_nationkey""",
)
def lineage(spark, d):
    """Regions feed nations, and these and their regions the segments that their customers are of."""
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("region "), "n_regionkey").alias("region"), F.concat(F.lit("nation "), "n_nationkey").alias("nation"))
    segment = F.concat(F.lit("segment "), F.col("n_nationkey").cast("string"), F.lit(" "), "c_mktsegment")
    s = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").distinct().join(n, "n_nationkey")
    producers = n.select(F.array("region").alias("reads"), F.array("nation").alias("writes")).unionByName(s.select(F.array("nation", "region").alias("reads"), F.array(segment).alias("writes")))
    return decisions.depths(decisions.lineage_edges(producers))
