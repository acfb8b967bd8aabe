"""Queries that choose between models on held-out seasons, and boosted quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting, models, selection
from ..sources.readers import table
from .registry import registry

QUERIES, ORACLES, query = registry()


def halves(spark, d):
    """Orders by year, with two forecasts of their price in thousands."""
    o = table(spark, d, "orders")
    return o.select(F.year("o_orderdate").alias("y"), (F.col("o_orderkey") % 7).cast("double").alias("a"), (F.col("o_custkey") % 7).cast("double").alias("b"))


SUBSETS = """g as (select year(o_orderdate)::int as y, avg((o_orderkey % 7) - (o_custkey % 7)) as lift from orders group by 1), s as (select *, row_number() over (order by y) - 1 as i, count(*) over () as n from g),
  m as (select m, row_number() over (order by m)::int - 1 as path from range((select 1 << max(n)::int from s)) r(m) where bit_count(m) = 3),
  p as (select path, avg(lift) filter (((m | (m << 1) | (m >> 1)) >> i::int) & 1 = 0) as train, avg(lift) filter ((m >> i::int) & 1 = 1) as test from m, s group by path)"""


@query("mx09_cpcv_paths", f"with {SUBSETS} select path, round(train, 10) as train, round(test, 10) as test from p")
def mx09_paths(spark, d):
    """All subsets of three test years, purged of their neighbours: the lift of one guess over another inside and outside."""
    got = selection.path_lifts(halves(spark, d), "y", "a", "b", 3, 10_000, purge=1)
    return got.select("path", F.round("train", 10).alias("train"), F.round("test", 10).alias("test"))


@query("mx09_cpcv_overfit", f"with {SUBSETS} select avg((sign(train) <> sign(test))::int) as pbo from p where train <> 0")
def mx09_overfit(spark, d):
    return models.overfit_chance(selection.path_lifts(halves(spark, d), "y", "a", "b", 3, 10_000, purge=1), "train", "test")


def lines(spark, d):
    line = table(spark, d, "lineitem")
    return line.select(F.year("l_shipdate").alias("y"), (F.col("l_quantity") / 50).alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), (F.col("l_extendedprice") / 1000).alias("price"))


VARIANTS = {"all": (["quantity", "discount", "tax"], 0.0), "quantity": (["quantity"], 0.0), "rates": (["discount", "tax"], 1.0)}


@query("mx09_cpcv_fits")
def mx09_fits(spark, d):
    """Three linear models of the price on ten paths of two test years, purged: losses inside and outside."""
    return selection.combinatorial_losses(lines(spark, d), "y", ["quantity", "discount", "tax"], "price", VARIANTS, 2, 10, purge=1, seed=5)


FORWARD = """l as (select year(l_shipdate)::int as y, l_quantity / 50 as x, l_extendedprice / 1000 as p from lineitem), t as (select distinct y from l),
  b as (select t.y, count(distinct l.y)::bigint as n_train, regr_slope(p, x) as m, regr_intercept(p, x) as c, avg(p) as mean from t join l on l.y < t.y and l.y >= t.y - 3 group by t.y having count(distinct l.y) >= 2),
  v as (select b.y, n_train, 'quantity' as variant, avg(pow(p - (c + m * x), 2)) as outside from b join l on l.y = b.y group by all union all select b.y, n_train, 'mean', avg(pow(p - mean, 2)) from b join l on l.y = b.y group by all)"""


@query("ml19_forward_losses", f"with {FORWARD} select y, n_train, variant, round(outside, 6) as outside from v")
def ml19_losses(spark, d):
    """Each year's price by fits on the three years before it, with the quantity and without."""
    got = selection.forward_losses(lines(spark, d), "y", ["quantity"], "price", {"quantity": (["quantity"], 0.0), "mean": ([], 0.0)}, least=2, span=3)
    return got.select("y", "n_train", "variant", F.round("outside", 6).alias("outside"))


@query("ml19_best_variant", f"with {FORWARD} select variant, round(avg(outside), 6) as loss from v group by 1 order by 2 limit 1")
def ml19_best(spark, d):
    got = selection.forward_losses(lines(spark, d), "y", ["quantity"], "price", {"quantity": (["quantity"], 0.0), "mean": ([], 0.0)}, least=2, span=3)
    return selection.best_variant(got).select("variant", F.round("loss", 6).alias("loss"))


@query(
    "ml15_grouped_folds",
    """with l as (select l_returnflag as g, year(l_shipdate)::int as y, l_quantity / 50 as x, l_extendedprice / 1000 as p from lineitem),
      f as (select g, y, (row_number() over (partition by g order by y) - 1) % 3 as fold from (select distinct g, y from l)), k as (select l.*, fold from l join f using (g, y)),
      b as (select t.g, t.fold, count(distinct k.y)::bigint as n_train, regr_slope(p, x) as m, regr_intercept(p, x) as c from (select distinct g, fold from f) t join k on k.g = t.g and k.fold <> t.fold group by 1, 2)
      select k.g, k.fold::int as fold, n_train, round(avg(pow(p - (c + m * x), 2)), 6) as outside from k join b on b.g = k.g and b.fold = k.fold group by all""",
)
def ml15_folds(spark, d):
    """Three folds of whole years for each flag."""
    line = table(spark, d, "lineitem")
    line = line.select(F.col("l_returnflag").alias("g"), F.year("l_shipdate").alias("y"), (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_extendedprice") / 1000).alias("price"))
    got = selection.grouped_losses(line, "y", ["quantity"], "price", {"quantity": (["quantity"], 0.0)}, folds=3, keys=["g"])
    return got.select("g", "fold", "n_train", F.round("outside", 6).alias("outside"))


@query("mx08_shuffle_null")
def mx08_null(spark, d):
    """Does the discount tell of the price, with the quantity held, more than when it is shuffled within its year?"""
    line = table(spark, d, "lineitem").withColumn("y", F.year("l_shipdate"))
    return selection.shuffle_null(line, "y", ["l_orderkey", "l_linenumber"], "l_discount", "l_extendedprice", ["l_quantity"], reps=10, seed=3)


@query("ml16_boosted_quantiles")
def ml16_quantiles(spark, d):
    """The price of the lines from 1997 on by three quantiles, of trees that learned from those before."""
    line = table(spark, d, "lineitem").withColumn("y", F.year("l_shipdate"))
    xs = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    got = boosting.boosted_quantiles(line.where("y < 1997"), line.where("y >= 1997"), xs, "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, trees=3, depth=2)
    return got.select("l_orderkey", "l_linenumber", "l_extendedprice", "p10", "p50", "p90")
