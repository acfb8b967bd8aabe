"""Queries on tables that differ from the small ones: repeated names, keys that meet, other entities, and plans whose work
grows with the rows."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from oracle import check  # noqa: E402

from panelwright.operators import relational as op  # noqa: E402
from panelwright.plans import catalog  # noqa: E402

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


def saved(df, folder, name):
    df.coalesce(1).write.parquet(f"{folder}/_{name}")
    (part,) = Path(f"{folder}/_{name}").glob("part-*.parquet")
    part.rename(f"{folder}/{name}.parquet")
    return str(folder)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_theta_self_meets_by_bands(spark, tmp_path):
    r = random.Random(1)
    rows = [(k, r.choice([0, 1, None]), "A", r.choice([None, float("nan"), -100.0, 0.0, 100.0, 99.99999999999999, r.uniform(-500, 500)])) for k in range(300)]
    df = spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double")
    folder = saved(df, tmp_path, "customer")
    found = QUERIES["jn07_theta_self"](spark, folder)
    assert "__band" in plan(found).split("Join Inner", 1)[1].splitlines()[0]
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] is not None and a[1:3] == b[1:3] and a[0] < b[0] and None not in (a[3], b[3]) and abs(a[3] - b[3]) < 100}
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(want) and set(got) == want


def test_nicknames_that_many_rows_share(spark, tmp_path):
    df = spark.range(3000).selectExpr("id as p_partkey", "case when id % 3 = 0 then 'blue ring' when id % 3 = 1 then 'navy ring' else 'red bolt' end as p_name", "cast(case when id % 3 = 2 then 7 when id < 2000 then null else id % 2 end as int) as p_size")
    folder = saved(df, tmp_path, "part")
    found = QUERIES["jn20_nicknames"](spark, folder)
    assert plan(found).count("Aggregate") == 2  # names are counted before they meet
    assert check(found, folder, ORACLES["jn20_nicknames"]) == 3000


def test_import_keeps_rows_whose_keys_meet(spark, tmp_path):
    folder = saved(spark.range(2500).selectExpr("id as s_suppkey", "concat('S', id) as s_name"), tmp_path, "supplier")
    assert check(QUERIES["src13_import"](spark, folder), folder, ORACLES["src13_import"]) == 1250 + 834


def test_titles_with_other_entities(spark, tmp_path):
    titles = ["a &lt;b&gt; &amp; c", "&quot;q&quot; &#39;s&#39;&nbsp;x", "&amp;lt;", ""]
    df = spark.createDataFrame([(i, f"<title>{t}</title>") for i, t in enumerate(titles)], "page_id long, html string")
    folder = saved(df, tmp_path, "pages")
    assert check(QUERIES["str07_entities"](spark, folder), folder, ORACLES["str07_entities"]) == 4


@pytest.mark.parametrize("name", ["jn23_nearest_bucket", "jn27_pick_homonym"])
def test_no_partition_holds_a_whole_key(spark, sf, name):
    assert "Window" not in plan(QUERIES[name](spark, sf))


def test_nearest_bucket_of_odd_rows(spark):
    df = spark.createDataFrame([(1, 5.0), (1, None), (None, 1.0), (2, 3.0), (1, 10.0), (1, -9.0)], "k int, x double")
    buckets = spark.createDataFrame([(1, 0.0), (1, 10.0), (1, 10.0), (None, 4.0), (1, None)], "k int, b double")
    got = {tuple(r) for r in op.nearest_bucket(df, buckets, ["k"], "x", "b", "near").collect()}
    assert got == {(1, 5.0, 0.0), (1, None, 0.0), (None, 1.0, 4.0), (2, 3.0, None), (1, 10.0, 10.0), (1, -9.0, 0.0)}


def test_served_ranks_over_lines_and_no_window_holds_a_group(spark):
    from panelwright.operators import models

    rows = [(1, "a", 5.0, None, 2.0, 0.5), (1, "a", 7.0, "x", 2.0, 0.5), (1, "a", 5.0, "x", 2.0, 0.5), (1, "a", None, "x", 2.0, 0.5), (1, "a", 1.0, "x", 2.0, 0.5), (None, None, 3.0, None, 2.0, 0.5), (None, None, 4.0, "x", 2.0, 0.5), (2, "a", 3.0, None, 2.0, 0.5)]
    df = spark.createDataFrame(rows, "y int, g string, line double, opp string, v double, zero double")
    got = models.served(df, ["y"], "g", "line", "opp", ["v"], "zero")
    assert sorted(map(str, got.select("y", "g", "line", "opp", "v", "zero", "rank", "no_game").collect())) == sorted(
        str(r)
        for r in spark.createDataFrame(
            [(1, "a", 5.0, None, 0.0, 1.0, 2, True), (1, "a", 7.0, "x", 2.0, 0.5, 1, False), (1, "a", 5.0, "x", 2.0, 0.5, 2, False), (1, "a", None, "x", 2.0, 0.5, 5, False), (1, "a", 1.0, "x", 2.0, 0.5, 4, False), (None, None, 3.0, None, 0.0, 1.0, 2, True), (None, None, 4.0, "x", 2.0, 0.5, 1, False), (2, "a", 3.0, None, 2.0, 0.5, 1, False)],
            "y int, g string, line double, opp string, v double, zero double, rank int, no_game boolean",
        ).collect()
    )
    nodes = [n.strip(" :+-|") for n in got._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    assert all("Aggregate" in nodes[i + 1] for i, n in enumerate(nodes) if n.startswith("Window"))


def test_waivers_of_years_without_a_month(spark, tmp_path):
    """The month before is the calendar's; orders without a date, a price or a customer count nowhere."""
    r = random.Random(5)
    saved(spark.createDataFrame([(k, r.randint(0, 1), r.choice("AB")) for k in range(60)], "c_custkey long, c_nationkey int, c_mktsegment string"), tmp_path, "customer")
    days = [(y, m) for y in (1995, 1996, 1998) for m in range(1, 13) if (y, m) not in ((1995, 3), (1996, 7), (1996, 8))]
    rows = [(r.randrange(60), "%d-%02d-11 00:00:00" % r.choice(days), r.choice([None, *(1000.0 * r.randint(1, 9) for _ in range(6))])) for _ in range(900)]
    rows += [(99, "1995-03-02 00:00:00", 5000.0), (3, None, 4000.0), (None, "1996-02-01 00:00:00", 1000.0)]
    df = spark.createDataFrame(rows, "o_custkey long, day string, o_totalprice double").selectExpr("o_custkey", "timestamp(day) as o_orderdate", "o_totalprice")
    folder = saved(df, tmp_path, "orders")
    assert check(QUERIES["mx11_waiver_backtest"](spark, folder), folder, ORACLES["mx11_waiver_backtest"]) > 30
