"""Queries of files: tables written in a feed's formats and read back, and writes to a path or catalog read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import html_tables, readers, writers
from ..sources.readers import table
from ..sources.work import work_folder
from .registry import registry

QUERIES, ORACLES, query = registry()

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_comment"]
COMMENT = """'says "' || o_orderpriority || '", twice' || chr(10) || 'and, ' || o_orderstatus"""


def noted(spark, d):
    """Orders with a note that holds a comma, quotes and a line end."""
    note = F.concat(F.lit('says "'), "o_orderpriority", F.lit('", twice\nand, '), "o_orderstatus")
    return table(spark, d, "orders").withColumn("o_comment", note)


@query("src01_csv", f"select o_orderkey, o_custkey, o_orderstatus, {COMMENT} as o_comment from orders")
def src01(spark, d):
    """Quoted fields with commas, doubled quotes and line ends come back as they were."""
    path = work_folder(spark, "csv")
    writers.save_csv(noted(spark, d).select(*ORDERS), path)
    return readers.typed(readers.read_csv(spark, path, ORDERS), {"o_orderkey": "long", "o_custkey": "long"})


@query(
    "src01_short_rows",
    "select o_orderkey, case when o_orderkey % 3 <> 0 then o_custkey end as o_custkey, case when o_orderkey % 3 = 1 then o_orderstatus else '' end as o_orderstatus from orders",
)
def src01_short(spark, d):
    """Rows that end early: what is absent is the empty string, and null as a number; NA is null as well."""
    path = work_folder(spark, "short")
    line = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string")).when(F.col("o_orderkey") % 3 == 1, F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus"))
    line = line.otherwise(F.concat_ws(",", "o_orderkey", "o_custkey"))
    line = F.when(F.col("o_orderkey") % 6 == 0, F.concat(line, F.lit(",NA"))).otherwise(line)
    table(spark, d, "orders").select(line.alias("value")).write.text(path)
    got = readers.read_csv(spark, path, ["o_orderkey", "o_custkey", "o_orderstatus"], header=False)
    return readers.typed(got, {"o_orderkey": "long", "o_custkey": "long"})


@query("src02_csv_fields", "select o_orderkey, o_orderpriority || ', \"' || o_orderstatus || '\"' as a, '' as b from orders")
def src02(spark, d):
    """One line of text at a time, with quoted fields and one that is absent."""
    line = F.concat(F.lit('"'), "o_orderpriority", F.lit(', ""'), "o_orderstatus", F.lit('"""'))
    o = table(spark, d, "orders").select("o_orderkey", line.alias("line"))
    return o.select("o_orderkey", readers.csv_fields(F.col("line"), ["a", "b"]).alias("f")).select("o_orderkey", "f.*")


@query(
    "src05_gzip_upsert",
    """with b as (select o_orderkey, o_custkey, year(o_orderdate) as y from orders where o_orderkey % 2 = 0)
      select o_custkey, coalesce(max(o_orderkey) filter (o_orderkey % 2 = 0), max(o_orderkey)) as o_orderkey from orders group by 1""",
)
def src05(spark, d):
    """A history in two compressed files, the second upserted over the first: a customer's last order of the second,
    else of the first."""
    paths = [work_folder(spark, f"history-{k}") for k in range(2)]
    for k, path in enumerate(paths):
        part = table(spark, d, "orders").where(F.col("o_orderkey") % 2 == 1 - k).select("o_custkey", "o_orderkey")
        part.write.options(header=True, compression="gzip").csv(path)
    old, new = (readers.typed(readers.read_csv(spark, p, ["o_custkey", "o_orderkey"]), {"o_custkey": "long", "o_orderkey": "long"}) for p in paths)
    return writers.upsert(writers.latest(old, ["o_custkey"], "o_orderkey"), new, ["o_custkey"], "o_orderkey")


def feed(spark, d):
    """Orders as a feed by year: a folder a year, one of them with a header and no row."""
    root = work_folder(spark, "feed")
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string"), "o_orderstatus", F.year("o_orderdate").alias("period"))
    o.write.partitionBy("period").options(header=True).csv(root)
    spark.createDataFrame([("o_orderkey,o_orderstatus",)], "value string").coalesce(1).write.text(f"{root}/period=1901")
    return root


@query(
    "src07_periods",
    """select period, case when n > 0 then 'loaded' when period = 1901 then 'empty' else 'absent' end as status, n from
      (select period, count(o_orderkey)::bigint as n from (values (1900), (1901), (1994), (1995), (1996)) p(period) left join orders on year(o_orderdate) = period group by 1)""",
)
def src07(spark, d):
    return readers.read_periods(spark, feed(spark, d), [1900, 1901, 1994, 1995, 1996], ["o_orderkey", "o_orderstatus"])[1]


@query("src07_rows", "select o_orderkey, o_orderstatus, year(o_orderdate)::int as period from orders where year(o_orderdate) between 1994 and 1996")
def src07_rows(spark, d):
    found, _ = readers.read_periods(spark, feed(spark, d), [1900, 1901, 1994, 1995, 1996], ["o_orderkey", "o_orderstatus"])
    return readers.typed(found, {"o_orderkey": "long"})


@query("src08_rss", "select page_id, 'Page & ' || page_id as title, url as link, 'Mon, 01 Jan 2024' as published from pages")
def src08(spark, d):
    """A feed of each page as RSS, its title in CDATA or with an entity by turns."""
    title = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<![CDATA[Page & "), "page_id", F.lit("]]>"))).otherwise(F.concat(F.lit("\n Page &amp; "), "page_id"))
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link><pubDate>Mon, 01 Jan 2024</pubDate></item>"))
    xml = F.concat(F.lit('<?xml version="1.0"?><rss><channel><title>no item</title>'), item, F.lit("</channel></rss>"))
    return readers.rss_items(table(spark, d, "pages").select("page_id", xml.alias("xml")), "xml", "page_id")


@query("src10_headerless_csv", "select p_partkey, p_brand, p_size from part")
def src10(spark, d):
    path = work_folder(spark, "rankings")
    table(spark, d, "part").select("p_partkey", "p_brand", "p_size").write.csv(path)
    got = readers.read_csv(spark, path, ["p_partkey", "p_brand", "p_size"], header=False)
    return readers.typed(got, {"p_partkey": "long", "p_size": "int"})


@query("src12_copy_to_catalog", "select o_orderstatus, count(*)::bigint as n from orders group by 1")
def src12(spark, d):
    database = f"export_{uuid.uuid4().hex}"  # of this run, as a warehouse may outlive its catalog
    copy = writers.copy_to_catalog(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), database, "orders_copy")
    return copy.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("snk05_overwrite_partitions", "select o_orderkey, o_custkey + case when year(o_orderdate) >= 1996 then 1000000 else 0 end as o_custkey, year(o_orderdate)::int as y from orders where year(o_orderdate) < 1996 or o_orderkey % 2 = 0")
def snk05_path(spark, d):
    """A table by year on a path, of which the later years are written anew, with other rows."""
    path = work_folder(spark, "by-year")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    o.write.partitionBy("y").parquet(path)
    new = o.where("y >= 1996 and o_orderkey % 2 = 0").withColumn("o_custkey", F.col("o_custkey") + 1000000)
    writers.overwrite_partitions(new, path, ["y"])
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", F.col("y").cast("int").alias("y"))


@query("snk08_refuse_empty", "select o_orderstatus, count(*)::bigint as n, 'refused' as second from orders group by 1")
def snk08(spark, d):
    """A table that a pull of nothing leaves as it is."""
    path = work_folder(spark, "pulled")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    writers.replace_table(o, path)
    try:
        writers.replace_table(o.where("o_orderkey < 0"), path)
        second = "written"
    except writers.RefusedWrite:
        second = "refused"
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("second", F.lit(second))


@query("snk11_artifacts", f"select o_orderkey, {COMMENT} as csv, {COMMENT} as json from orders")
def snk11(spark, d):
    """An artifact as CSV and as JSON lines, both read back."""
    path = work_folder(spark, "artifact")
    o = noted(spark, d).select("o_orderkey", "o_comment")
    writers.save_csv(o, f"{path}/csv")
    o.write.json(f"{path}/json")
    one = readers.typed(readers.read_csv(spark, f"{path}/csv", ["o_orderkey", "csv"]), {"o_orderkey": "long"})
    two = spark.read.schema("o_orderkey long, o_comment string").json(f"{path}/json")
    return one.join(two.withColumnRenamed("o_comment", "json"), "o_orderkey")


# Tables of pages


def order_pages(spark, d):
    """A page of each customer with a table of its orders: two header rows with spans, and a year's cell that spans its
    rows; cells and rows end where others begin, as pages in the wild have it."""
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_orderkey", "o_orderstatus", F.round("o_totalprice").cast("long").alias("v"))
    n = F.count(F.lit(1)).over(Window.partitionBy("o_custkey", "y"))
    first = F.row_number().over(Window.partitionBy("o_custkey", "y").orderBy("o_orderkey")) == 1
    line = F.concat(F.lit("<tr>"), F.when(first, F.concat(F.lit('<th rowspan="'), n.cast("string"), F.lit('">'), F.col("y").cast("string"))).otherwise(""), F.lit("<td>"), "o_orderkey", F.lit("</td><td><b>"), "o_orderstatus", F.lit("</b> &amp; more<td>"), "v", F.lit("\n"))
    rows = o.select("o_custkey", F.struct("y", "o_orderkey", line.alias("line")).alias("r")).groupBy("o_custkey").agg(F.sort_array(F.collect_list("r")).alias("r"))  # a customer's own
    head = '<h1>Orders</h1><table class=x><thead><tr><th rowspan=2>Year<th rowspan=2>Order<th colspan=2>Amount</tr><tr><th>Status<th>Total</thead><tbody>'
    return rows.select("o_custkey", F.concat(F.lit(head), F.array_join(F.transform("r", lambda x: x["line"]), ""), F.lit("</table><p>end")).alias("html"))


@query(
    "src09_tables",
    """with o as (select o_custkey, o_orderkey, o_orderstatus, year(o_orderdate)::varchar as y, round(o_totalprice)::bigint as v, (row_number() over (partition by o_custkey order by year(o_orderdate), o_orderkey) + 1)::int as row from orders)
      select o_custkey, row, 0 as "column", true as is_header, 'Year' as header, null as row_header, y as value from o union all select o_custkey, row, 1, false, 'Order', y, o_orderkey::varchar from o
      union all select o_custkey, row, 2, false, 'Amount Status', y, o_orderstatus || ' & more' from o union all select o_custkey, row, 3, false, 'Amount Total', y, v::varchar from o""",
)
def src09_tables(spark, d):
    return html_tables.html_tables(order_pages(spark, d), "o_custkey", "html").where("row >= 2").drop("table")


@query(
    "src09_settings",
    """select c_custkey, 'Account balance' as label, 'BAL' as code, round(c_acctbal)::bigint::varchar as value, round(c_acctbal)::double as number, [c_mktsegment] as others from customer
      union all select c_custkey, 'Segment', null, c_mktsegment, null, [] from customer""",
)
def src09_settings(spark, d):
    """A page of settings for each customer: rows of a label, a value and notes."""
    balance = F.round("c_acctbal").cast("long").cast("string")
    html = F.concat(F.lit("<table><tr><th>Setting<th>Value<tr><td>Account balance (BAL)<td>"), balance, F.lit("<td>"), "c_mktsegment", F.lit("<tr><td>Segment</td><td> "), "c_mktsegment", F.lit(" </td></tr><tr><td>alone</table>"))
    cells = html_tables.html_tables(table(spark, d, "customer").select("c_custkey", html.alias("html")), "c_custkey", "html")
    return html_tables.settings(cells, "c_custkey").drop("table", "row")
