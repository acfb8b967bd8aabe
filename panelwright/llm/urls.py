"""URL filters: rules by host and path, and for hosts that no rule judges, trust and distrust spread over the
links between hosts. DataFrame operations only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: A host with more than a thousandth of all pages is hot: there are fewer than a thousand of them.
HOT = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The attributes of tags by their names: quoted where a value is, and without < and > elsewhere, so that no tag that isn't
#: closed is looked for beyond the next. No repetition gives back what it took, so a page is read in its length.
TAG = r"""(?is)<(?:%s)\s((?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s<>]*+))*+)>"""
#: The value of the first href, behind whole attributes of other names.
HREF = r"""(?is)^(?:\s++|[/=]|(?!href\s*+=)[^\s=/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s<>]*+))?+)*+href\s*+=\s*+["']?\s*+([^"'\s>]+)"""
#: Comments and elements whose text is no markup; such as never end go to the end of the page.
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|xmp)\b.*?(?:</\1(?=[\s/>])|\z)"
#: Characters that a host's entities may stand for.
ENTITIES = ((r"(?i)&(?:amp|#38|#x26);?", "&"), (r"(?i)&(?:sol|#0*47|#x0*2f);?", "/"), (r"(?i)&(?:colon|#0*58|#x0*3a);?", ":"), (r"(?i)&(?:period|#0*46|#x0*2e);?", "."))
ABSOLUTE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"
#: Rounds of the spread between two written tables.
CHAINED = 8

#: The rules of the query: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the
    end. Both empty if the url is null or has no ://."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(h, p, v) for h, p, v in rules], "rule_host string, rule_path string, rule_verdict string")


def _parents(host: Column) -> Column:
    """The host and the domains above it, as an array; empty for an empty host."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )


def with_host(rows: DataFrame, by_host: DataFrame, total: int) -> DataFrame:
    """rows left-joined with by_host(host, pages, ...), a row a host, whose pages add up to total.

    Rows of hot hosts meet theirs by a broadcast of at most HOT rows, so that none of them is a task's load;
    the others by a shuffle.
    """
    hot = F.broadcast(by_host.where(F.col("pages") * HOT > total))
    many = rows.join(hot, "host")
    few = rows.join(hot.select("host"), "host", "left_anti").join(by_host, "host", "left")
    return many.unionByName(few).drop("pages")


def judged_by_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, rule_verdict): the longest rule (host and path) that fits each url, or nulls.

    A rule fits its host and all hosts below it if the path starts with the rule's. Rules meet the distinct
    hosts only; each host's fitting rules then meet its pages.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    own = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    counted = written(own.groupBy("host").agg(F.count("*").alias("pages")), "host-pages")
    above = counted.select("host", "pages", F.explode_outer(_parents(F.col("host"))).alias("rule_host"))
    rule = F.concat("rule_host", "rule_path")
    fitting = F.struct(F.length(rule).alias("size"), F.length("rule_host").alias("host_size"), rule.alias("rule"), "rule_verdict", "rule_path")
    fitting = F.when(F.col("rule_path").isNotNull(), fitting)
    by_host = written(above.join(rules, "rule_host", "left").groupBy("host", "pages").agg(F.collect_set(fitting).alias("fitting")), "host-rules")
    total = counted.agg(F.sum("pages")).first()[0] or 0
    best = F.array_max(F.filter("fitting", lambda r: F.startswith(F.col("path"), r["rule_path"])))
    found = with_host(own, by_host, total).withColumn("best", best)
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))


def domain(host: Column) -> Column:
    """The last two labels of a host, three where these are like co.uk; null for a single label or an address."""
    labels = F.split(host, r"\.")
    short = F.element_at(labels, -1).rlike("^[a-z]{2}$") & F.element_at(labels, -2).rlike("^(?:co|com|net|org|ac|gov|edu|or|ne|go)$")
    n = F.when(short, 3).otherwise(2)
    return F.when((F.size(labels) >= n) & ~host.rlike(r"^[0-9.:]*$") & ~F.array_contains(labels, ""), F.array_join(F.slice(labels, -n, n), "."))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(source, target, weight): links between different hosts, counted, from the anchors of html that are no
    comment's; and an edge each way between every one of hosts(host, pages) and its domain, which is a node
    whether it was crawled or not, by the host's pages. So hosts of one domain are two steps apart.

    Relative links stay on the host, or lead to that of the page's <base href>.
    """
    source, _ = host_and_path(F.col("url").cast("string"))
    seen = F.regexp_replace(F.coalesce(F.col("html").cast("string"), F.lit("")), UNSEEN, " ")
    plain = lambda c: reduce(lambda c, e: F.regexp_replace(c, e[0], e[1]), ENTITIES, c)
    target = lambda c: F.when(c.rlike(ABSOLUTE), host_and_path(F.regexp_replace(c, "^//", "x://"))[0])
    links = lambda tags: F.filter(F.transform(F.regexp_extract_all("seen", F.lit(TAG % tags), F.lit(1)), lambda tag: F.regexp_extract(tag, HREF, 1)), lambda link: link != "")
    read = pages.select(source.alias("source"), seen.alias("seen")).where(F.col("source") != "")
    # a column of its own, as what stands beside explode is worked out again for each of its rows
    read = read.select("source", target(plain(F.try_element_at(links("base"), F.lit(1)))).alias("base"), links("a|area").alias("links")).select("source", "base", F.explode("links").alias("link"))
    counted = read.select("source", F.coalesce(target(plain(F.col("link"))), "base").alias("target")).where("target <> '' and source <> target")
    counted = counted.groupBy("source", "target").agg(F.count("*").cast("double").alias("weight"))
    family = hosts.select(F.col("host").alias("source"), domain(F.col("host")).alias("target"), F.col("pages").cast("double").alias("weight")).where("source <> target")
    back = family.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight")
    return counted.unionByName(family).unionByName(back).groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.7, error: float = 1e-9, rounds: int | None = None) -> DataFrame:
    """(host, trust, distrust): personalised PageRank of seeds(host, trust, distrust) over edges.

    Trust follows edges in shares of a source's weight, distrust goes back along them in shares of a target's.
    A round leaves 1 - damping at the seeds. What is missing after r rounds is at most 2 * damping ** r of the
    seeds' sum, so there are as many rounds as bring it under `error`, whatever the graph, unless `rounds` are
    given. Each round is a join with the graph, which is dealt out by its sources once and kept by the executors (a
    lost one's part is read again), and a sum, combined before its shuffle, the round's only one; the state, a row for
    each host reached, is written to the shared folder every CHAINED rounds.
    """
    edges = written(edges, "host-edges")  # read four times, and made of whole pages
    out = edges.groupBy("source").agg(F.sum("weight").alias("all_out"))
    into = edges.groupBy("target").agg(F.sum("weight").alias("all_in"))
    forward = edges.join(out, "source").select(F.col("source").alias("host"), F.col("target").alias("to"), (F.col("weight") / F.col("all_out")).alias("forward"), F.lit(0.0).alias("back"))
    backward = edges.join(into, "target").select(F.col("target").alias("host"), F.col("source").alias("to"), F.lit(0.0).alias("forward"), (F.col("weight") / F.col("all_in")).alias("back"))
    steps = forward.unionByName(backward).groupBy("host", "to").agg(F.sum("forward").alias("forward"), F.sum("back").alias("back"))
    seeds = written(seeds, "seeds")
    # the graph stays where its sources are, so that a round moves nothing but what hosts get
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = written(steps, "host-steps").repartition(parts, "host").persist(StorageLevel.MEMORY_AND_DISK)
    mass = seeds.agg(F.sum("trust") + F.sum("distrust")).first()[0] or 0.0
    if rounds is None:
        rounds = math.ceil(math.log(max(1.0, 2 * mass / error)) / -math.log(damping))
    stay = seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
    now = seeds
    for r in range(rounds):
        moved = steps.join(now.hint("shuffle_hash"), "host").select(F.col("to").alias("host"), (F.col("forward") * F.col("trust") * damping).alias("trust"), (F.col("back") * F.col("distrust") * damping).alias("distrust"))
        now = moved.unionByName(stay).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if (r + 1) % CHAINED == 0 or r + 1 == rounds:
            now = written(now, "trust")
    steps.unpersist()
    return now


def filter_urls(pages: DataFrame, rules: DataFrame, block_at: float = 0.5, damping: float = 0.7, **how) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of each row of pages(page_id, url, html).

    The longest fitting rule decides. Else the host does: a host is a seed of trust (distrust) by the share of
    its pages that rules allow (block), and both spread over the graph of host_edges; they are in units of the
    mean over all hosts, to within block_at / 10,000. A host is blocked if its distrust is at least block_at
    and above its trust. Null urls and such without a host have empty host and path and are allowed; null html
    has no links; repeated rows and null page_ids are judged each; extra columns are ignored; an empty table
    gives no rows.
    """
    judged = written(judged_by_rules(pages, rules), "judged")
    share = lambda verdict: F.avg((F.coalesce("rule_verdict", F.lit("")) == verdict).cast("double"))
    hosts = judged.groupBy("host").agg(F.count("*").alias("pages"), share("allow").alias("trust"), share("block").alias("distrust"))
    hosts = written(hosts, "hosts")
    total = hosts.agg(F.sum("pages")).first()[0] or 0
    named = hosts.where("host <> ''")
    n, trusted, blocked = named.agg(F.count("*"), F.sum("trust"), F.sum("distrust")).first()
    even = named.where("trust > 0 or distrust > 0").select("host", (F.col("trust") / (trusted or 1.0)).alias("trust"), (F.col("distrust") / (blocked or 1.0)).alias("distrust"))
    state = spread(host_edges(pages, named), even, damping, **{"error": 1e-4 * block_at / max(1, n), **how})
    scaled = state.select("host", (F.col("trust") * n).alias("trust"), (F.col("distrust") * n).alias("distrust"))
    by_host = written(hosts.select("host", "pages").join(scaled, "host", "left"), "host-trust")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_graph = F.when((distrust >= block_at) & (distrust > trust), "block").otherwise("allow")
    found = with_host(judged, by_host, total)
    return found.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_graph).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
