"""URL filters: rules and hosts against plain Python, the spread against dense matrices."""

import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from panelwright.llm.queries import QUERIES
from panelwright.llm.urls import RULES, filter_urls, host_and_path, host_edges, rule_table, spread
from pyspark.sql import functions as F


def plain(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "http://a.example.com/en/", "http://example.com/EN/", "http://x.net/es/y", "http://net/fr/", "http://x.net?/es/", "http://com", "http://notcom/", "http://a..com/", "ftp://ü.com/é", "x://a://b.com/", "http://example.com/en"]


def test_hosts_and_paths(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string").select("url", *(c.alias(n) for c, n in zip(host_and_path(F.col("url")), "hp")))
    assert all((r.h, r.p) == plain(r.url) for r in df.collect())


class Links(HTMLParser):
    """Hosts that a page's anchors name, read by another parser."""

    def __init__(self, html):
        super().__init__()
        self.base, self.links = None, []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        href = (dict(attrs).get("href") or "").strip()
        host = plain("x:" + href if href.startswith("//") else href)[0] if re.match(r"([A-Za-z][\w+.-]*:)?//", href) else None
        if tag == "base":
            self.base = host
        elif tag in ("a", "area") and href:
            self.links.append(host)

    def hosts(self):
        return [h or self.base for h in self.links if h or self.base]


def dense_verdicts(pages, block_at=0.5, damping=0.7):
    """page -> verdict, from matrices over all hosts and domains."""
    judged = [(p, *plain(url)) for p, url, _ in pages]
    rule = [plain_rule(host, path)[1] for _, host, path in judged]
    count, allow, block = Counter(h for _, h, _ in judged), Counter(), Counter()
    for (_, h, _), v in zip(judged, rule):
        allow[h] += v == "allow"
        block[h] += v == "block"
    links = Counter()
    for (_, h, _), (_, _, html) in zip(judged, pages):
        links.update((h, to) for to in Links(html or "").hosts() if h and to and to != h)
    for h, n in count.items():
        labels = h.split(".")
        if h and len(labels) > 2:
            above = ".".join(labels[-2:])
            links[h, above] += n
            links[above, h] += n
    names = sorted({h for h in count if h} | {x for e in links for x in e})
    at = {h: i for i, h in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for (a, b), n in links.items():
        w[at[a], at[b]] = n
    out, into = w / np.maximum(w.sum(1, keepdims=True), 1e-300), w / np.maximum(w.sum(0, keepdims=True), 1e-300)
    seed = lambda votes: np.array([votes[h] / count[h] if count.get(h) else 0.0 for h in names])
    t0, d0 = (s / (s.sum() or 1.0) for s in (seed(allow), seed(block)))
    t = 0.3 * np.linalg.solve(np.eye(len(names)) - damping * out.T, t0) * (hosts := len([h for h in count if h]))
    d = 0.3 * np.linalg.solve(np.eye(len(names)) - damping * into, d0) * hosts
    by_host = {h: ("block" if d[i] >= block_at and d[i] > t[i] else "allow", t[i], d[i]) for h, i in at.items()}
    return {p: (v or by_host.get(h, ("allow",))[0], v, *by_host.get(h, ("", 0.0, 0.0))[1:]) for (p, h, _), v in zip(judged, rule)}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_dense_matrices(spark, folder):
    sf = f"/root/testdata/{folder}"
    table = spark.read.parquet(f"{sf}/pages.parquet")
    pages = [(r.page_id, r.url, r.html) for r in table.collect()]
    want, rows, urls = dense_verdicts(pages), QUERIES["op2_urls"](spark, sf).collect(), {p: u for p, u, _ in pages}
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.host, r.path) == plain(urls[r.page_id]) and r.rule == plain_rule(r.host, r.path)[0]
        verdict, by_rule, trust, distrust = want[r.page_id]
        assert r.verdict == verdict and abs(r.trust - trust) < 1e-4 and abs(r.distrust - distrust) < 1e-4
    alone = [v for v, by_rule, *_ in want.values() if by_rule is None]
    print(folder, len(alone), "pages without a rule, of which the graph blocks", alone.count("block"))
    assert alone.count("block") > 0 and alone.count("allow") > 0


def test_links_are_those_of_visible_anchors(spark):
    html = """<!-- <a href="http://no.org/">x</a> --><script>"<a href='http://no.org/'>"</script><A class=x HREF = 'http&#58;&#x2F;/ent.org/a?b=c&amp;d'>x</A>
        <a href="//other.org:80/x">y</a><a href="/local?u=http://no.org/">z</a><a href=mailto:a@no.org>m</a><area href="https://Map.org"><a name=x>n</a>"""
    rows = [(1, "http://a.b.net/", html), (2, "http://b.net/", "<base href='http://based.org/dir/'><a href=page>p</a><a href='http://b.net/x'>q</a>"), (3, "http://x.b.co.uk/", None), (4, "http://10.0.0.1/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    hosts = spark.createDataFrame([("a.b.net", 1), ("b.net", 1), ("x.b.co.uk", 3), ("10.0.0.1", 1)], "host string, pages long")
    got = {(r.source, r.target): r.weight for r in host_edges(pages, hosts).collect()}
    assert got == {
        ("a.b.net", "ent.org"): 1, ("a.b.net", "other.org:80"): 1, ("a.b.net", "map.org"): 1, ("b.net", "based.org"): 1,
        ("a.b.net", "b.net"): 1, ("b.net", "a.b.net"): 1, ("x.b.co.uk", "b.co.uk"): 3, ("b.co.uk", "x.b.co.uk"): 3,
    }


def test_links_of_odd_tags_and_of_what_never_ends(spark):
    pages = {
        "http://a.net/": """<a title="x > y <b" href="http://one.org/">x</a><a data='href=http://no.org/' href='http://two.org/'>y</a><a href=http://three.org/x'y>z</a><a title=it's href=//four.org>w</a>""",
        "http://b.net/": "<a href='http://one.org/'>x</a><script> if (a < b) '<a href=http://no.org/>'",
        "http://c.net/": "<!-- <a href='http://no.org/'>x</a>",
        "http://d.net/": "<base target=x><base href='http://base.org/'><a href=page>p</a><a href='http://no.org/' ",
        "http://e.net/": "<script></script foo><a href=http://one.org>x</a><textarea><a href=http://no.org>x</textarea><a href='http://no.org/'<b><a\nhref\n=\n'http://two.org'>",
    }
    rows = [(i, u, h) for i, (u, h) in enumerate(pages.items())]
    got = host_edges(spark.createDataFrame(rows, "page_id long, url string, html string"), spark.createDataFrame([], "host string, pages long")).collect()
    assert {(r.source[0], r.target) for r in got} == {("a", "one.org"), ("a", "two.org"), ("a", "three.org"), ("a", "four.org"), ("b", "one.org"), ("d", "base.org"), ("e", "one.org"), ("e", "two.org")}


@pytest.mark.parametrize("unit", ["<script>", "<a ", "<a x='", '<a x="y" ', "<!--", "<base ", "<a href=", "</script ", "<a href='http://x.org/'>"])
def test_pages_of_ten_megabytes_take_linear_time(spark, unit):
    pages = spark.createDataFrame([("http://a.net/", 10_000_000 // len(unit))], "url string, n int").select("url", F.repeat(F.lit(unit), F.col("n")).alias("html"))
    start = time.perf_counter()
    got = host_edges(pages, spark.createDataFrame([], "host string, pages long")).collect()
    assert time.perf_counter() - start < 60 and {r.target for r in got} == ({"x.org"} if "x.org" in unit else set())


def test_spread_equals_a_dense_walk(spark):
    rng = np.random.default_rng(1)
    n, w = 20, rng.integers(0, 3, (20, 20)).astype(float)
    np.fill_diagonal(w, 0)
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "source string, target string, weight double")
    seeds = spark.createDataFrame([("h0", 1.0, 0.0), ("h1", 0.0, 1.0)], "host string, trust double, distrust double")
    trust, distrust = np.eye(n)[0], np.eye(n)[1]
    out, into = w / np.maximum(w.sum(1, keepdims=True), 1), w / np.maximum(w.sum(0, keepdims=True), 1)
    t, d = trust, distrust
    for _ in range(6):
        t, d = 0.3 * trust + 0.7 * t @ out, 0.3 * distrust + 0.7 * into @ d
    got = {r.host: (r.trust, r.distrust) for r in spread(edges, seeds, rounds=6).collect()}
    assert all(np.allclose(got.get(f"h{i}", (0, 0)), (t[i], d[i])) for i in range(n))


def test_distrust_reaches_those_who_link_to_blocked_hosts(spark):
    rows = [(1, "http://bad.net/es/", ""), (2, "http://friend.org/", "<a href='http://bad.net/es/x'>x</a>" * 3), (3, "http://good.com/", "<a href=http://other.org/>o</a>"), (4, "http://other.org/", None), (5, "http://one.org/", ""), (6, "http://two.org/", "")]  # a host's distrust is in units of the mean of all hosts
    got = {r.page_id: r.verdict for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rule_table(spark)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, host string, trust double, verdict string"
    rows = [(i, u, None, "x", 1.0, "y") for i, u in enumerate(URLS)] + [(None, None, None, None, None, None), (1, "", "<a href=", "x", 1.0, "y")]
    got = filter_urls(spark.createDataFrame(rows, schema), rule_table(spark)).collect()
    assert len(got) == len(rows) and all(r.verdict == "allow" for r in got if r.host == "")
    assert filter_urls(spark.createDataFrame([], schema), rule_table(spark)).collect() == []


def test_distrust_reaches_far_hosts_at_its_exact_size(spark):
    n, far = 2000, 15
    rows = [(0, "http://bad.net/es/", "")] + [(i, f"http://h{i}.org/", f"<a href=http://{f'h{i - 1}.org/' if i > 1 else 'bad.net/es/'}>x</a>" if i <= far else "") for i in range(1, n)]
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rule_table(spark)).collect()}
    for hop in range(1, far + 1):
        assert abs(got[hop].distrust - 0.3 * 0.7**hop * n) < 1e-4 and got[hop].verdict == "block"
    assert got[far + 1].verdict == "allow"
