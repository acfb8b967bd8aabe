"""HTML extraction: rendering cases by hand, and every visible word of generated pages."""

import re
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from panelwright.llm.html import extract_text, render
from panelwright.llm.queries import QUERIES

CASES = {
    "<p>one<p>two": "one\n\ntwo",
    "<div>a</div><div>b</div>c": "a\nb\nc",
    "a<br>b": "a\nb",
    "<ul><li>x<li>y</ul>": "- x\n- y",
    "<ol start=3><li>x</li><li>y</li></ol>": "3. x\n4. y",
    "<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>": "a    bb\nccc  d",
    "<table><tr><td colspan=2>wide<td>z</tr><tr><td>a<td>b<td>c</table>": "wide     z\na     b  c",
    "<head><title>t</title></head><body>seen<script>no()</script><style>p{}</style><!-- no --></body>": "seen",
    "<p style='display:none'>no</p><p hidden>no</p><p>yes</p>": "yes",
    "<pre>a\n  b</pre>": "a\n  b",
    "a &amp; b &lt;c&gt;": "a & b <c>",
    "<b>x<i>y</b>z</i>": "xyz",
    "plain < text": "plain < text",
    "": "",
    "<style>.no, p#gone {display:none} /* .yes{display:none} */ @media print{.yes{display:none}}</style><div class='a no'>no</div><p id=gone>no</p><p class=yes>yes</p>": "yes",
    "<style>.x{display:none}.x{display:block} b.y{visibility:hidden} .far .y, a>b, [x]{display:none}</style><p class=x>one</p><b class=y>no</b><i class=y>two</i>": "one\n\ntwo",
    "<style>.x{display:none}</style><p class=x style='display:block'>own style wins</p>": "own style wins",
    "<style>.x{display:none!important}</style><p class=x style='display:block'>no</p>yes": "yes",
    "<p style='visibility:hidden'>no <b style='visibility:visible'>yes</b> no</p>": "yes",
    "<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes</table>": "yes",
    "pick <select name=s><option>one<option selected>two<optgroup label=more><option>three</optgroup></select> end": "pick\none\ntwo\nmore\nthree\nend",
    "<table><tr><img alt='in a row'><td>a<td>b</tr><img alt='in a table'></table>": "in a row\nin a table\na  b",
    "<body>seen<title>no</title></body>": "seen",
    "<table><tr><td>a<td><table><tr><td>b<td>c<tr><td>dd<td>e</table><tr><td>f<td>g</table>": "a  b   c\n   dd  e\nf  g",
    "<input type=submit value=Go><textarea>ta</textarea><button>b</button>c<button>d</button>": "Go ta b c d",
    "a<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math><svg><desc/><path d='m'/><title>no</title><desc>no</desc><defs><text>no</text></defs><text>one</text><text>two<tspan>three</tspan></text></svg><desc>seen</desc>": "ax=2 one twothree seen",
    "<style>@media all{.a{display:none}} @media screen, print{.b{display:none}} @media print{.c{display:none}} @media (min-width:1px){.d{display:none}} @import 'x'; @layer x{@media screen{.e{display:none}}}</style><b class=a>no</b><b class=b>no</b><b class=c>c</b><b class=d>d</b><b class=e>no</b>": "cd",
    "<style>.m .x, ul>li.y, #n>b>i{display:none}</style><div class=m><p><b class=x>no</b>in</p></div><b class=x>out</b><ul><li class=y>no<li>z</ul><div class=y>y</div><p id=n><b><i>no</i>b</b><i>i</i>": "in\n\nout\n\n- z\n\ny\n\nbi",
    "<style>.a>.b .c{display:none} .q{display:none;.r{color:red} x</style><div class=a><div class=b><div><div class=b><i class=c>no</i></div></div></div></div><div class=b><i class=c>yes</i></div><i class=q>no</i>": "yes",
    "<style>p{display:none</style><p>no</p>yes": "yes",
    "<datalist><option>no</datalist><dialog>no</dialog><dialog open>yes</dialog>": "yes",
}


@pytest.mark.parametrize("source", CASES)
def test_cases(source):
    assert render(source) == CASES[source]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("p div span li td table tr b ul section h1".split()), st.booleans(), st.from_regex(r"[a-z]{1,8}", fullmatch=True)), max_size=30))
def test_no_visible_word_is_lost(parts):
    source = "".join(f"<{'/' if close else ''}{tag}> {word} " for tag, close, word in parts)
    assert sorted(w for w in render(source).split() if w != "-") == sorted(word for _, _, word in parts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-ab \"'=&;pdivtr\n", max_size=200))
def test_broken_pages_are_no_error(source):
    assert isinstance(render(source), str)


class Walk(HTMLParser):
    """The words that a page shows, by another parser: no tree, only what is open."""

    SKIP = {"script", "style", "head", "title", "template", "noscript", "iframe", "canvas", "object", "audio", "video"}

    def __init__(self, source):
        super().__init__()
        self.skipped, self.text = [], []
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "body" and self.skipped == ["head"]:
            self.skipped = []
        if self.skipped:
            if tag in (self.skipped[-1], "head"):
                self.skipped.append(tag)
        elif tag in self.SKIP or "hidden" in attrs or re.search(r"display\s*:\s*none", attrs.get("style") or ""):
            if tag not in ("img", "br", "hr", "input", "meta", "link"):
                self.skipped.append(tag)
        elif tag == "img":
            self.text.append(attrs.get("alt") or "")
        self.text.append(" " if tag not in ("b", "i", "em", "strong", "a", "span", "u", "s", "code", "small", "font") else "")

    def handle_endtag(self, tag):
        if self.skipped and tag == self.skipped[-1]:
            self.skipped.pop()
        self.text.append(" " if tag not in ("b", "i", "em", "strong", "a", "span", "u", "s", "code", "small", "font") else "")

    def handle_data(self, data):
        self.text.append("" if self.skipped else data)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_an_independent_walk(spark, folder):
    """The same visible words in the same order on every page of the table, list markers and the order of cells aside."""
    sf = f"/root/testdata/{folder}"
    got, seen, tables = {r.page_id: r for r in QUERIES["op1_html"](spark, sf).collect()}, 0, 0
    for page in spark.read.parquet(f"{sf}/pages.parquet").collect():
        html = page.html or ""
        want, text = "".join(Walk(html).text).split(), got[page.page_id].text
        ours = re.sub(r"(?m)^( *)(?:- |\d+\. )+", r"\1", text).split()
        if "<table" in html.lower():
            want, ours, tables = sorted(want), sorted(ours), tables + 1
        assert ours == want, page.page_id
        assert got[page.page_id].n_lines == len(text.split("\n") if text else []) and got[page.page_id].n_words == len(text.split())
        seen += len(want)
    print(folder, len(got), "pages,", tables, "with tables,", seen, "words")
    assert seen > 1000


@pytest.mark.parametrize("unit", ["@", "@media{", "a{", "{", "}", "/*", "a ", ".a>", "x,", "@media all{.a{display:none}", ".a .b{display:none} "])
def test_styles_of_a_megabyte_take_linear_time(unit):
    start = time.perf_counter()
    assert render("<style>" + unit * (1_000_000 // len(unit)) + "</style><p class=b>seen") == "seen"
    assert time.perf_counter() - start < 15


def test_selectors_of_deep_trees_take_linear_time():
    start = time.perf_counter()
    page = "<style>" + "".join(f".k{i} .m .m .m .x{{display:none}}" for i in range(50)) + "</style>" + "<div class=m>" * 400 + "<i class=x>y</i>" * 200
    assert render(page) == "y" * 200 and time.perf_counter() - start < 60


def test_deep_nesting_is_no_error():
    inner = "<table><tr><td>x<td>"
    assert render(inner * 40).split() == ["x"] * 40
    assert render("<div>" * 5000 + "x") == "x" and "x" in render("<table><tr><td>" * 300 + "x")


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "<p>x y</p>", None), (3, "<p>w</p>" * 20_000, "t")]
    got = {r.page_id: (r.n_lines, r.n_words) for r in extract_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()}
    assert got == {1: (0, 0), 2: (0, 0), None: (1, 2), 3: (39_999, 20_000)}
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).collect() == []
