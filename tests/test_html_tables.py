"""Tables and settings of hand-written pages, broken and long ones."""

import time

import pytest

from panelwright.sources.html_tables import html_tables, settings, table_cells


def grid(html, table=0):
    """The values of a table, row by row, None where no cell is."""
    cells = [c for c in table_cells(html) if c[0] == table]
    rows = max((c[1] for c in cells), default=-1) + 1
    out = [[None] * (max((c[2] for c in cells if c[1] == r), default=-1) + 1) for r in range(rows)]
    for _, r, c, _, _, _, value in cells:
        out[r][c] = value
    return out


def test_spans_fill_their_places():
    html = "<table><tr><td rowspan=2>a<td colspan=2>b<tr><td>c<td rowspan='0'>d<tr><td>e<td>f<tbody><tr><td>g</table>"
    assert grid(html) == [["a", "b", "b"], ["a", "c", "d"], ["e", "f", "d"], ["g"]]
    assert grid("<table><tr><td rowspan=9>a<td>b<tr><td rowspan=2 colspan=2>c<tr><td>d</table>") == [["a", "b"], ["a", "c", "c"], ["a", "c", "c", "d"]]
    assert grid("<table><tr><td rowspan=2>a<td>b<td rowspan=2>c<tr><td colspan=3>d</table>") == [["a", "b", "c"], ["a", "d", "c", "d"]]


def test_headers_of_columns_and_rows():
    html = "<table><thead><tr><td>Team<th colspan=2>Points<tr><td>Team<th>for<th>against</thead><tr><th>Ä&amp;B<td>1<td>2<tr><td>C<td>3</table>"
    assert [c[1:] for c in table_cells(html) if c[1] > 1] == [
        (2, 0, True, "Team", None, "Ä&B"), (2, 1, False, "Points for", "Ä&B", "1"), (2, 2, False, "Points against", "Ä&B", "2"),
        (3, 0, False, "Team", None, "C"), (3, 1, False, "Points for", None, "3"),
    ]
    assert [(c[3], c[4]) for c in table_cells("<table><tr><td>1<tr><th>late<tr><td>2</table>")] == [(False, None), (True, None), (False, None)]


def test_nested_tables_scripts_comments_and_unclosed_tags():
    html = "x<table><tr><td>out<table><tr><td>in</table>er <script>var t='</td><td>';</script><!-- <td>no --><br>line<p>two</p><td a='>' b=\"<td>\">next<style>td{}</style></table>after<td>none"
    assert grid(html) == [["outer line two", "next"]] and grid(html, 1) == [["in"]]
    assert grid("<table><td>a&nbsp;&lt;b&gt; < c<tr><td>1 <2<TD>B</TABLE><table>") == [["a <b> < c"], ["1 <2", "B"]]
    assert grid("<table><tr><td>seen<script>never closed <td>no") == [["seen"]] and grid("<table><tr><td>seen<!-- never <td>no") == [["seen"]]
    assert list(table_cells("")) == [] and grid("<table></table>") == [] and grid("<table><tr><tr><td>a") == [[], ["a"]]


@pytest.mark.parametrize("unit", ["<a ", '<a x="', "<a '\"", "<!--", "<!x", "<table>", "<td>", "<script>", "</a ", "<", "<td colspan=2", "<table><tr><td>", "&am"])
def test_broken_pages_take_linear_time(unit):
    html = "<table><tr><td>first" + unit * (2_000_000 // len(unit))
    start = time.perf_counter()
    assert sum(1 for _ in table_cells(html)) >= 1
    assert time.perf_counter() - start < 30


def test_cells_and_settings_of_a_table_of_pages(spark):
    page = "<table><tr><th>Position<th>Starters<th>Max<tr><td>Quarterback (QB)<td>1<td>4<tr><td>Bench (BE)<td>7<td>N/A<tr><td>Waiver<td> 2 days </td><tr><td colspan=2>spanned<tr><td><td>x</table>"
    pages = spark.createDataFrame([(1, page, "c"), (2, None, "c"), (3, "", "c"), (None, page, "c"), (4, "<p>no table", "c")], "page_id long, html string, value string")
    cells = html_tables(pages, "page_id", "html")
    assert {r.page_id for r in cells.collect()} == {1, None} and cells.where("page_id = 1").count() == cells.where("page_id is null").count() == 15
    found = [tuple(r)[1:] for r in settings(cells.where("page_id = 1"), "page_id").orderBy("row").collect()]
    assert found == [(0, 1, "Quarterback", "QB", "1", 1.0, ["4"]), (0, 2, "Bench", "BE", "7", 7.0, ["N/A"]), (0, 3, "Waiver", None, "2 days", None, []), (0, 4, "spanned", None, "spanned", None, [])]
    assert html_tables(pages.limit(0), "page_id", "html").collect() == []
