"""Tables and settings out of HTML: cells with their spans resolved and the headers that they stand under."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag: its slash, name and attributes, which hold no < outside quotes, so that no tag is looked for beyond the next.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"']*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""")
SPAN = re.compile(r"""(?:^|[\s/"'])(colspan|rowspan)\s*+=\s*+["']?\s*+(\d{1,9})""", re.I)
END = {"script": re.compile("</script", re.I), "style": re.compile("</style", re.I)}
#: Spans are held to these, as browsers do.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class _Cell:
    def __init__(self, header: bool, columns: int, rows: int):
        self.header, self.columns, self.rows, self.parts = header, columns, rows, []

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class _Table:
    def __init__(self, number: int):
        self.number, self.rows, self.groups, self.cell, self.in_head, self.group = number, [], [], None, False, 0


class _Tables:
    """Finds the tables of a page in the order in which they begin; a table within a cell is one of its own, and its text
    isn't its outer cell's. Reads the page once, from tag to tag; what never ends goes to the end of the page."""

    BREAKS = frozenset("br p div li tr td th ul ol h1 h2 h3 h4 h5 h6".split())

    def __init__(self):
        self.done, self.open = [], []

    def feed(self, html: str) -> None:
        at = 0
        while at < len(html):
            here = html.find("<", at)
            self._text(html[at : here if here >= 0 else len(html)])
            if here < 0:
                return
            found = TAG.match(html, here)
            if found:
                at, tag = found.end(), found[2].lower()
                if found[1]:
                    self._end(tag)
                elif tag in END:
                    end = END[tag].search(html, at)
                    at = end.start() if end else len(html)
                else:
                    self._start(tag, found[3])
            elif html.startswith(("<!", "<?"), here):
                end = html.find("-->", here + 4) + 2 if html.startswith("<!--", here) else html.find(">", here)
                at = end + 1 if end > here else len(html)
            else:
                self._text("<")
                at = here + 1

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "table":
            self.open.append(_Table(len(self.done)))
            self.done.append(self.open[-1])
            return
        if not self.open:
            return
        table = self.open[-1]
        if tag in ("thead", "tbody", "tfoot"):
            table.cell, table.in_head, table.group = None, tag == "thead", table.group + 1
        elif tag == "tr":
            table.cell = None
            table.rows.append([])
            table.groups.append((table.group, table.in_head))
        elif tag in ("td", "th"):
            if not table.rows:
                table.rows.append([])
                table.groups.append((table.group, table.in_head))
            span = {k.lower(): int(v) for k, v in reversed(SPAN.findall(attributes))}
            table.cell = _Cell(tag == "th", min(span.get("colspan", 1) or 1, MOST_COLUMNS), min(span.get("rowspan", 1), MOST_ROWS))
            table.rows[-1].append(table.cell)
        elif tag in self.BREAKS and table.cell is not None:
            table.cell.parts.append(" ")

    def _end(self, tag: str) -> None:
        if not self.open:
            return
        table = self.open[-1]
        if tag == "table":
            self.open.pop()
        elif tag in ("td", "th", "tr", "thead", "tbody", "tfoot"):
            table.cell = None
            if tag == "thead":
                table.in_head, table.group = False, table.group + 1
        elif tag in self.BREAKS and table.cell is not None:
            table.cell.parts.append(" ")

    def _text(self, text: str) -> None:
        if text and self.open and self.open[-1].cell is not None:
            self.open[-1].cell.parts.append(unescape(text) if "&" in text else text)


def table_cells(html: str) -> Iterator[tuple[int, int, int, bool, str | None, str | None, str]]:
    """(table, row, column, is_header, column header, row header, value), from 0, of every place of each table.

    A cell that spans several rows or columns stands at each of its places; where two would, the first keeps it. A span
    ends with its group of rows (thead, tbody, tfoot), and a rowspan of 0 lasts to its end. A row is a header if it is in
    the thead or, above all other rows, all its cells are th; a column's header is what the header rows say of it, joined by
    a space, what a row repeats left out. A row's header is the text of the th cells that begin it.
    """
    parser = _Tables()
    parser.feed(html)
    for table in parser.done:
        grid, held = [], {}
        for k, row in enumerate(table.rows):
            if k and table.groups[k][0] != table.groups[k - 1][0]:
                held = {}
            places = {c: cell for c, (cell, left) in held.items()}
            held = {c: (cell, left - 1) for c, (cell, left) in held.items() if left > 1}
            at = 0
            for cell in row:
                while at in places:
                    at += 1
                rows = cell.rows or MOST_ROWS
                for c in range(at, min(at + cell.columns, MOST_COLUMNS)):
                    if c not in places:
                        places[c] = cell
                        if rows > 1:
                            held[c] = (cell, rows - 1)
                at += cell.columns
            grid.append(places)
        heads = 0
        while heads < len(grid) and grid[heads] and (table.groups[heads][1] or all(cell.header for cell in grid[heads].values())):
            heads += 1
        names: dict[int, list[str]] = {}
        for places in grid[:heads]:
            for c, cell in places.items():
                if cell.text and cell.text not in names.setdefault(c, []):
                    names[c].append(cell.text)
        for k, places in enumerate(grid):
            lead, c = [], 0
            while k >= heads and c in places and places[c].header:
                if places[c].text not in lead:
                    lead.append(places[c].text)
                c += 1
            for c, cell in sorted(places.items()):
                column = " ".join(names[c]) if k >= heads and names.get(c) else None
                yield table.number, k, c, k < heads or cell.header, column, " ".join(lead) if lead and not cell.header else None, cell.text


CELLS = "table int, row int, column int, is_header boolean, header string, row_header string, value string"


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, CELLS) of all tables of the pages, one pass and no shuffle. Null and empty html has no tables; whatever is
    broken is read as far as it goes; null keys and repeated rows are read each; other columns are left out."""
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string()]
    names = [key, *(c.split()[0] for c in CELLS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(keys, cells) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array(c, k) for c, k in zip(zip(*cells), kinds))], names=names)

        for batch in batches:
            kind, keys, cells = batch.schema.field(0).type, [], []
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for cell in table_cells(text or ""):
                    keys.append(one)
                    cells.append(cell)
                    if len(cells) >= 10_000:
                        yield made(keys, cells)
                        keys, cells = [], []
            if cells:
                yield made(keys, cells)

    source = pages.select(F.col(key).alias(key), F.col(html).cast("string").alias("__html"))
    return source.mapInArrow(run, f"`{key}` {dict(pages.dtypes)[key]}, {CELLS}")


def settings(cells: DataFrame, key: str) -> DataFrame:
    """(key, table, row, label, code, value, number, others) of rows of html_tables that state a setting: the first cell is
    its label, less a code in parentheses at its end, the second its value, and as a number if it is one; others are the
    cells after that. Header rows, rows of one cell and rows without a label are none."""
    rows = cells.groupBy(key, "table", "row").agg(F.sort_array(F.collect_list(F.struct("column", "value"))).alias("c"), F.bool_and("is_header").alias("head"))  # MOST_COLUMNS at most
    rows = rows.where(~F.col("head") & (F.size("c") >= 2) & (F.col("c")[0]["value"] != "")).withColumn("label", F.col("c")[0]["value"]).withColumn("value", F.col("c")[1]["value"])
    code = F.nullif(F.regexp_extract("label", r"\(([^()]+)\)\s*$", 1), F.lit(""))
    label = F.when(code.isNotNull(), F.trim(F.regexp_replace("label", r"\s*\([^()]+\)\s*$", ""))).otherwise(F.col("label"))
    number = F.when(F.col("value").rlike(r"^-?\d+(\.\d+)?$"), F.col("value").try_cast("double"))
    others = F.transform(F.slice("c", 3, MOST_COLUMNS), lambda x: x["value"])
    return rows.select(key, "table", "row", label.alias("label"), code.alias("code"), "value", number.alias("number"), others.alias("others"))
