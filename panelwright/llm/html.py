"""HTML extraction: a tree builder with implied tags, visibility rules, and a renderer that keeps the spacing of
blocks, list markers and aligned table cells."""

from __future__ import annotations

import html as entities
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_bytes

#: Fixed values of the HTML standard: elements by how they open, close and show.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style head title template noscript iframe noembed noframes object canvas audio video datalist map".split())
#: Of drawings and formulas what is a definition or a note, not text; and elements that stand apart from what is beside them.
HIDDEN_IN = {
    "svg": frozenset("defs symbol clippath mask pattern marker filter lineargradient radialgradient metadata desc".split()),
    "math": frozenset(("annotation", "annotation-xml")),
}
APART = frozenset("button textarea select text".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "legend li main menu nav ol optgroup option p pre search section summary table ul caption tbody thead tfoot tr td th".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr menu dir".split())
#: A start tag of the key closes an open element of the value, unless one of SCOPE stands between.
IMPLIED_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"), "rt": ("rt", "rp"), "rp": ("rt", "rp"),
    "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr", "caption", "colgroup"), "tbody": ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"),
    "thead": ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), "tfoot": ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"),
    "body": ("head",), "a": ("a",), "button": ("button",),
}
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SCOPE = {
    "li": frozenset(("ul", "ol", "menu", "dir", "table", "td", "th")), "p": frozenset(("button", "td", "th", "table", "caption", "object")),
    **dict.fromkeys(("dt", "dd"), frozenset(("dl", "table", "td", "th"))),
    **dict.fromkeys(("td", "th", "tr", "tbody", "thead", "tfoot"), frozenset(("table",))),
}
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: What a declaration block says of display and visibility, a selector of a tag, classes and ids, and what style
#: sheets hold beside rules.
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
SIMPLE = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+)*)", re.I)
NO_RULE = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
#: Media that a page is shown on.
SHOWN_ON = frozenset(("", "all", "screen", "only screen", "only all"))

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "shown", "visible", "lines")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []
        self.shown, self.visible, self.lines = True, True, []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text) if text.strip(" \t\n\r\f/") else ():
        found.setdefault(name.lower(), entities.unescape(a or b or c))
    return found


#: Elements nested deeper are put beside their parent, as browsers do.
MOST_OPEN = 512


class _Builder:
    def __init__(self):
        self.root = Node("html")
        self.open = [self.root]

    def text(self, text: str) -> None:
        if text:
            if text.strip() and any(n.tag == "head" for n in self.open):
                self._close_until("head")
            self.open[-1].children.append(text)

    def _close_until(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def _implied(self, tags: tuple[str, ...], scope: frozenset) -> None:
        """Closes the outermost open element of the tags that none of the scope hides."""
        cut = None
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in scope:
                break
            if self.open[k].tag in tags:
                cut = k
        if cut is not None:
            del self.open[cut:]

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> Node | None:
        if tag == "html":
            self.root.attrs = {**attrs, **self.root.attrs}
            return None
        if tag in CLOSES_P:
            self._implied(("p",), SCOPE["p"])
        if tag in IMPLIED_ENDS:
            self._implied(IMPLIED_ENDS[tag], SCOPE.get(tag, frozenset(("table",)) if tag != "body" else frozenset()))
        if tag in ("td", "th") and self._nearest("table", "tr") == "table":
            self.start("tr", {}, False)
        if tag in ("tr", "td", "th", "tbody", "thead", "tfoot") and self._nearest("table") is None:
            return None  # table parts outside a table leave their contents only
        if tag == "tr" and self._nearest("table", "tbody", "thead", "tfoot") == "table":
            self.start("tbody", {}, False)
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID and not (closed and (tag in ("svg", "math") or self._nearest("svg", "math"))):
            if len(self.open) >= MOST_OPEN:
                self.open.pop()
            self.open.append(node)
        return node

    def _nearest(self, *tags: str) -> str | None:
        return next((n.tag for n in reversed(self.open) if n.tag in tags), None)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {}, True)
        elif tag == "p" and self._nearest("p") is None:
            self.open[-1].children.append(Node("p"))
        elif tag not in ("html", "body"):
            hidden_by = frozenset(("td", "th", "table")) - {tag} if tag in FORMATTING or tag in ("p", "div", "span") else SCOPE.get(tag, frozenset()) - {tag}
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == tag:
                    again = [n for n in self.open[k + 1 :] if n.tag in FORMATTING] if tag in FORMATTING else []
                    del self.open[k:]
                    for n in again:  # misnested formatting goes on behind the end tag
                        self.start(n.tag, n.attrs, False)
                    return
                if self.open[k].tag in hidden_by:
                    return


def parse(source: str) -> Node:
    """The tree of a page: start tags that close others, parts of tables that are left out, raw text, and text
    that ends the head are all supplied; end tags without a start are passed over."""
    build, at = _Builder(), 0
    while at < len(source):
        token = TOKEN.search(source, at)
        if token is None:
            build.text(entities.unescape(source[at:]))
            break
        if token.start() > at:
            build.text(entities.unescape(source[at : token.start()]))
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            build.end(tag)
            continue
        node = build.start(tag, _attributes(token[3]), token[3].endswith("/"))
        if node is not None and tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            end = stop.start() if stop else len(source)
            raw = source[at:end]
            if tag in ("title", "textarea"):
                raw = entities.unescape(raw)
            node.children.append(raw)
            build.open.pop()
            close = source.find(">", end) if stop else -1
            at = close + 1 if close >= 0 else len(source)
    return build.root


def _declared(block: str) -> dict[str, tuple[str, bool]]:
    return {name.lower(): (value.lower(), bool(important)) for name, value, important in DECLARED.findall(block)}


def _rules(sheet: str):
    """(selectors, declarations) of the rules of a style sheet that hold on a screen, in one pass over its braces. Rules
    within @media of a screen or of all, @layer and @supports hold, those of other @ blocks don't; what is never closed
    ends with the sheet."""
    sheet, start = NO_RULE.sub(" ", sheet), 0
    open_: list[list] = []  # [selectors or None for an @ block, whether it holds, where its declarations begin, where they end]
    for brace in re.finditer(r"[{};]", sheet):
        at, holds = brace.start(), open_[-1][1] if open_ else True
        if brace[0] == "{":
            head = sheet[start:at].strip()
            if head.startswith("@"):
                name, _, rest = head[1:].partition(" ")
                fits = any(" ".join(m.lower().split()) in SHOWN_ON for m in rest.split(",")) if name.lower() == "media" else name.lower() in ("layer", "supports")
                open_.append([None, holds and fits, 0, 0])
            else:
                if open_ and open_[-1][0] is not None and open_[-1][3] < 0:
                    open_[-1][3] = start  # a rule within a rule ends the outer one's declarations
                inner = open_ and open_[-1][0] is not None
                open_.append([head, holds and not inner, at + 1, -1])
            start = at + 1
        elif brace[0] == "}":
            if open_:
                head, holds, begin, end = open_.pop()
                if head is not None and holds:
                    yield head, sheet[begin : at if end < 0 else end]
            start = at + 1
        else:
            start = at + 1
    for head, holds, begin, end in open_:
        if head is not None and holds:
            yield head, sheet[begin : len(sheet) if end < 0 else end]


def _selector(text: str) -> list[tuple] | None:
    """The parts of a selector from its last on: (tag, ids, classes, whether the next part is of the parent); None if it
    has anything but tags, classes, ids, descendants and children."""
    parts, child = [], False
    for word in re.findall(r">|[^\s>]+", text):
        if word == ">":
            if child or not parts:
                return None
            child = True
            continue
        fit = SIMPLE.fullmatch(word)
        if not fit:
            return None
        names = re.findall(r"([.#])([\w-]+)", fit[2])
        ids, classes = (frozenset(n for kind, n in names if kind == k) for k in "#.")
        if parts:
            parts[-1] = (*parts[-1][:3], child)
        parts.append(((fit[1] or "*").lower(), ids, classes, False))
        child = False
    if not parts or child:
        return None
    # a part's flag is of its link to the one before it, as they are read from the last on
    links = [False, *(p[3] for p in parts[:-1])]
    return [(*p[:3], link) for p, link in zip(reversed(parts), reversed(links))]


def _is(part: tuple, node: Node) -> bool:
    tag, ids, classes, _ = part
    return tag in ("*", node.tag) and (not ids or ids <= {node.attrs.get("id")}) and (not classes or classes <= set(node.attrs.get("class", "").split()))


def _fits(parts: list[tuple], path: tuple) -> bool:
    """Whether the node at the end of path, (node, path of its parent), fits a selector; each part is tried at each
    ancestor once."""
    reach = [path] if _is(parts[0], path[0]) else []
    for before, part in zip(parts, parts[1:]):
        found, seen = [], set()
        for at in reach:
            at = at[1]
            while at is not None and id(at) not in seen:
                seen.add(id(at))
                if _is(part, at[0]):
                    found.append(at)
                if before[3]:
                    break
                at = at[1]
        reach = found
    return bool(reach)


class _Styles:
    """The rules of a page's style elements that set display or visibility, by selectors of tags, classes and ids, of
    descendants and of children. Selectors with attributes, states or siblings are passed over."""

    def __init__(self, sheets: list[str]):
        self.rules: dict[tuple, list[tuple]] = {}  # by an id, a class or the tag of what they are of
        n = 0
        for sheet in sheets:
            for selectors, block in _rules(sheet):
                declared = _declared(block)
                for selector in selectors.split(",") if declared else ():
                    parts, n = _selector(selector), n + 1
                    if parts:
                        weight = (sum(len(p[1]) for p in parts), sum(len(p[2]) for p in parts), sum(p[0] != "*" for p in parts), n)
                        tag, ids, classes, _ = parts[0]
                        key = ("#", min(ids)) if ids else (".", min(classes)) if classes else ("", tag)
                        self.rules.setdefault(key, []).append((parts, weight, declared))

    def of(self, path: tuple) -> dict[str, str]:
        """What holds for the node at the end of path: the rule with the most ids, classes, tags that comes last; then its
        own style."""
        node, best = path[0], {}
        keys = [("#", node.attrs["id"])] if "id" in node.attrs else []
        keys += [(".", c) for c in set(node.attrs.get("class", "").split())] + [("", node.tag), ("", "*")]
        for parts, weight, declared in (r for k in keys for r in self.rules.get(k, ())) if self.rules else ():
            if _fits(parts, path):
                for name, (value, important) in declared.items():
                    best[name] = max(best.get(name, ()), (important, 0, weight, value))
        for name, (value, important) in _declared(node.attrs["style"]).items() if "style" in node.attrs else ():
            best[name] = max(best.get(name, ()), (important, 1, (), value))
        return {name: x[-1] for name, x in best.items()}


def _nodes(root: Node):
    work = [root]
    while work:
        node = work.pop()
        yield node
        work.extend(c for c in reversed(node.children) if isinstance(c, Node))


def _settle_styles(root: Node) -> None:
    """shown is false for a node that is not displayed, visible for one whose text is not seen; visibility is
    inherited, and a child may set it anew."""
    styles = _Styles(["".join(c for c in n.children if isinstance(c, str)) for n in _nodes(root) if n.tag == "style"])
    work = [((root, None), True, frozenset())]
    while work:
        path, visible, hidden = work.pop()
        node = path[0]
        attrs, own = node.attrs, styles.of(path) if styles.rules or "style" in node.attrs else {}
        node.shown = not (
            node.tag in HIDDEN
            or node.tag in hidden
            or "hidden" in attrs
            or attrs.get("aria-hidden", "").lower() == "true"
            or (node.tag == "input" and attrs.get("type", "").lower() == "hidden")
            or (node.tag == "dialog" and "open" not in attrs)
            or own.get("display") == "none"
        )
        node.visible = own["visibility"] not in ("hidden", "collapse") if own.get("visibility", "inherit") not in ("inherit", "unset") else visible
        if node.shown:
            hidden = HIDDEN_IN.get(node.tag, hidden)
            work.extend(((c, path), node.visible, hidden) for c in node.children if isinstance(c, Node))


def _width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text) if not text.isascii() else len(text)


class _Lines:
    """Lines under construction: a run of inline text, and how many blank lines the next line wants before it."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = 0
        self.indent = ""
        self.marker = ""

    def inline(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self.now.append(first)
            for line in rest:
                self.break_(keep=True)
                self.now.append(line)
            return
        text = SPACE.sub(" ", text)
        if text.startswith(" ") and (not self.now or self.now[-1].endswith(" ")):
            text = text[1:]
        if text:
            self.now.append(text)

    def break_(self, keep: bool = False) -> None:
        text = "".join(self.now)
        text = text.rstrip(" ") if not keep else text
        if text or (keep and self.lines):
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = 0
            if self.marker:
                lead = self.indent[: -len(self.marker)] + self.marker if len(self.indent) >= len(self.marker) else self.marker
                self.marker = ""
            else:
                lead = self.indent
            self.lines.append((lead + text).rstrip())
        self.now = []

    def block(self, spaced: bool) -> None:
        self.break_()
        self.blank |= int(spaced)


def _render(node: Node, out: _Lines, pre: bool) -> None:
    """Adds a node's visible text; iterative over the tree, so that deep nesting is no matter."""
    work: list[tuple] = [(0, c, pre, node.visible) for c in reversed(node.children)]
    numbers: list[list] = []
    while work:
        what, item, own_pre, visible = work.pop()
        if what == 1:
            item()
            continue
        if isinstance(item, str):
            if visible:
                out.inline(item, own_pre)
            continue
        tag = item.tag
        if not item.shown:
            continue
        if tag == "br":
            out.break_(keep=True)
            continue
        if tag == "img":
            out.inline(item.attrs.get("alt", "") if item.visible else "", False)
            continue
        if tag == "hr":
            out.block(True)
            continue
        if tag == "table":
            out.block(True)
            for line in item.lines:
                out.now.append(line)
                out.break_()
            out.block(True)
            continue
        inner_pre = own_pre or tag in ("pre", "textarea", "xmp")
        if tag not in BLOCKS:
            if tag == "input" and item.visible and item.attrs.get("type", "text").lower() in ("submit", "button", "reset"):
                out.inline(f" {item.attrs.get('value', '')} ", False)
            if tag in APART:
                out.inline(" ", False)
                work.append((1, lambda: out.inline(" ", False), False, True))
            work.extend((0, c, inner_pre, item.visible) for c in reversed(item.children))
            continue
        spaced = tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and numbers)
        out.block(spaced)
        indent = out.indent
        if tag in ("ul", "ol", "menu", "dir"):
            start = item.attrs.get("start", "1")
            numbers.append([int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1] if tag == "ol" else [None])
        elif tag == "li":
            count = numbers[-1] if numbers else [None]
            value = item.attrs.get("value", "")
            if count[0] is not None and re.fullmatch(r"-?\d{1,9}", value):
                count[0] = int(value)
            out.marker = "- " if count[0] is None else f"{count[0]}. "
            out.indent = indent + " " * len(out.marker)
            if count[0] is not None:
                count[0] += 1
        elif tag in ("blockquote", "dd"):
            out.indent = indent + "  "
        elif tag in ("option", "optgroup") and item.visible:
            out.inline(item.attrs.get("label", ""), False)
            out.break_()

        def close(tag=tag, spaced=spaced, indent=indent):
            out.block(spaced)
            out.indent = indent
            if tag == "li":
                out.marker = ""
            elif tag in ("ul", "ol", "menu", "dir"):
                numbers.pop()

        work.append((1, close, False, False))
        work.extend((0, c, inner_pre, item.visible) for c in reversed(item.children))
    out.break_()


def _table(table: Node) -> list[str]:
    """A table's lines: caption, then rows with cells filled up to their column's width; cells of several lines
    stand side by side; a cell that spans columns is followed by empty ones. What stands between the cells comes
    before the rows. Tables in it have their lines already."""
    rows: list[list[list[str]]] = []
    lines: list[str] = []
    spans: dict[int, int] = {}

    def cell_lines(node: Node) -> list[str]:
        inner, around = _Lines(), node
        if node.tag not in ("td", "th"):
            around = Node("div")
            around.children.append(node)
        _render(around, inner, False)
        return inner.lines

    def walk(node: Node) -> None:
        for child in node.children:
            if isinstance(child, str):
                if child.strip() and node.visible:
                    lines.append(SPACE.sub(" ", child).strip())
            elif not child.shown:
                continue
            elif child.tag in ("thead", "tbody", "tfoot"):
                walk(child)
            elif child.tag == "tr":
                row: list[list[str]] = []

                def held() -> None:
                    while spans.get(len(row), 0) > 0:
                        spans[len(row)] -= 1
                        row.append([])

                for cell in child.children:
                    if isinstance(cell, str):
                        if cell.strip() and child.visible:
                            lines.append(SPACE.sub(" ", cell).strip())
                    elif cell.tag in ("td", "th"):
                        held()
                        wide, tall = (int(v) if re.fullmatch(r"[1-9]\d{0,2}", v := cell.attrs.get(k, "1")) else 1 for k in ("colspan", "rowspan"))
                        for extra in range(wide):
                            if tall > 1:
                                spans[len(row)] = tall - 1
                            row.append(cell_lines(cell) if not extra and cell.shown else [])
                    elif cell.shown:
                        lines.extend(cell_lines(cell))
                held()
                rows.append(row)
            elif child.tag != "colgroup":
                lines.extend(cell_lines(child))

    walk(table)
    columns = max(map(len, rows), default=0)
    if columns <= 1:
        return lines + [line for row in rows for cell in row for line in cell if line]
    widths = [max((_width(line) for row in rows if c < len(row) for line in row[c]), default=0) for c in range(columns)]
    for row in rows:
        for k in range(max((len(cell) for cell in row), default=0)):
            cells = [cell[k] if k < len(cell) else "" for cell in row]
            line = "  ".join(text + " " * (widths[c] - _width(text)) for c, text in enumerate(cells) if widths[c]).rstrip()
            if line:
                lines.append(line)
    return lines


def render(source: str) -> str:
    """All visible text of a page, in lines. Tables are laid out from the innermost to the outermost, so that
    their depth is no matter."""
    root, out = parse(source), _Lines()
    _settle_styles(root)
    for table in reversed([n for n in _nodes(root) if n.tag == "table"]):
        table.lines = _table(table) if table.shown else []
    _render(root, out, False)
    return "\n".join(out.lines).strip("\n")


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, text, n_lines, n_words) of each page: its visible text with blocks on lines of their own, a
    blank line around paragraphs, headings, lists and tables, list markers, and table cells in columns. What
    tags, attributes, inline styles or style elements (by tags, classes, ids, descendants and children) hide is left out.

    Null and empty html has an empty text, of no lines; html of any length is read whole, and of any brokenness
    without an error; null page_ids and repeated rows are rendered each; extra columns are ignored; an empty
    table gives no rows.
    """

    def run(batches):
        for batch in batches:
            texts = [render(x.decode("utf-8", "replace")) for x in batch.column(1).to_pylist()]
            counts = [pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()), pa.array([len(t.split()) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *counts], names=["page_id", "text", "n_lines", "n_words"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), text_bytes(html).alias("html"))
    return source.mapInArrow(run, "page_id long, text string, n_lines long, n_words long")
