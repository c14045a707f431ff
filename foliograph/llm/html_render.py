"""HTML extraction by layout-aware rendering.

A tree builder with implied tags reads any page; rendering walks the tree under
visibility rules and emits visible text: blocks on lines of their own with
spacing, lists with marks and indents, preformatted text as it is, tables with
aligned cells, formulas and the labels of drawings.  What a browser shows only
if it can't load something (the fallback of object, video and the like) is not
shown.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ._shared import python_ready, read_table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Never shown.
UNSEEN = frozenset("script style title head template noscript iframe noembed noframes object datalist param source track audio video canvas annotation annotation-xml".split())
#: In a drawing these are shown; the others only group them, or are never shown.
LABELS = frozenset("text foreignobject".split())
UNDRAWN = frozenset("title desc defs metadata symbol clippath mask marker pattern style script".split())
#: Start a line; those in SPACED have an empty line before and behind.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul xmp caption tr td th thead tbody tfoot".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset menu dir xmp".split())
#: Their start ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tag -> (open elements that it ends, elements beyond which it ends nothing).
_LISTS, _TABLES = frozenset("ul ol menu dir td th table".split()), frozenset(("table",))
IMPLIED_ENDS = {
    "li": (frozenset(("li",)), _LISTS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "td", "th", "table"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "td", "th", "table"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "tr": (frozenset(("tr", "td", "th", "caption", "colgroup")), _TABLES),
    "td": (frozenset(("td", "th", "caption")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th", "caption")), frozenset(("tr", "table"))),
    "thead": (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup")), _TABLES),
    "tbody": (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup")), _TABLES),
    "tfoot": (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup")), _TABLES),
    "caption": (frozenset(("caption",)), _TABLES),
}
#: What an end tag inside a cell can't reach out of.
WALLS = frozenset(("td", "th", "caption", "table"))

_TAG = re.compile(r"<(?:!--(?:.*?-->|.*)|[!?][^>]*>?|/([a-zA-Z][^\s/>]*)[^>]*>?|([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([a-zA-Z][^\s/>]*)([^>]*)>?)", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_HIDES = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def build_tree(page: str) -> Node:
    """The tree of a page; any text gives one.  Missing tags are implied: ends of p, li, dt, dd, option, rows, cells and sections, and a row around a cell."""
    root = Node("html", {})
    stack, open_tags = [root], {"html": 1}

    def push(tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_tags[stack.pop().tag] -= 1

    def end_open(ends: frozenset[str], walls: frozenset[str]) -> None:
        if not any(open_tags.get(t) for t in ends):
            return
        depth = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in walls:
                break
            if stack[k].tag in ends:
                depth = k
        if depth:
            pop_to(depth)

    def text(data: str) -> None:
        if data:
            stack[-1].children.append(html.unescape(data) if "&" in data else data)

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag == "p" and not open_tags.get("p"):
                stack[-1].children.append(Node("p", {}))
            elif tag not in ("html", "body") and open_tags.get(tag):
                walls = _TABLES if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else frozenset() if tag == "table" else WALLS
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        pop_to(k)
                        break
                    if stack[k].tag in walls:
                        break
            continue
        tag = (m[2] or m[4] or "").lower()
        if not tag:
            continue
        attrs = _attributes(m[3] or m[5] or "")
        if tag == "html":
            continue
        if tag == "body":
            end_open(frozenset(("head",)), frozenset())
            if not open_tags.get("body"):
                push(tag, attrs)
            continue
        if tag in ENDS_P and open_tags.get("p"):
            end_open(frozenset(("p",)), WALLS | {"button", "object", "template"})
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            pop_to(len(stack) - 1)
        if tag in IMPLIED_ENDS:
            end_open(*IMPLIED_ENDS[tag])
        if tag in ("td", "th") and open_tags.get("table") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            push("tr", {})
        if open_tags.get("head") and tag not in ("title", "meta", "link", "base", "script", "style", "noscript", "template", "head"):
            end_open(frozenset(("head",)), frozenset())
        push(tag, attrs)
        closed = (m[3] or "").endswith("/") and (open_tags.get("svg") or open_tags.get("math"))
        if tag in VOID or closed:
            pop_to(len(stack) - 1)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            data = page[at : end.start() if end else n]
            if data:
                stack[-1].children.append(html.unescape(data) if tag in ("textarea", "title") and "&" in data else data)
            at = end.end() if end else n
            pop_to(len(stack) - 1)
    return root


def _hidden(node: Node) -> bool:
    if node.tag in UNSEEN or "hidden" in node.attrs:
        return True
    if node.tag == "dialog" and "open" not in node.attrs:
        return True
    return "style" in node.attrs and bool(_HIDES.search(node.attrs["style"]))


def _visibility(node: Node) -> bool | None:
    """What the element says of its own and its descendants' visibility: None where it says nothing."""
    said = _VISIBILITY.findall(node.attrs["style"]) if "style" in node.attrs else None
    return said[-1].lower() == "visible" if said else None


def _labels(drawing: Node) -> list[Node | str]:
    """The text elements of a drawing, in order, with space between."""
    found: list[Node | str] = [" "]
    todo = list(reversed(drawing.children))
    while todo:
        node = todo.pop()
        if isinstance(node, str) or node.tag in UNDRAWN or _hidden(node):
            continue
        if node.tag in LABELS:
            found += [node, " "]
        else:
            todo.extend(reversed(node.children))
    return found


def _width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Flow:
    """Lines of text in the making."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.indent: list[str] = []
        self.mark = ""
        self.space = self.blank = False

    def add(self, data: str, keep: bool = False) -> None:
        if keep:
            first, *more = data.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self._put(first)
            for line in more:
                self.line(always=True)
                self._put(line)
            return
        parts = _SPACES.split(data)
        if parts and not parts[0]:
            self.space = True
        said = " ".join(p for p in parts if p)
        if said:
            self._put((" " if self.space and self.now else "") + said)
            self.space = not parts[-1]

    def _put(self, text: str) -> None:
        if text:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.now.append(text)

    def line(self, always: bool = False) -> None:
        """End the line, if anything is on it (or always, as br does)."""
        if self.now or always:
            margin = "".join(self.indent)
            self.lines.append((margin[: len(margin) - len(self.mark)] + self.mark + "".join(self.now)).rstrip())
            self.mark, self.now = "", []
        self.space = False

    def block(self, spaced: bool) -> None:
        self.line()
        self.blank |= spaced

    def text(self) -> str:
        self.line()
        return "\n".join(self.lines).strip("\n")


def _table_lines(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Rows of (text, columns) as lines with cells padded to their columns' widths, " | " between."""
    widths: list[int] = []
    for row in rows:
        at = 0
        for cell, span in row:
            widths += [0] * (at + span - len(widths))
            if span == 1:
                widths[at] = max(widths[at], _width(cell))
            at += span
    lines = []
    for row in rows:
        at, out = 0, []
        for cell, span in row:
            room = sum(widths[at : at + span]) + 3 * (span - 1)
            out.append(cell + " " * (room - _width(cell)))
            at += span
        lines.append(" | ".join(out).rstrip())
    return lines


def render(root: Node) -> str:
    """All visible text of a tree.  Walks with a stack of its own, so depth doesn't matter."""
    flows, tables, lists, pre, shown = [_Flow()], [], [], 0, [True]
    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if tables and tables[-1][1] == len(flows) and not node.strip():
                continue  # between rows and cells
            if shown[-1]:
                flow.add(node, keep=pre > 0)
            continue
        tag = node.tag
        if not leaving:
            if _hidden(node):
                continue
            if (visible := _visibility(node)) is not None:
                shown.append(visible)
                todo.append((Node("", {}), True))  # comes up when all below the element is done
            if tag == "svg":
                todo.extend((child, False) for child in reversed(_labels(node)))
                continue
            if tag == "br":
                flow.line(always=True)
                continue
            if tag == "wbr" or tag in VOID - {"hr", "img", "input"}:
                continue
            if tag in ("img", "input"):
                said = node.attrs.get("alt", "") if tag == "img" else node.attrs.get("value", "") if node.attrs.get("type", "text").lower() in ("submit", "button", "reset") else ""
                if shown[-1]:
                    flow.add(said)
                continue
            if tag == "hr":
                flow.block(True)
                flow._put("---")
                flow.block(True)
                continue
            if tag == "table":
                flow.block(True)
                tables.append(([], len(flows)))
            elif tag == "tr" and tables:
                tables[-1][0].append([])
            elif tag in ("td", "th") and tables and tables[-1][0]:
                flows.append(_Flow())
            elif tag in BLOCK:
                # a list inside a list has no empty lines around
                flow.block(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists))
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.attrs.get("start", "")
                lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
                flow.indent.append("")
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                flow.indent.append(" " * len(mark))
                flow.mark = mark
            elif tag in ("blockquote", "dd"):
                flow.indent.append("  ")
            elif tag in ("pre", "textarea", "xmp"):
                pre += 1
            elif tag == "q":
                flow.add('"')
            todo.append((node, True))
            todo.extend((child, False) for child in reversed(node.children))
            continue
        if not tag:
            shown.pop()
            continue
        if tag in ("td", "th") and len(flows) > 1 and tables and tables[-1][1] < len(flows):
            cell = " ".join(x.strip() for x in flows.pop().text().split("\n") if x.strip())
            span = node.attrs.get("colspan", "1")
            tables[-1][0][-1].append((cell, min(1000, int(span)) if span.isascii() and span.isdigit() and span != "0" else 1))
        elif tag == "table" and tables:
            rows, _ = tables.pop()
            flow.line()
            if any(cell for row in rows for cell, _ in row):
                for line in _table_lines([row for row in rows if row]):
                    flow._put(line)
                    flow.line()
            flow.block(True)
        elif tag in BLOCK and tag != "tr":
            flow.block(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and len(lists) > 1))
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
            flow.indent.pop()
        elif tag == "li":
            flow.indent.pop()
            flow.mark = ""
        elif tag in ("blockquote", "dd"):
            flow.indent.pop()
        elif tag in ("pre", "textarea", "xmp"):
            pre -= 1
        elif tag == "q":
            flow.add('"')
    return flows[0].text()


def html_text(page: str | None) -> str:
    """The visible text of a page; null and empty pages have none."""
    return render(build_tree(page)) if page else ""


def _render_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([html_text(h) for h in b.column(0).to_pylist()], pa.string())], [*b.schema.names[1:], "text"])


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` of every page and its visible ``text``.

    Any markup gives a result, null and empty pages an empty text; repeated rows
    come back as often as they came; a null id stays null, an empty table gives
    an empty result.  A page is read whole, in time about in proportion to its
    length, and its tree and text are held at once.  Columns that aren't kept
    don't matter, whatever their names; ``keep`` can't hold ``text``.
    """
    python_ready(pages.sparkSession)
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType())])
    return pages.select(F.col(html_col).cast("string").alias("_html"), *(F.col(f"`{c}`") for c in keep)).mapInArrow(_render_batches, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the visible text of all pages."""
    return extract(read_table(spark, sf_dir, "pages"))
