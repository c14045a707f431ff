"""A small document tree over the standard library's HTML tokenizer, for record extraction."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tag -> open tags that its start ends, looked for up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "p": ({"p"}, {"div", "td", "section", "li", "blockquote"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
}
# Elements that browsers show as blocks, and elements that show no text of their own.
BLOCKS = frozenset("address article blockquote dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li ol p pre section table tbody tfoot thead ul".split())
SILENT = frozenset("img noscript script style svg".split())


class Element:
    """A tag, its attributes, parent, and children (elements and strings).

    ``nodes`` are all elements of its tree in document order; those below it are the ones
    from behind its own place up to ``end``, as nothing is ever added to an element that was left.
    """

    __slots__ = ("tag", "attrs", "parent", "children", "nodes", "start", "end")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.nodes = [] if parent is None else parent.nodes
        self.start, self.end = len(self.nodes), None
        self.nodes.append(self)

    def __iter__(self) -> Iterator[Element]:
        """All elements below, in document order."""
        return iter(self.nodes[self.start + 1 : self.end])

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def all(self, tag: str | None = None, cls: str | None = None, where: Callable[[Element], bool] | None = None, **attrs: str) -> list[Element]:
        found = self.nodes[self.start + 1 : self.end]
        if tag is not None:
            found = [e for e in found if e.tag == tag]
        if cls is not None:
            found = [e for e in found if cls in e.attrs.get("class", "") and cls in e.classes()]
        for k, v in attrs.items():
            name = k.replace("_", "-")
            found = [e for e in found if e.attrs.get(name) == v]
        return found if where is None else [e for e in found if where(e)]

    def first(self, *args, **kwargs) -> Element | None:
        found = self.all(*args, **kwargs)
        return found[0] if found else None

    def own(self, tag: str) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element) and c.tag == tag]

    def above(self, cls: str) -> Element | None:
        node = self.parent
        while node is not None and cls not in node.classes():
            node = node.parent
        return node

    def text(self) -> str:
        """All text below, runs of white space as one space."""
        if len(self.children) == 1 and isinstance(self.children[0], str):
            return squeeze(self.children[0])
        parts: list[str] = []
        todo: list[Element | str] = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                parts.append(node)
            else:
                todo.extend(reversed(node.children))
        return squeeze(" ".join(parts))


def squeeze(text: str) -> str:
    return " ".join(text.split())


class _Tree:
    """A tree that grows by tags and texts in document order."""

    def __init__(self):
        self.root = self.at = Element("", {}, None)

    def leave(self, node: Element) -> None:
        """What is open below and at ``node`` ends."""
        n, at = len(node.nodes), self.at
        while at is not node:
            at.end, at = n, at.parent
        node.end, self.at = n, node.parent

    def begin(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in CLOSES:
            ends, walls = CLOSES[tag]
            node, last = self.at, None
            while node.parent is not None and node.tag not in walls:
                if node.tag in ends:
                    last = node
                node = node.parent
            if last is not None:
                self.leave(last)
        new = Element(tag, attrs, self.at)
        self.at.children.append(new)
        if tag in VOID:
            new.end = new.start + 1
        else:
            self.at = new

    def finish(self, tag: str) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.leave(node)
                return
            node = node.parent

    def say(self, text: str) -> None:
        self.at.children.append(text)


class _Builder(HTMLParser):
    """Any page, by the standard library's tokenizer."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tree = _Tree()

    def handle_starttag(self, tag, attrs):
        self.tree.begin(tag, {k: v or "" for k, v in attrs})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.tree.leave(self.tree.at)

    def handle_endtag(self, tag):
        self.tree.finish(tag)

    def handle_data(self, data):
        self.tree.say(data)


#: Plain markup: (slash, tag, attributes), a text, or else one character of something that isn't plain.
_PLAIN = re.compile(r'<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][-a-zA-Z0-9_]*="[^"&]*")*)[ \t\n]*>|([^<]+)|(<)')
_ATTRIBUTE = re.compile(r'([a-zA-Z][-a-zA-Z0-9_]*)="([^"]*)"')
#: Elements whose content has rules of its own.
_RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())


@lru_cache(4096)
def _attributes(written: str) -> dict[str, str]:
    """Attributes as they were written; a dictionary that elements share and nobody changes."""
    return {k.lower(): v for k, v in _ATTRIBUTE.findall(written)}


def _parse_plain(page: str) -> Element | None:
    """The tree of a page of plain tags and texts, None for any other: comments, declarations, odd quotes, references in attributes, markup inside raw text."""
    tree, raw = _Tree(), None
    for found in _PLAIN.finditer(page):
        slash, tag, attrs, text, odd = found.groups()
        if text is not None:
            tree.say(unescape(text) if raw is None and "&" in text else text)
            continue
        if odd is not None:
            return None
        tag = tag.lower()
        if raw is not None and (not slash or tag != raw):
            return None
        if slash:
            if attrs:
                return None
            tree.finish(tag)
            raw = None
            continue
        tree.begin(tag, _attributes(attrs) if attrs else {})
        if tag in _RAW:
            if tag not in ("script", "style"):
                return None
            raw = tag
    return tree.root if raw is None else None


def parse(page: str) -> Element:
    """The tree of a page; comments and declarations are left out."""
    root = _parse_plain(page)
    if root is None:
        builder = _Builder()
        builder.feed(page)
        builder.close()
        root = builder.tree.root
    return root


#: What pages of one shape may differ in: a text between two tags, or an address or number in an attribute.
_VARIES = re.compile(r'>([^<>]+)(?=<)|="(?:(?<= href=")|(?<= src=")|(?<= data-numero="))([^"&<>]*)(?=")')
#: Signs that stand for what varies while a shape is looked at; pages that have them are no shape.
_SIGNS = range(0xF0000, 0xFFFFE)
_SIGN = re.compile(f"[{chr(_SIGNS[0])}-{chr(_SIGNS[-1])}]")
#: Characters of a page that is tried as a shape, and of all shapes that a worker keeps.
SHAPE_CHARS, SHAPES_CHARS = 1 << 16, 1 << 24

#: (kind, text, attributes)
Event = tuple[str, str, dict[str, str | None]]


def _said(text: str | None, texts: set[str], signs: dict[str, int]) -> str | int | tuple[int, ...] | None:
    """What a rule made of signs: a place of ``_VARIES`` whose value is meant as it is, places whose texts are meant as one text, or a fixed text; ``KeyError`` for anything else."""
    if text is None or not _SIGN.search(text):
        return text
    if text in signs and text not in texts:
        return signs[text]
    words = text.split(" ")
    if not texts.issuperset(words):
        raise KeyError(text)
    return tuple(signs[w] for w in words)


class Shapes:
    """Events of pages by a rule; pages that differ in ``_VARIES`` only are parsed once.

    The rule may look at tags and all other attributes as it likes, but what
    varies it may only give back: a text of an element or an attribute as it
    is, and nothing may depend on their values.  An event with the attribute
    ``uneven`` says that it could not keep to that.
    """

    def __init__(self, rule: Callable[[Element], Iterator[Event]]):
        self.rule, self.known, self.left = rule, {}, SHAPES_CHARS

    def _look(self, page: str) -> list[tuple] | None:
        """The events of a page as places of what varies; None if the page, or what the rule does with it, isn't that plain."""
        found = list(_VARIES.finditer(page))
        if len(found) > len(_SIGNS) or _SIGN.search(page):
            return None
        sign = lambda k: chr(_SIGNS[k])
        signs = {sign(k): 3 * k + m.lastindex for k, m in enumerate(found)}
        texts = {sign(k) for k, m in enumerate(found) if m.lastindex == 1}
        count = iter(range(len(found)))
        root = _parse_plain(_VARIES.sub(lambda m: (">" if m.lastindex == 1 else '="') + sign(next(count)), page))
        if root is None:
            return None
        met = [c for e in root.nodes if e.tag not in ("script", "style") for c in e.children if isinstance(c, str) and c in texts]
        met += [v for e in root.nodes for v in e.attrs.values() if v in signs and v not in texts]
        if sorted(met) != sorted(signs):
            return None
        try:
            events = [(kind, _said(text, texts, signs), [(name, _said(v, texts, signs)) for name, v in attrs.items()]) for kind, text, attrs in self.rule(root)]
        except KeyError:
            return None
        return None if any(name == "uneven" for e in events for name, _ in e[2]) else events

    def events(self, page: str) -> list[Event]:
        if len(page) > SHAPE_CHARS or "\0" in page:
            return list(self.rule(parse(page)))
        pieces = _VARIES.split(page)
        shape = "\0".join(pieces[::3])
        events = self.known.get(shape)
        if events is None:
            found = list(self.rule(parse(page)))
            if shape not in self.known:
                if self.left < len(shape):
                    self.known, self.left = {}, SHAPES_CHARS
                self.left -= len(shape)
                self.known[shape] = self._look(page)
            return found
        if "&" in page:
            pieces[1::3] = [t and unescape(t) for t in pieces[1::3]]

        def value(of):
            if of.__class__ is int:
                return pieces[of]
            if of.__class__ is tuple:
                return squeeze(pieces[of[0]]) if len(of) == 1 else squeeze(" ".join([pieces[k] for k in of]))
            return of

        return [(kind, value(text), {name: value(of) for name, of in attrs} if attrs else {}) for kind, text, attrs in events]


class _Lines:
    """Lines of shown text as its pieces come in; inside a table row, text goes into cells instead."""

    def __init__(self):
        self.texts: list[list[str]] = [[]]
        self.rows: list[list[str]] = []

    def enter(self, e: Element) -> bool:
        """False if nothing below the element is shown."""
        in_row = e.parent is not None and e.parent.tag == "tr" and bool(self.rows)
        if e.tag in SILENT or in_row and e.tag not in ("td", "th"):
            return False
        if in_row:
            self.texts.append([])
        elif e.tag in BLOCKS or e.tag == "br":
            self.texts[-1].append("\n")
        if e.tag == "tr":
            self.rows.append([])
        return e.tag != "br"

    def leave(self, e: Element) -> None:
        if e.tag == "tr":
            self.texts[-1].append("\n" + " | ".join(filter(None, self.rows.pop())) + "\n")
        if e.parent is not None and e.parent.tag == "tr" and self.rows:
            self.rows[-1].append(squeeze("".join(self.texts.pop())))
        elif e.tag in BLOCKS:
            self.texts[-1].append("\n")

    def say(self, text: str, owner: Element) -> None:
        if owner.tag != "tr" or not self.rows:  # between a row's cells nothing is shown
            self.texts[-1].append(text)


def plain_text(node: Element) -> str:
    """Text of an element: a line for each block, a row's cells on one line with " | " between them, nothing of scripts and images; empty lines are left out."""
    lines = _Lines()
    coming: list[tuple[Element | str, Element, bool]] = [(c, node, False) for c in reversed(node.children)]
    while coming:
        item, owner, finished = coming.pop()
        if isinstance(item, str):
            lines.say(item, owner)
        elif finished:
            lines.leave(item)
        elif lines.enter(item):
            coming.append((item, owner, True))
            coming.extend((c, item, False) for c in reversed(item.children))
    return "\n".join(filter(None, map(squeeze, "".join(lines.texts[0]).split("\n"))))


def first_number(text: str | None) -> int | None:
    found = re.search(r"\d+", text or "")
    return int(found[0]) if found else None
