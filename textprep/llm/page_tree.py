"""Web pages as flat arrays of DOM nodes, parsed leniently: the input of main-text extraction."""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the markup language.
TAGS = (
    "html body div section article main header footer nav aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th "
    "blockquote pre figure figcaption a span b i em strong small button label select option input img ins address details summary center iframe"
).split()
BLOCKS = set(
    "html body div section article main header footer nav aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th "
    "caption blockquote pre figure figcaption hr fieldset address details summary center dialog menu hgroup search legend".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style title textarea noscript iframe template xmp noembed noframes head select".split())
RAW = set("script style title textarea noscript iframe template xmp noembed noframes".split())
CLOSED_BY = {  # an open element that the start of others ends, unless one of the barriers lies between
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
P_BARRIERS = {"td", "th", "table", "button", "caption", "html", "body"}
P_STAYS = {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "dt", "dd", "legend", "summary"}

_TAG_PLACE = {t: i for i, t in enumerate(TAGS)}
N_TAGS = len(TAGS) + 1  # the last is any other
ATTRIBUTE_BUCKETS = 2048

_START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s>/]*))")
_STOP = re.compile("[>\"']")
_QUOTED_TRIES = 8  # tags whose quotes may run on to the end of the page before quotes are no longer heeded
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_GIVEN = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")  # with a value or without
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_NOT_DISPLAYED = re.compile(r"(?:^|[;\s])display\s*:\s*none\b", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _hidden(attributes: str) -> bool:
    """Whether a start tag's own attributes hide it: hidden, aria-hidden="true" or display: none in its style."""
    if not _MAY_HIDE.search(attributes):
        return False
    for key, *values in _GIVEN.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true"):
            return True
        if key == "style" and _NOT_DISPLAYED.search(html.unescape(value)):
            return True
    return False


class _Tags:
    """The tags of a page, one after another: (start, end, slash, name, attributes). A comment's or declaration's name is empty.

    A tag ends at the first > outside of quotes, or, if there is none, at the first > at all. What follows the last > or the
    last quote is known beforehand, so that broken tags are not looked through again and again.
    """

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.last_quote = {q: source.rfind(q) for q in "\"'"}
        self.tries = _QUOTED_TRIES

    def _end(self, at: int) -> int:
        """Place of the > that ends the tag whose attributes begin at `at`; -1 without any."""
        place, source = at, self.source
        while self.tries and (stop := _STOP.search(source, place)):
            place, mark = stop.end(), stop.group()
            if mark == ">":
                return place - 1
            if place > self.last_quote[mark]:  # nothing closes it
                break
            place = source.index(mark, place) + 1
            if place > self.last:
                break
        else:
            return source.find(">", at)
        self.tries -= 1
        return source.find(">", at)

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        source = self.source
        while found := _START.search(source, at):
            comment, declared, slash, name = found.groups()
            if comment:
                end = source.find("-->", found.end())
                return found.start(), len(source) if end < 0 else end + 3, "", "", ""
            if found.end() <= self.last:
                end = source.find(">", found.end()) if declared else self._end(found.end())
                attributes = "" if declared else source[found.end() : end]
                return found.start(), end + 1, slash or "", "" if declared else name.lower(), attributes
            at = found.end()
        return None


class _Open:
    """The elements that are open, with the places of each name, so that none is looked for step by step."""

    def __init__(self, root: int):
        self.stack: list[tuple[str, int]] = [("", root)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.unseen = self.dead = 0

    def last(self, names) -> int:
        """Place of the innermost open element of these names; 0 without any."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    @property
    def top(self) -> tuple[str, int]:
        return self.stack[-1]

    @property
    def depth(self) -> int:
        return len(self.stack) - self.dead

    def push(self, name: str, node: int) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((name, node))
        self.unseen += node < 0

    def close(self, place: int) -> None:
        """End the element at `place` and all in it."""
        while len(self.stack) > place or self.stack[-1][0] == _ENDED:
            name, node = self.stack.pop()
            if name == _ENDED:
                self.dead -= 1
                continue
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()
            self.unseen -= node < 0

    def end_inside(self, place: int) -> None:
        """End an inline element alone; what began in it goes on."""
        name, node = self.stack[place]
        self.places[name].pop()
        self.stack[place] = (_ENDED, node)
        self.dead += 1
        self.unseen -= node < 0


_ENDED = "/"  # the name of no element


@dataclass
class Forest:
    """Nodes of some pages in document order; a page's first node is its root. Children follow their parents."""

    parent: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    place: list[int] = field(default_factory=list)  # among its siblings
    page: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)  # of training pages: 1 main, 0 not, -1 as the parent
    token_node: list[int] = field(default_factory=list)
    token: list[int] = field(default_factory=list)
    text_node: list[int] = field(default_factory=list)
    text_run: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    pages: int = 0
    runs: int = 0

    def add(self, source: str, labelled: bool = False) -> None:
        """Parse one page, in time proportional to its length. Unseen elements (scripts, styles, hidden ones) leave nothing.

        Of a page that is `labelled`, for training, the attribute data-main tells what is main text; else it is as any other.
        """
        page, self.pages = self.pages, self.pages + 1
        self.runs += 1
        children: dict[int, int] = {}

        def node(tag: str, parent: int, depth: int) -> int:
            self.parent.append(parent)
            self.tag.append(_TAG_PLACE.get(tag, len(TAGS)))
            self.depth.append(depth)
            self.place.append(children.get(parent, 0))
            children[parent] = children.get(parent, 0) + 1
            self.page.append(page)
            self.label.append(-1)
            return len(self.parent) - 1

        root = node("", -1, 0)
        self.parent[root] = root
        tags, opened = _Tags(source), _Open(root)
        at, size = 0, len(source)

        def say(text: str) -> None:
            if not opened.unseen and text:
                self.text_node.append(opened.top[1])
                self.text_run.append(self.runs)
                self.text.append(text)

        while at < size:
            found = tags.after(at)
            if found is None:
                say(source[at:])
                break
            start, end, slash, name, attributes = found
            say(source[at:start])
            at = end
            if not name:
                continue
            if name in BLOCKS:
                self.runs += 1
            if slash:
                if place := opened.last((name,)):
                    inside = opened.blocks[-1] if opened.blocks else 0
                    if name in BLOCKS or name in UNSEEN or inside <= place:
                        opened.close(place)
                    else:  # an inline element ends inside a block that began in it: the block goes on
                        opened.end_inside(place)
                continue
            if name == "br":
                say(" ")
                continue
            if name in ("html", "body") and opened.last((name,)):
                continue
            if name in BLOCKS and name not in P_STAYS and opened.last(("p",)) > opened.last(P_BARRIERS):
                opened.close(opened.last(("p",)))
            ends, barriers = CLOSED_BY.get(name, ((), ()))
            while ends and opened.last(ends) > opened.last(barriers):
                opened.close(opened.last(ends))
                if name != "tr":
                    break
            if name == "body" and opened.top[0] == "head":
                opened.close(len(opened.stack) - 1)
            if name in RAW:
                closing = re.compile(rf"</{re.escape(name)}[\s>/]", re.I).search(source, at)
                at = size if closing is None else source.find(">", closing.start()) + 1 or size
                continue
            if name in VOID:
                continue
            if opened.unseen or name in UNSEEN or _hidden(attributes):
                if not attributes.rstrip().endswith("/"):
                    opened.push(name, -1)
                continue
            own = node(name, opened.top[1], opened.depth)
            if attributes:
                for key, *values in _ATTRIBUTE.findall(attributes):
                    key, value = key.lower(), values[0] or values[1] or values[2]
                    if key in ("class", "id", "role"):
                        for word in _NAME.findall(value):
                            self.token_node.append(own)
                            self.token.append(zlib.crc32(word.lower().encode()) % ATTRIBUTE_BUCKETS)
                    elif labelled and key == "data-main":
                        self.label[own] = int(value)
            if not (name not in BLOCKS and attributes.rstrip().endswith("/")):
                opened.push(name, own)

    def blocks(self, kept: np.ndarray) -> list[str]:
        """The text of each page's kept nodes: blocks of single-spaced words, joined by two line feeds."""
        found: list[list[str]] = [[] for _ in range(self.pages)]
        run, parts, page = -1, [], 0

        def end() -> None:
            if block := " ".join(html.unescape("".join(parts)).split()):
                found[page].append(block)

        for node, own, text in zip(self.text_node, self.text_run, self.text, strict=True):
            if own != run:
                end()
                run, parts = own, []
            if kept[node]:
                parts.append(text)
                page = self.page[node]
        end()
        return ["\n\n".join(blocks) for blocks in found]
