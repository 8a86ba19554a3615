"""HTML as a sequence of text blocks, each with the open elements around it."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
#: Elements that neither begin nor end a block (fixed values).
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without content (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page: code, and what a reader may fill in (fixed values).
UNREAD = frozenset("script style template textarea select".split())
#: Elements of other languages: what lies in them is part of the block around, until an element begins that they cannot hold (fixed values).
FOREIGN = frozenset(("math", "svg"))
_APART = frozenset("mi mn mo ms mtext mtd annotation text tspan title desc".split())
#: Elements that end an open paragraph when they begin (fixed values).
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that end an open element of their own kind when they begin (fixed values).
_ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: Elements that end open elements of other languages when they begin (fixed values).
_LEAVES_FOREIGN = _ENDS_P | frozenset("body button caption dd dt head html iframe li noscript object option tbody td tfoot th thead tr".split())

#: What may begin with "<" other than text: a comment, a declaration, an element's start or end, an end without a name.
_START = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z]|/)")
_COMMENT_END = re.compile(r"--!?>")
_NAME = re.compile(r"[^\s/>]+")
#: Attributes up to the end of a tag. A quote counts only where a value begins; nothing is tried twice.
_ATTRIBUTES = re.compile(r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+>""")
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_MARKS = {name: re.compile(rf"<(/?){name}(?=[\s/>])" if name == "select" else rf"<(/){name}(?=[\s/>])", re.I) for name in UNREAD}


class Node:
    """An element: its name, the words of its class, id and role, and the element around it (those of INLINE left out)."""

    __slots__ = ("around", "name", "words")

    def __init__(self, around: Node | None, name: str, words: tuple[str, ...] = ()) -> None:
        self.around, self.name, self.words = around, name, words

    def upwards(self) -> Iterator[Node]:
        node: Node | None = self
        while node is not None:
            yield node
            node = node.around


def nested(path: tuple[tuple[str, ...], ...]) -> Node | None:
    """The innermost of elements that are given from the outermost on, each as its name and words."""
    node = None
    for name, *words in path:
        node = Node(node, name, tuple(words))
    return node


@dataclass(slots=True)
class Block:
    node: Node | None  # the innermost element around it
    text: str
    linked: float  # the share of the text that lies in links


class _Open:
    """The open elements, with the places of each name, so that no step has to look through all of them."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.nodes: list[Node | None] = []
        self.places: dict[str, list[int]] = {}
        self.outer: list[int] = []  # places of those that are not inline
        self.foreign: list[int] = []  # places of math and svg

    @property
    def node(self) -> Node | None:
        return self.nodes[-1] if self.nodes else None

    def last(self, names: tuple[str, ...]) -> int:
        """The place of the innermost element of these names, or -1."""
        return max((at[-1] for n in names if (at := self.places.get(n))), default=-1)

    def push(self, name: str, words: tuple[str, ...], inline: bool) -> None:
        here = len(self.names)
        self.nodes.append(self.node if inline else Node(self.node, name, words))
        self.names.append(name)
        self.places.setdefault(name, []).append(here)
        if not inline:
            self.outer.append(here)
        if name[1:] in FOREIGN and name[0] == ":":
            self.foreign.append(here)

    def pop_to(self, k: int) -> None:
        while len(self.names) > k:
            self.places[self.names.pop()].pop()
            self.nodes.pop()
            here = len(self.names)
            for held in (self.outer, self.foreign):
                if held and held[-1] == here:
                    held.pop()


def blocks(page: str) -> list[Block]:
    """All blocks with text, in page order; character references decoded, white space runs made one space.

    A tag ends where its attributes do. Should one never end that way, it and those after it end at the next ">"; where no
    ">" follows at all, the rest is text. The time grows with the page's length alone.
    """
    stack = _Open()
    out: list[Block] = []
    parts: list[str] = []
    in_links = 0
    endless: set[str] = set()  # elements of UNREAD without an end tag from here on
    quotes = True

    def inline(name: str) -> bool:
        return name in INLINE or name[0] == ":"

    def close() -> None:
        nonlocal in_links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack.node, text, min(1.0, in_links / max(1, sum(map(len, parts))))))
            parts.clear()
        in_links = 0

    at, n, last_end = 0, len(page), page.rfind(">")
    while at < n:
        m = _START.search(page, at)
        comment = m is not None and m[0] == "<!--"
        if m is not None and not comment and m.start() > last_end:
            m = None
        text = page[at : m.start() if m else n]
        if text:
            parts.append(text)
            if stack.places.get("a"):
                in_links += len(text)
        if m is None:
            break
        if comment:
            end = _COMMENT_END.search(page, m.start() + 2)
            at = end.end() if end else n
            continue
        if not m[0][-1].isalpha():
            at = page.index(">", m.end()) + 1
            continue
        ends = m[0][1] == "/"
        name_at = _NAME.match(page, m.end() - 1)
        tag = _ATTRIBUTES.match(page, name_at.end()) if quotes else None
        quotes = tag is not None
        at = tag.end() if tag else page.index(">", name_at.end()) + 1
        empty = page[at - 2] == "/"
        name = name_at[0].lower()
        if name in FOREIGN or (stack.foreign and name not in INLINE and name not in UNREAD and (name not in _LEAVES_FOREIGN)):
            if not ends and name in _APART:
                parts.append(" ")
            name = f":{name}"
        if ends:
            if name == "br":
                parts.append(" ")
                continue
            k = stack.last((name,))
            if not inline(name):
                close()
            # an inline element's end does not reach out of its block
            if k >= 0 and (not inline(name) or k > (stack.outer[-1] if stack.outer else -1)):
                stack.pop_to(k)
            continue
        if name in UNREAD:
            if not empty and name not in endless:
                # a select ends where the next one begins
                mark = _MARKS[name].search(page, at)
                end = page.find(">", mark.end()) + 1 if mark else 0
                if end and mark[1]:
                    at = end
                elif name in ("script", "style"):
                    at = n
                elif not end:
                    endless.add(name)
            if name in ("textarea", "select"):
                parts.append(" ")
            continue
        if stack.foreign and name in _LEAVES_FOREIGN:
            stack.pop_to(stack.foreign[0])
        if inline(name):
            if name in ("br", "img", "wbr"):
                parts.append(" " if name == "br" else "")
                continue
        else:
            close()
            if name in _ENDS_P and (k := stack.last(("p",))) >= 0:
                stack.pop_to(k)
            held = stack.last(("ul", "ol", "dl", "table", "menu"))
            # the outermost of those that this one ends, within the list or table around
            first = [at_[bisect_right(at_, held)] for e in _ENDS_OWN.get(name, ()) if (at_ := stack.places.get(e)) and at_[-1] > held]
            if first:
                stack.pop_to(min(first))
        if name not in VOID and not empty:
            said = page[name_at.end() : at - 1]
            words = tuple(w for a in _NAMES.finditer(said) for w in _WORDS.findall((a[2] or a[3] or a[4] or "").lower())) if said else ()
            stack.push(name, words, inline(name))
    close()
    return out
