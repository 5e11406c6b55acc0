"""A small tolerant reader of HTML: block elements as a tree, and their texts in page order."""

from __future__ import annotations

import re
from html import unescape

# Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template iframe textarea title".split())
FOREIGN = {"svg", "math", "foreignobject"}
FOREIGN_RAW = set("script style title desc metadata annotation annotation-xml".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr object noscript svg math foreignobject".split()
)
ENDS_P = set(
    "address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr html li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
SAME_ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
SCOPE = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S,
)
_hint = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_name = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_href = re.compile(r"""href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_plain = re.compile(r"[^a-z0-9 _-]+")


class Node:
    __slots__ = ("tag", "hint", "parent", "children", "texts", "attributes")

    def __init__(self, tag: str, hint: str, parent: Node | None, attributes: str = "") -> None:
        self.tag, self.hint, self.parent, self.children, self.texts = tag, hint, parent, [], []
        self.attributes = attributes

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.hint}" if self.hint else self.tag


def names_of(attributes: str) -> list[tuple[str, str]]:
    """Name and value of class, id, role and itemprop."""
    return [(name.lower(), (a or b or c).lower()) for name, a, b, c in _name.findall(attributes)]


class Page:
    """``blocks``: (node, text, letters in links) in page order; ``links``: targets; ``title``."""

    def __init__(self, html: str) -> None:
        self.root = Node("#", "", None)
        self.blocks: list[tuple[Node, str, int]] = []
        self.links: list[str] = []
        self.title = ""
        self._held: list[str] = []
        self._linked = 0
        self._in_link = False
        self._tags: dict[str, int] = {}  # open elements of each tag: what is not open is not looked for
        self._read(html)

    def _flush(self, node: Node) -> None:
        if self._held:
            text = " ".join(unescape("".join(self._held)).split())
            if text:
                node.texts.append(len(self.blocks))
                self.blocks.append((node, text, min(self._linked, len(text))))
            self._held, self._linked = [], 0

    def _text(self, text: str) -> None:
        self._held.append(text)
        if self._in_link:
            self._linked += len(text)

    def _read(self, html: str) -> None:
        open_: list[Node] = [self.root]
        foreign: list[str] = []  # open svg and math elements, whose own elements are inline, and HTML within them
        at, n = 0, len(html)
        while at < n:
            m = _token.search(html, at)
            if m is None:
                self._text(html[at:])
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag in FOREIGN:
                if m[1]:
                    if tag in foreign:
                        while foreign.pop() != tag:
                            pass
                elif (foreign or tag != "foreignobject") and not m[3].endswith("/"):
                    foreign.append(tag)
                if tag != "math":
                    self._held.append(" ")
                continue
            if foreign and foreign[-1] != "foreignobject":
                if tag in ENDS_P and (not m[1] or self._tags.get(tag)):
                    while foreign and foreign[-1] != "foreignobject":
                        foreign.pop()  # as in browsers, HTML ends what was left open
                elif tag in FOREIGN_RAW:
                    if not m[1] and not m[3].endswith("/") and (end := re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)):
                        at = end.end()
                    continue
                elif tag not in INLINE:
                    if tag == "text":
                        self._held.append(" ")
                    continue
            if m[1]:
                if tag == "a":
                    self._in_link = False
                if tag in INLINE:
                    continue
                self._close(open_, tag)
                continue
            if tag in RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                if tag == "title" and not self.title:
                    self.title = " ".join(unescape(html[at : end.start() if end else n]).split())
                if tag == "textarea":
                    self._open(open_, tag, m[3])
                    self._text(html[at : end.start() if end else n])
                    self._close(open_, tag)
                at = end.end() if end else n
                continue
            if tag == "a":
                self._in_link = True
                if h := _href.search(m[3]):
                    self.links.append(unescape(h[1] or h[2] or h[3] or ""))
            if tag in INLINE:
                if tag in ("br", "wbr", "img"):
                    self._held.append(" ")
                continue
            self._open(open_, tag, m[3])
        self._flush(open_[-1])

    def _open(self, open_: list[Node], tag: str, attributes: str) -> None:
        self._flush(open_[-1])
        self._in_link = False
        if open_[-1].tag == "p" and tag in ENDS_P:
            self._cut(open_, -1)  # a paragraph has no element inside that is on this list
        if tag in SAME_ENDS:
            ends, scope = SAME_ENDS[tag].split(), SCOPE[tag].split()
            for i in range(len(open_) - 1, 0, -1) if any(map(self._tags.get, ends)) else ():
                if open_[i].tag in scope:
                    break
                if open_[i].tag in ends and (tag != "tr" or open_[i].tag == "tr"):
                    self._cut(open_, i)
                    break
        if tag in VOID:
            return
        hint = ""
        if attributes:
            hint = " ".join(_plain.sub(" ", (a or b or c).lower()) for a, b, c in _hint.findall(attributes))
        node = Node(tag, " ".join(hint.split()), open_[-1], attributes)
        open_[-1].children.append(node)
        open_.append(node)
        self._tags[tag] = self._tags.get(tag, 0) + 1

    def _cut(self, open_: list[Node], i: int) -> None:
        for node in open_[i:]:
            self._tags[node.tag] -= 1
        del open_[i:]

    def _close(self, open_: list[Node], tag: str) -> None:
        for i in range(len(open_) - 1, 0, -1) if self._tags.get(tag) else ():
            if open_[i].tag == tag:
                self._flush(open_[-1])
                self._cut(open_, i)
                return
        if tag == "p":
            self._flush(open_[-1])
