"""HTML in plain Python: a tokenizer, text lines, and a light element tree.

No Spark here: everything is called from one Python pass per page.
"""

from __future__ import annotations

import html as _html
import re

#: Tags that belong to the line they stand in. Fixed values of the line definition.
INLINE = frozenset(("a", "b", "em", "i", "small", "span", "strong"))
#: Elements whose content is never text of the page.
SKIPPED = ("head", "script", "style", "noscript")
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))

_SKIP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:head(?=[\s/>])[^>]*>.*?(?:</head\s*>|(?=<body[\s>])|\Z)|(script|style|noscript)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z))", re.I | re.S
)
_INLINE_TAG = re.compile(r"</?(?:a|b|em|i|small|span|strong)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", re.I)
_TAG = re.compile(r"<(?:/?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[!?][^>]*>)")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S
)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "textarea", "title")}


_RUNS = re.compile(r"[ \n\r\t\f]{2,}|[\n\r\t\f]")


def text_of(piece: str) -> str:
    """Entities decoded, whitespace (no-break and thin spaces included) collapsed, trimmed."""
    if "&" in piece:
        piece = _html.unescape(piece)
    return " ".join(piece.split())


def page_lines(page: str | None) -> list[str]:
    """Lines of a page in order: text between tags other than the inline ones; empty lines are left out.

    None and empty pages have no lines.
    """
    if not page:
        return []
    # comments are no tags and leave no trace; an element that is left out still parts the lines around it
    body = _INLINE_TAG.sub("", _SKIP.sub(lambda m: "" if m[0].startswith("<!--") else "<hr>", page))
    out = []
    for piece in _TAG.split(body):
        line = text_of(piece)
        if line:
            out.append(line)
    return out


class Node:
    """An element. ``kids`` holds child nodes and text pieces (str, entities not yet decoded)."""

    __slots__ = ("_attrs", "attrs_src", "kids", "parent", "stat", "tag")

    def __init__(self, tag: str, attrs_src: str = "", parent: Node | None = None):
        self.tag, self.attrs_src, self.parent = tag, attrs_src, parent
        self.kids: list[Node | str] = []
        self._attrs: dict[str, str] | None = None
        self.stat = None  # for whoever walks the tree

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            self._attrs = {}
            for m in _ATTR.finditer(self.attrs_src):
                value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
                self._attrs.setdefault(m[1].lower(), _html.unescape(value))
        return self._attrs

    def walk(self):
        """This node and all below it, in document order, without recursion."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(k for k in reversed(node.kids) if not isinstance(k, str))

    def content(self) -> str:
        """All text below as it stands, decoded; runs of ASCII whitespace are one space, no-break spaces stay, and tags part nothing."""
        parts: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.kids:
                raw = x.tag in ("script", "style")
                todo.extend(k if not isinstance(k, str) or raw or "&" not in k else _html.unescape(k) for k in reversed(x.kids))
        return _RUNS.sub(" ", "".join(parts)).strip(" \n\r\t\f")

    def text(self) -> str:
        """All text below, decoded and collapsed."""
        parts: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag not in ("script", "style"):
                if x.tag not in INLINE:
                    parts.append(" ")
                todo.append(" " if x.tag not in INLINE else "")
                todo.extend(reversed(x.kids))
        return text_of("".join(parts))


#: A start tag ends these open elements. Fixed values of the HTML rules for omitted end tags.
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "body": ("head",),
}
_ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
_SCOPE = frozenset(("html", "body", "table", "td", "th", "ul", "ol", "div", "section", "article", "main", "aside"))


def parse(page: str) -> Node:
    """A tree of ``page``. Open and wrongly closed tags are repaired by a few rules; nothing raises."""
    root = Node("#root")
    cur, at, n = root, 0, len(page)
    find = _TOKEN.search
    while at < n:
        m = find(page, at)
        if m is None:
            cur.kids.append(page[at:])
            break
        if m.start() > at:
            cur.kids.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            node = cur
            while node is not root and node.tag != name:
                node = node.parent
            if node is not root:
                cur = node.parent
            continue
        if name in _ENDS_P:
            node = cur
            while node is not root and node.tag in INLINE:
                node = node.parent
            if node.tag == "p":
                cur = node.parent
        if name in _ENDS:
            ends, node = _ENDS[name], cur
            while node is not root and node.tag not in ends and node.tag not in _SCOPE:
                node = node.parent
            while node is not root and node.tag in ends:
                cur = node = node.parent
        new = Node(name, m[3], cur)
        cur.kids.append(new)
        if name in _RAW_END:
            end = _RAW_END[name].search(page, at)
            stop = end.start() if end else n
            if stop > at:
                new.kids.append(page[at:stop])
            at = end.end() if end else n
        elif name not in VOID and not m[3].endswith("/"):
            cur = new
    return root
